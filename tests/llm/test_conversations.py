"""The conversation operators against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from skein.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\t\n\x0b\x0c\r"


def made_rows(seed, n=160, convs=30):
    """Few roles, texts and turns, so ties, repeats and equal conversations are many; nulls everywhere."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        rows.append((r.choice([None, *range(convs)]), r.choice([None, 0, 1, 2, 3, 5]), r.choice([None, "", "system", "user", "assistant", "tool"]), r.choice([None, "", " \t", "Yes.", "No", "A b?", "é c\n! "])))
    return rows + rows[:9]


def by_conversation(rows, order):
    out = defaultdict(list)
    for c, *rest in rows:
        out[c].append(rest)
    return {c: sorted(x, key=lambda t: (t[0] is not None, t[0] or 0, order(t[1], t[2]))) for c, x in out.items()}


# -- repair ------------------------------------------------------------------------------------
def cheapest(symbols):
    """(cost, audit) over all ways to edit a few turns: every choice of edits and inserts is tried."""
    best = None
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    each = [[("D", "")] + ([("K", s[0]), ("R", "u"), ("R", "a")] if s else []) for s in symbols]
    for edits in itertools.product(*each):
        base = 0
        for s, (e, _) in zip(symbols, edits, strict=True):
            base += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and s.endswith("-"))
        for ins in itertools.product(gaps, repeat=len(symbols) + 1):
            cost = base + 5 * sum(map(len, ins))
            audit, roles = "", ""
            for g, (e, r) in zip(ins, [*edits, ("", "")], strict=True):
                audit, roles = audit + "I" * len(g) + e, roles + g + r
            if (best is None or (cost, audit) < best) and re.fullmatch("(s?(ua)+)?", roles):
                best = cost, audit
    return best


def test_audit_is_the_least_of_all_edits():
    a, r = repair.Automaton(), random.Random(3)
    kinds = ["", "s", "u", "a", " ", "s-", "u-", "a-", " -"]
    cases = [[], *([k] for k in kinds), *([x, y] for x in kinds for y in kinds), *([r.choice(kinds) for _ in range(3)] for _ in range(25))]
    for c in cases:
        assert a.audit(c) == cheapest(c), c
    for _ in range(300):
        a.audit([r.choice(kinds) for _ in range(60)])
    assert len(a.vectors) < 100  # the determinised automaton is small


def plain_repair(rows):
    out = []
    damaged = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged += [(c, t, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    convs = by_conversation(damaged, lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())
    for c in {r[0] for r in rows}:
        own, seen, n = convs.get(c, []), set(), defaultdict(int)
        symbols = []
        for _, role, text in own:
            kept = text.rstrip(SPACE)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else " ", fault))
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in itertools.pairwise(symbols))
        turns = [t for t, *_ in own if t is not None]

        @lru_cache(None)
        def least(i, state, inserts=0):
            """(cost, audit, lines) from turn i on; state: the initials so far, as the grammar sees them."""
            options = []
            if i == len(own) and state in "0a":
                options.append((0, "", ()))
            wanted = "user" if state != "u" else "assistant"
            if inserts < 3:
                k, a, lines = least(i, wanted[0], inserts + 1)
                options.append((k + 5, "I" + a, (wanted + ":", *lines)))
            if i < len(own):
                _, role, text = own[i]
                first, fault = symbols[i]
                k, a, lines = least(i + 1, state)
                options.append((k + 2, "D" + a, lines))
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    if first == wanted[0] or first == "s" and state == "0":
                        k, a, lines = least(i + 1, first)
                        options.append((k + late, "K" + a, (f"{role}:{text}", *lines)))
                    k, a, lines = least(i + 1, wanted[0])
                    options.append((k + late + 1, "R" + a, (f"{wanted}:{text}", *lines)))
            return min(options, key=lambda o: o[:2], default=(1 << 30, "", ()))

        cost, audit, lines = least(0, "0")
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_plain_loops(spark, seed):
    rows = made_rows(seed)
    got = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert rows_of(got) == sorted(plain_repair(rows), key=str)


def test_repair_of_nothing_of_other_columns_and_of_a_long_conversation(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, i, ("user", "assistant")[i % 2], f"Turn {i} " * (i % 5) + ".") for i in range(3000)] + [(8, 0, "user", "x" * 200_000 + ".")]
    want = sorted(plain_repair_long(rows), key=str)
    df = spark.createDataFrame([(1, *r, "a.b") for r in rows], "conv long, conv_id long, turn long, role string, text string, `key.n` string")
    got = [(r[0], *r[2:5], *r[6:8]) for r in rows_of(repair.repair(df))]
    assert [g[0] for g in got] == [7, 8] and [len(re.sub("I", "", g[5])) for g in got] == [w[1] for w in want]
    assert sum(g[4] for g in got) > 0 and got[1][5] in ("KI", "D", "")


def plain_repair_long(rows):
    n = defaultdict(int)
    for c, t, *_ in rows:
        n[c] += {0: 0, 3: 2}.get(zlib.crc32(f"{c}:{t}".encode()) % 20, 1)
    return list(n.items())


# -- trie --------------------------------------------------------------------------------------
def plain_trie(rows):
    rows = [(c, t, role or "", text or "") for c, t, role, text in rows if c is not None]
    convs = by_conversation(rows, lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16])
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple((x[1], x[2]) for x in (*convs.get(c - c % 20, [])[:h], *convs[c][h:]))
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out, rolled = [], {}
    for k in sorted(nodes, key=len, reverse=True):
        below = [rolled[x] for x in children[k]]
        saved = (len(nodes[k]) - 1) * (len([w for w in re.split("[\x20\t\n\x0b\x0c\r]+", k[-1][1]) if w]) if k else 0) + sum(b[1] for b in below)
        rolled[k] = sum(b[0] for b in below) or 1, saved
        ends = ",".join(str(c) for c in sorted(nodes[k]) if built[c] == k)
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), *rolled[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_trie_against_plain_loops(spark, monkeypatch, seed, small):
    if small:  # stretches, blocks and levels of digests that hold next to nothing
        monkeypatch.setattr(trie, "STRETCH", 1)
        monkeypatch.setattr(trie, "BLOCK", 2)
        monkeypatch.setattr(trie, "FANOUT", 2)
    rows = made_rows(seed, convs=60)
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert rows_of(got) == sorted(plain_trie(rows), key=str)


def test_trie_of_copies_prefixes_and_long_conversations(spark):
    said = [("user", "a b"), ("assistant", "c"), ("user", "d e f"), ("assistant", "g")]
    rows = [(c, i, *said[i % 4]) for c in range(1000, 1200) for i in range(4 + (c % 3 == 0))]  # two classes, one a prefix of the other
    rows += [(5, i, "user", f"own {i}") for i in range(300)] + [(6, i, "user", f"own {i}") for i in range(300)] + [(41, 0, None, None)]
    got = trie.prefix_trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", pos string"))
    assert rows_of(got) == sorted(plain_trie(rows), key=str)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
