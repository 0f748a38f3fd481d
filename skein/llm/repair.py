"""Conversation structure repair by a lazily determinised weighted automaton.

A repaired conversation's role initials must read ``(s?(ua)+)?``: four grammar states. An edit keeps a
turn, gives it the role that the grammar wants, deletes it or inserts an empty turn. What the rest of a
conversation costs at least, from each of the four states, is a vector; less its smallest entry it is a
state of a deterministic automaton, whose transitions are made when first met and then cached in a table
(entries differ by no more than a few edits' costs, so there are few). One scan of table lookups from the
last turn to the first gives the cost. The trace goes the other way, over arcs that keep the cost, and
takes the ASCII-least letter at each, so it finds the least audit of all the cheapest; its steps are
cached in the table too.

Faults and role initials are found by expressions; equal turns of one conversation and turn number are
counted before anything moves, and texts are not shuffled for the audit. A task then reads its
conversations' marks in order, a few bytes a turn, and holds one letter for each turn, as the audit itself
does. Texts are shuffled once, with the audits, and hashed as they stream by: of a conversation of any
length a task never holds more than its audit. (SHA-256 of one text has no parallel form.)

Results: null roles and texts, and null ids and turns inside the damage's key, are one space. A null
conv_id is one conversation. Turns go by number, nulls first, equal ones by the MD5 of role and text.
Roles with other initials, the empty one too, fit nowhere unless renamed. Repeated rows are duplicates.
Conversations without rows after damage have zeros and an empty audit. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, written

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
INITIALS = "sua"
#: Grammar states: at the start, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_READS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_WANTED = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: b"user", ASSISTANT: b"assistant"}
_NEVER = 1 << 40
FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs once turns may be inserted first. Two in a row are the most that can pay."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_WANTED[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Automaton:
    """Symbols: "" is a turn that must go; else a turn's initial ("" for others: " "), with "-" if truncated."""

    def __init__(self) -> None:
        end = _with_inserts([0, _NEVER, _NEVER, 0])
        self.vectors, self._number = [end], {end: 0}
        self._step: dict[tuple[int, str], tuple[int, int]] = {}
        self._back: dict[tuple[int, str, int], tuple[str, int]] = {}

    def _arcs(self, symbol: str, s: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits of a turn, in ASCII order."""
        yield "D", DELETE, s
        if symbol:
            stays = TRUNCATED * symbol.endswith("-")
            if (symbol[0], s) in _READS:
                yield "K", stays, _READS[symbol[0], s]
            yield "R", REROLE + stays, _WANTED[s]

    def step(self, after: int, symbol: str) -> tuple[int, int]:
        """The vector before a turn, given that after it, and what was taken off to normalise it."""
        if (known := self._step.get((after, symbol))) is None:
            v = self.vectors[after]
            costs = _with_inserts([min(c + v[t] for _, c, t in self._arcs(symbol, s)) for s in range(4)])
            off = min(costs)
            vector = tuple(c - off for c in costs)
            if vector not in self._number:
                self._number[vector] = len(self.vectors)
                self.vectors.append(vector)
            known = self._step[after, symbol] = self._number[vector], off
        return known

    def back(self, after: int, symbol: str, s: int) -> tuple[str, int]:
        """The least letters that pass a turn from state ``s`` at least cost, inserts before it included,
        and the state behind it."""
        if (known := self._back.get((after, symbol, s))) is None:
            number, off = self.step(after, symbol)
            before, then = self.vectors[number], self.vectors[after]
            tight = [(letter, t) for letter, c, t in self._arcs(symbol, s) if c + then[t] == before[s] + off]
            if before[s] == INSERT + before[_WANTED[s]] and (not tight or tight[0][0] > "I"):
                letters, t = self.back(after, symbol, _WANTED[s])
                known = "I" + letters, t
            else:
                known = tight[0]
            self._back[after, symbol, s] = known
        return known

    def audit(self, symbols: list[str]) -> tuple[int, str]:
        """Least cost, and the least of its audits."""
        state, cost, passed = 0, 0, []
        for symbol in reversed(symbols):
            passed.append(state)
            state, off = self.step(state, symbol)
            cost += off
        s, letters = START, []
        for symbol, after in zip(symbols, reversed(passed), strict=True):
            more, s = self.back(after, symbol, s)
            letters.append(more)
        cost += self.vectors[state][START]
        return cost, "".join(letters) + {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[s]


class _Marks:
    """A conversation's faults and symbols, turn by turn."""

    def __init__(self) -> None:
        self.count, self.symbols, self.last = dict.fromkeys(FAULTS, 0), [], None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, first: bool, n: int) -> None:
        if not n:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = initial if initial in INITIALS else ""
        for k in range(n if n < 2 else 2):  # from the second equal turn on all are alike
            times = 1 if k == 0 else n - 1
            pair = (self.last or "") + initial
            self.count["illegal"] += (self.last is not None and pair not in ("su", "ua", "au")) + (times - 1) * (k > 0)
            fault = "blank" if blank else "duplicate" if k or not first else "truncated" if truncated else None
            if fault:
                self.count[fault] += times
            self.symbols += ["" if fault in ("blank", "duplicate") else (initial or " ") + "-" * (fault == "truncated")] * times
            self.last = initial

    def done(self, automaton: Automaton) -> tuple[list[int], str]:
        self.count["gaps"] = self.high - self.low + 1 - self.turns if self.turns else 0
        self.count["cost"], audit = automaton.audit(self.symbols)
        return [self.count[k] for k in FAULTS], audit


def _audited(kind: pa.DataType):
    """Over marks sorted by (conv, turn, key): a row per conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, conv, marks, out = Automaton(), None, None, []

        def rows() -> pa.RecordBatch:
            made = {"conv": pa.array([r[0] for r in out], kind)} | {f: pa.array([r[1][i] for r in out], pa.int64()) for i, f in enumerate(FAULTS)}
            return pa.RecordBatch.from_pydict(made | {"audit": pa.array([r[2] for r in out], pa.string())})

        for b in batches:
            for c, *mark in zip(*(b.column(k).to_pylist() for k in ("conv", "turn", "initial", "blank", "truncated", "first", "n")), strict=True):
                if marks is None or c != conv:
                    if marks is not None:
                        out.append((conv, *marks.done(automaton)))
                    conv, marks = c, _Marks()
                marks.add(*mark)
            if len(out) >= 1000:
                yield rows()
                out = []
        if marks is not None:
            out.append((conv, *marks.done(automaton)))
        yield rows()

    return run


class _Repaired:
    """The hash of a repaired conversation, fed with its turns in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: bytes, text: bytes) -> None:
        self.hash.update(b"\n" * self.any + role + b":")
        self.hash.update(text)
        self.any = True

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _WANTED[self.state]
            self._put(_ROLE[self.state], b"")
            self.at += 1

    def add(self, role: str, text: str, n: int) -> None:
        role, text = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        for _ in range(n):
            self._inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self.state = _READS[role[:1].decode("latin-1"), self.state]
                self._put(role, text)
            elif edit == "R":
                self.state = _WANTED[self.state]
                self._put(_ROLE[self.state], text)

    def done(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def _hashed(kind: pa.DataType):
    """Over audits and turns sorted by (conv, own, turn, key), an audit before its turns: the final rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, repaired, out = None, None, []

        def rows() -> pa.RecordBatch:
            made = {"conv_id": pa.array([r[0] for r in out], kind)} | {f: pa.array([r[1 + i] for r in out], pa.int64()) for i, f in enumerate(FAULTS)}
            last = {"audit": pa.array([r[-2] for r in out], pa.string()), "repaired_sha256": pa.array([r[-1] for r in out], pa.string())}
            return pa.RecordBatch.from_pydict(made | last)

        for b in batches:
            for own, role, text, n, *found in zip(*(b.column(k).to_pylist() for k in ("own", "role", "text", "n", "conv", *FAULTS, "audit")), strict=True):
                if own:
                    repaired.add(role, text, n)
                    continue
                if head is not None:
                    out.append((*head, repaired.done()))
                head, repaired = found, _Repaired(found[-1])
            if len(out) >= 1000:
                yield rows()
                out = []
        if head is not None:
            out.append((*head, repaired.done()))
        yield rows()

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) after damage; n: how often the row is there, 0 if it was dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    coded = rows.withColumns({"code": code, "role": spaced("role"), "text": spaced("text")})
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    n = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return coded.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), n.cast("long").alias("n"))


def _key() -> Column:
    """Orders and identifies turns of one number."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation, after the damage of ``damaged``: see ``repaired``."""
    named = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    return repaired(damaged(turns.select(*(column(c).alias(k) for k, c in named.items()))))


def repaired(rows: DataFrame) -> DataFrame:
    """``rows``: conv, turn, role, text (no nulls in those two), n (how often the row is there). A row per
    conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["conv"].dataType
    arrow, name = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[kind.typeName()], kind.simpleString()
    rows = rows.withColumn("key", _key())
    end = F.rtrim("text", F.lit(BLANKS))
    marks = rows.select("conv", "turn", "key", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*".!?")).alias("truncated"), "n")
    counted = written(marks.groupBy("conv", "turn", "key").agg(*(F.first(c).alias(c) for c in ("initial", "blank", "truncated")), F.sum("n").alias("n")), "marks")
    there = counted.filter("n > 0")
    firsts = there.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("turn")).alias("least"))
    known = counted.join(firsts, (F.col("key") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c")), "left")
    marked = known.select("conv", "turn", "key", "initial", "blank", "truncated", F.coalesce(F.col("turn").eqNullSafe(F.col("least.turn")), F.lit(False)).alias("first"), "n")
    ordered = marked.repartition("conv").sortWithinPartitions("conv", "turn", "key")
    audits = written(ordered.mapInArrow(_audited(arrow), f"conv {name}, {', '.join(f'{f} long' for f in FAULTS)}, audit string"), "audits")
    heads = audits.select("conv", F.lit(False).alias("own"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n"), *FAULTS, "audit")
    said = rows.filter("n > 0").select("conv", F.lit(True).alias("own"), "turn", "key", "role", "text", "n", *(F.lit(None).cast("long").alias(f) for f in FAULTS), F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(said).repartition("conv").sortWithinPartitions("conv", "own", "turn", "key")
    return both.mapInArrow(_hashed(arrow), f"conv_id {name}, {', '.join(f'{f} long' for f in FAULTS)}, audit string, repaired_sha256 string")
