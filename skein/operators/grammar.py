"""Queries with operators, evaluated as trees over a whole table of queries.

``+must``, ``-must_not``, ``field:term``, ``term^boost``, ``"a phrase"``, ``a AND b``, ``a OR b``, ``NOT a`` and
brackets, all of which combine (``title:"a b"^2``, ``-(a b)``, ``body:(a OR b)``). AND binds tighter than OR, and
both tighter than standing side by side; terms side by side are optional unless they are marked. A group is met
where all its required parts are, none of its forbidden ones, and one of the optional ones if nothing is required;
its score is the sum of the parts that are met.

A helper reads each query's text into its nodes. Everything else is joins and sums: the nodes' terms meet the
postings once, which are dealt by source, and from there on every step groups by source and something more, so
nothing is shuffled again. A phrase's terms bring the positions of their postings, shifted by their place in the
phrase; what all have in common are the places where it stands. Groups are then met level by level by counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import LONGEST_TOKEN, normalised_query, tokens
from skein.operators import bulk
from skein.operators.lexical import FEW_TERMS, Index, few, held, looked_up, ranked, term_score

_WORD = re.compile(r"([+-]?)(?:([A-Za-z_]+):)?(.*?)(?:\^([0-9]+(?:\.[0-9]+)?))?", re.S)
_OPENS = re.compile(r'([+-]?)(?:([A-Za-z_]+):)?(?=["(])')
_BOOST = re.compile(r"\^([0-9]+(?:\.[0-9]+)?)")
_OCCUR = {"+": "must", "-": "not", "": "should"}
#: Brackets inside brackets, at most; beyond it a query is invalid.
MOST_NESTED = 50

NODES = "node int, parent int, depth int, occur string, field string, said string, phrase boolean, boost double, required int"


class Invalid(ValueError):
    """The query cannot be parsed."""


def _lexemes(text: str, fields: frozenset[str]) -> Iterator[tuple]:
    """("(", sign, field), (")", boost), ("op", name), or ("said", sign, field, text, phrase, boost)."""
    at = 0

    def boost() -> float:
        nonlocal at
        m = _BOOST.match(text, at)
        at = m.end() if m else at
        return float(m[1]) if m else 1.0

    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if m := _OPENS.match(text, at):
            sign, field = m[1], m[2]
            at = m.end()
            if field and field not in fields:  # a name that is no field is text
                yield "said", sign, None, field, False, 1.0
                sign, field = "", None
            if text[at] == "(":
                at += 1
                yield "(", sign, field
                continue
            end = text.find('"', at + 1)
            if end < 0:
                raise Invalid
            said, at = text[at + 1 : end], end + 1
            yield "said", sign, field, said, True, boost()
        elif text[at] == ")":
            at += 1
            yield ")", boost()
        else:
            word = re.compile(r'[^\s()"]+').match(text, at)[0]
            at += len(word)
            sign, field, said, raised = _WORD.fullmatch(word).groups()
            if word in ("AND", "OR", "NOT"):
                yield "op", word
            elif not said and (sign or field) and not raised:
                raise Invalid
            elif field in fields:
                if not said:
                    raise Invalid
                yield "said", sign, field, said, False, float(raised or 1)
            else:
                yield "said", sign, None, f"{field} {said}" if field else said, False, float(raised or 1)


def _has_tokens(said: str) -> bool:
    return any(len(w.encode()) < LONGEST_TOKEN for w in "".join(c if c.isalnum() else " " for c in said.lower()).split())


class _Parser:
    """Trees: (occur, field, text, phrase, boost) of a leaf, (occur, parts, boost) of a group, None of nothing."""

    def __init__(self, text: str, fields: Iterable[str]):
        self.lexemes = [*_lexemes(text, frozenset(fields)), ("end",)]
        self.at = 0

    def _kind(self) -> tuple:
        x = self.lexemes[self.at]
        return x if x[0] == "op" else x[:1]

    def whole(self) -> tuple | None:
        parts = self._side_by_side(None, 0)
        if self._kind() != ("end",):
            raise Invalid
        return _group("should", parts, 1.0)

    def _side_by_side(self, field: str | None, depth: int) -> list:
        if depth > MOST_NESTED:
            raise Invalid
        parts = []
        while self._kind() not in ((")",), ("end",)):
            parts.append(self._either(field, depth))
        return parts

    def _either(self, field: str | None, depth: int) -> tuple | None:
        parts = [self._both(field, depth)]
        while self._kind() == ("op", "OR"):
            self.at += 1
            parts.append(self._both(field, depth))
        return parts[0] if len(parts) == 1 else _group("should", parts, 1.0)

    def _both(self, field: str | None, depth: int) -> tuple | None:
        parts = [self._one(field, depth)]
        while self._kind() == ("op", "AND"):
            self.at += 1
            parts.append(self._one(field, depth))
        return parts[0] if len(parts) == 1 else _group("should", [p and ("must" if p[0] == "should" else p[0], *p[1:]) for p in parts], 1.0)

    def _one(self, field: str | None, depth: int) -> tuple | None:
        kind, *rest = self.lexemes[self.at]
        self.at += 1
        if kind == "op" and rest == ["NOT"]:
            inner = self._one(field, depth)
            return inner and ("not", *inner[1:])
        if kind == "said":
            sign, own, said, phrase, boost = rest
            return (_OCCUR[sign], own or field, said, phrase, boost) if _has_tokens(said) else None
        if kind != "(":
            raise Invalid
        parts = self._side_by_side(rest[1] or field, depth + 1)
        if not parts or self.lexemes[self.at][0] != ")":
            raise Invalid
        boost = self.lexemes[self.at][1]
        self.at += 1
        return _group(_OCCUR[rest[0]], parts, boost)


def _group(occur: str, parts: list, boost: float) -> tuple | None:
    """A group of one part is that part; parts without a token are none."""
    parts = [p for p in parts if p]
    if len(parts) == 1 and parts[0][0] != "not":
        return (occur, *parts[0][1:-1], parts[0][-1] * boost)
    return (occur, parts, boost) if parts else None


def parse(text: str, fields: Iterable[str]) -> list[tuple]:
    """A query's nodes with the columns of NODES, the root first; none if it has no token. Raises Invalid."""
    tree = _Parser(text, fields).whole()
    if tree is None:
        return []
    if len(tree) == 5:
        tree = "should", [tree], 1.0
    out, todo = [], [(tree, -1, 0, 1.0)]
    while todo:
        part, parent, depth, boost = todo.pop()
        node = len(out)
        boost *= part[-1]
        if len(part) == 5:
            out.append((node, parent, depth, part[0], part[1], part[2], part[3], boost, 0))
        else:
            out.append((node, parent, depth, part[0], None, None, None, boost, sum(p[0] == "must" for p in part[1])))
            todo += [(p, node, depth + 1, boost) for p in reversed(part[1])]
    return out


def plain(text: Column) -> Column:
    """Text as a query of optional terms: without what the grammar reads as operators."""
    signs = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!\S)[+-]+|[\"^:()]", " ")
    return F.regexp_replace(signs, r"(?<!\S)(?:AND|OR|NOT)(?!\S)", " ")


def query_error(text: Column, fields: list[str]) -> Column:
    """``validation.invalid_query`` for an operator, a sign, a field or brackets without a term, and for quotes or
    brackets that stand alone. (``plain`` texts without a sign, quote, colon, bracket or operator need no look.)"""

    def said(x: str) -> str | None:
        try:
            parse(x, fields)
        except Invalid:
            return "validation.invalid_query"
        return None

    checked = F.udf(said, "string", useArrow=True)
    return checked(normalised_query(text))


def nodes(queries: DataFrame, text: Column, fields: list[str], qid: str = "qid") -> DataFrame:
    """qid and NODES of the valid queries, and ``terms`` of the leaves. A word of several tokens looks for each
    of them; a phrase for all, one after another."""
    rows = queries.select(F.col(qid).alias("qid"), normalised_query(text).alias("query"))
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [{"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string()) for c in NODES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            for k, q in enumerate(b.column("query").to_pylist()):
                try:
                    found = parse(q, fields)
                except Invalid:
                    continue
                at += [k] * len(found)
                made += found
            columns = list(zip(*made, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["qid", *names])

    return rows.mapInArrow(run, f"qid {rows.schema['qid'].dataType.simpleString()}, {NODES}").withColumn("terms", F.when(F.col("said").isNotNull(), tokens(F.col("said"))))


def scores(index: Index, parsed: DataFrame, profile: str = "production_v1", allowed: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """(qid, source_id, score) of the sources that meet a query's tree. ``parsed``: see ``nodes``; ``allowed``
    (source_id) restricts what is scored; ``fields`` are those that a term without one is looked for in."""
    parsed, small = held(parsed)
    leaves = parsed.filter("said is not null")
    shape = parsed.agg(F.max("depth"), F.max(F.coalesce("phrase", F.lit(False)))).first()
    if shape[0] is None:
        return parsed.select("qid", F.lit(None).cast(index.postings.schema["source_id"].dataType).alias("source_id"), F.lit(None).cast("double").alias("score")).limit(0)
    each = leaves.select("qid", "node", "parent", "depth", "occur", F.col("field").alias("asked"), "phrase", "boost", F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term"))
    asked, own, _ = looked_up(index, each, profile, fields)
    own = own.select("term", "field", "source_id", "tf", "length", "average", "factor", *(["positions"] if shape[1] else []))
    if allowed is not None:
        own = own.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
    hit = own.join(asked, "term").filter(F.col("asked").isNull() | (F.col("asked") == F.col("field")))
    node = ("source_id", "qid", "node", "parent", "depth", "occur")
    one = F.col("factor") * term_score(F.col("tf"), F.col("length"), F.col("average")) * F.col("boost")
    # a word of several tokens is met when all are, if it is required, else when one is
    strict = hit.filter("not phrase and occur <> 'should'").groupBy(*node, "n").agg(F.sum(one).alias("w"), F.count_distinct("i").alias("met")).filter("occur <> 'must' or met = n").select(*node, "w")
    # of optional words only the sum counts, and that there is one: they are summed for their group at once, not kept one by one
    loose = hit.filter("not phrase and occur = 'should'").groupBy("source_id", "qid", "parent", "depth", "occur").agg(F.sum(one).alias("w")).withColumn("node", F.lit(None).cast("int")).select(*node, "w")
    kinds = {r["occur"] for r in leaves.filter("not phrase").select("occur").distinct().collect()}
    words = loose if kinds == {"should"} else strict.unionByName(loose)
    found = words
    if shape[1]:
        shifted = F.transform("positions", lambda p: p - F.col("i"))
        each = hit.filter("phrase").groupBy(*node, "field", "n", "boost", "length", "average").agg(F.sum("factor").alias("factor"), F.collect_list(shifted).alias("places"))  # an array per term of the phrase
        whole = each.filter(F.size("places") == F.col("n")).withColumn("tf", F.size(F.reduce("places", F.get("places", 0), F.array_intersect)))
        found = words.unionByName(whole.filter("tf > 0").groupBy(*node).agg(F.sum(one).alias("w")))
    groups = parsed.filter("said is null").select("qid", F.col("node").alias("group"), F.col("parent").alias("above"), F.col("occur").alias("as"), "required")
    groups = F.broadcast(groups) if small else few(groups)  # FEW_TERMS rows at most
    for depth in range(shape[0], 0, -1):
        here = found.filter(F.col("depth") == depth)
        is_ = lambda x: F.count_if(F.col("occur") == x)
        met = here.groupBy("source_id", "qid", F.col("parent").alias("group")).agg(F.sum(F.when(F.col("occur") != "not", F.col("w"))).alias("w"), is_("must").alias("met"), is_("not").alias("broken"), is_("should").alias("any"))
        good = met.join(groups, ["qid", "group"]).filter("broken = 0 and met = required and (required > 0 or any > 0)")
        rolled = good.select("source_id", "qid", F.col("group").alias("node"), F.col("above").alias("parent"), F.lit(depth - 1).alias("depth"), F.col("as").alias("occur"), F.coalesce("w", F.lit(0.0)).alias("w"))
        found = found.filter(F.col("depth") < depth).unionByName(rolled)
    return found.select("qid", "source_id", F.col("w").alias("score"))


def best(index: Index, parsed: DataFrame, limit: int, profile: str = "production_v1", allowed: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """The best ``limit`` of ``scores``, ranked: qid, source_id, score, rank. Of more than a few nodes, queries of optional words only, whose
    scores are plain sums, are taken in bulk; the others go as trees. ``parsed`` is read several times."""
    if limit < 1 or parsed.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        return ranked(scores(index, parsed, profile, allowed, fields), limit)
    other = (F.col("said").isNull() & (F.col("depth") > 0)) | (F.col("said").isNotNull() & (F.col("phrase") | (F.col("occur") != "should") | (F.col("boost") <= 0)))
    trees = parsed.filter(other).select("qid").distinct()
    words = parsed.join(trees, "qid", "left_anti").filter("said is not null").select("qid", F.col("field").alias("asked"), F.explode("terms").alias("term"), "boost")
    plain_ones = bulk.best(index, words, limit, profile, allowed, fields)
    if trees.isEmpty():
        return plain_ones
    return plain_ones.unionByName(ranked(scores(index, parsed.join(trees, "qid", "left_semi"), profile, allowed, fields), limit).select(*plain_ones.columns))
