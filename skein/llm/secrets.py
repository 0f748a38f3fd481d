"""Secrets in whole texts, and whose they are, in DataFrame functions only.

Three base patterns find assignments, access keys and long hexadecimal strings. Beside them every
long run of key-like characters that holds letters and digits is a candidate. The hashes of all values,
base finds' too, are counted over the whole corpus by distinct repositories and owners: a value that
several owners, or very many repositories, have is a widely copied example, whether its passage was copied
with it or not; one that hardly anyone else has looks like a live credential of its owner. Every find is
classed so. Live-looking candidates are reported beside the base finds, which always are, as kind ``owned``.

Counts are taken by repository first, then by owner, then by value, each with partial sums before its
shuffle, so no task ever gets all rows of a common value; only hashes are shuffled, texts are not.

``documents`` names no owners: its ``source`` stands for the owner and the document for the repository.

Results: a null text is empty and has no finds. A null repository or owner counts as one of its own.
Repeated rows are each reported; they count once. Without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, let, written

#: The base patterns by kind, in the order of report, with least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Candidates of the method: runs of at least so many key characters with letters and digits.
OWNED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: Owners, or repositories of whomever, from which on a value counts as widely copied.
WIDE_OWNERS, WIDE_REPOS = 3, 50
#: Steps of a block of a scan.
BLOCK = 128

_SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def _scan(n: Column, value, join, emit, kind: str) -> Column:
    """The arrays ``emit(state, i)`` for i from 0 to ``n`` - 1, one at least, end to end, where state joins 0 and
    the integers ``value(0)`` to ``value(i - 1)`` (``join``: associative). An array grows by being copied, so
    it is made in blocks of BLOCK steps, which first get the states that they start from."""
    steps = lambda b: F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1)
    grown = lambda s, v, more: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], more).alias("out"))
    start = lambda at, of: F.struct(at.alias("at"), F.array().cast(of).alias("out"))
    totals = F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), lambda b: F.aggregate(steps(b), F.lit(0), lambda s, i: join(s, value(i))))
    states = F.aggregate(totals, start(F.lit(0), "array<int>"), lambda s, v: grown(s, v, F.array(s["at"])), lambda s: s["out"])
    block = lambda at, b: F.aggregate(steps(b), start(at, kind), lambda s, i: grown(s, value(i), emit(s["at"], i)), lambda s: s["out"])
    return F.flatten(F.transform(states, block))


def _finds(text: Column, pattern: str, rank: int, value=lambda m: m, good=lambda m: F.lit(True)) -> Column:
    """Leftmost matches that do not overlap, with code point positions: what stands between matches
    and the matches' lengths add up to them."""
    parts = F.split(text, pattern, -1)

    def located(x: Column) -> Column:
        between, match = lambda i: F.get(x["p"], i), lambda i: F.get(x["m"], i)

        def spans(at: Column, i: Column) -> Column:
            begin = at + F.length(between(i))
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(match(i))).alias("stop"), value(match(i)).alias("value"))
            return F.when(good(match(i)), F.array(span)).otherwise(F.array().cast(_SPAN))

        return _scan(F.size(x["m"]), lambda i: F.length(between(i)) + F.length(match(i)), lambda a, b: a + b, spans, _SPAN)

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), parts.alias("p")), located)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _base(text: Column) -> Column:
    """Base finds by start, then kind."""
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    return F.array_sort(
        F.concat(
            _finds(text, ASSIGN, 0, assigned, lambda m: F.length(assigned(m)) >= LEAST_VALUE),
            F.when(text.contains("AKIA"), _finds(text, ACCESS, 1)).otherwise(F.array().cast(_SPAN)),
            _finds(text, HEX, 2),
        )
    )


def _owned(text: Column, base: Column) -> Column:
    """Further candidates: key-like runs that touch no base find."""
    runs = _finds(text, OWNED, 3, good=lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    event = lambda at, rank, span: F.struct(at.alias("at"), F.lit(rank).alias("rank"), span.alias("span"))

    def apart(both: Column) -> Column:
        """In order of base finds' starts and runs' ends: a run is free if no base find that starts before its
        end ends after its start."""
        e = lambda i: F.get(both, i)
        free = lambda stop, i: F.when((e(i)["rank"] == 0) & (stop <= e(i)["span"]["start"]), F.array(e(i)["span"])).otherwise(F.array().cast(_SPAN))
        return _scan(F.size(both), lambda i: F.when(e(i)["rank"] == 1, e(i)["span"]["stop"]).otherwise(0), F.greatest, free, _SPAN)

    def among(some: Column) -> Column:
        both = F.concat(F.transform(some, lambda c: event(c["stop"], 0, c)), F.transform(base, lambda b: event(b["start"], 1, b)))
        return F.when((F.size(some) > 0) & (F.size(base) > 0), let(F.array_sort(both), apart)).otherwise(some)

    return let(runs, among)


def _marked(text: Column) -> Column:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return let(_base(whole), lambda b: F.concat(b, _owned(whole, b)))


def _said(spans: Column) -> Column:
    kind = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["rank"]), s["start"], s["stop"])), ",")


def owner_counts(candidates: DataFrame) -> DataFrame:
    """(hash, owner, repo) rows -> (hash, n_repos, n_owners): over the whole corpus. No step keeps
    a set of owners in memory."""
    repos = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("n"))
    return repos.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def _decided(some: DataFrame) -> DataFrame:
    """Of the rows ``some`` (skein_row, skein_repo, skein_owner, skein_finds) that have finds: skein_row,
    skein_spans (the finds to report), skein_live and skein_wide (how many finds look live, and are widely copied),
    skein_owners and skein_repos (the most that any of its values has)."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = some.select("skein_row", key("skein_repo").alias("repo"), key("skein_owner").alias("owner"), F.explode("skein_finds").alias("find"))
    each = each.withColumn("hash", F.substring(F.sha2("find.value", 256), 1, 32))
    wide = (F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repos") >= WIDE_REPOS)
    reported = F.array_sort(F.collect_list(F.when(~wide | (F.col("find.rank") < 3), F.col("find"))))
    return each.join(owner_counts(each), "hash").groupBy("skein_row").agg(
        reported.alias("skein_spans"), F.count_if(~wide).alias("skein_live"), F.count_if(wide).alias("skein_wide"), F.max("n_owners").alias("skein_owners"), F.max("n_repos").alias("skein_repos")
    )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex (long), base_sha256, spans, n_owned (long; finds of
    the method), n_live, n_wide (of all finds, those that look live, and those that are widely copied), n_owners,
    n_repos (the most that any value of the document has; 0 without finds). Only named columns are read."""
    named = {"skein_row": F.monotonically_increasing_id(), "doc_id": F.col(id_col), "skein_repo": F.col(repo_col), "skein_owner": F.col(owner_col), "skein_finds": _marked(F.col(text_col))}
    seen = written(docs.select(*(c.alias(k) for k, c in named.items())), "secrets")
    counts = ("skein_live", "skein_wide", "skein_owners", "skein_repos")
    none = seen.filter(F.size("skein_finds") == 0).select("doc_id", F.col("skein_finds").alias("skein_spans"), *(F.lit(0).cast("long").alias(c) for c in counts))
    found = seen.filter(F.size("skein_finds") > 0)
    some = found.select("skein_row", "doc_id").join(_decided(found), "skein_row").select(*none.columns)
    n = lambda r: F.size(F.filter("skein_spans", lambda s: s["rank"] == r)).cast("long")
    base = F.filter("skein_spans", lambda s: s["rank"] < 3)
    return none.unionByName(some).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("skein_spans")).alias("spans"), n(3).alias("n_owned"),
        *(F.col(c).alias(c.replace("skein_", "n_")) for c in counts),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` in place of the spans, one at least, overlapping ones as one. The text is cut as UTF-32, where
    a character's place is known, so the work is linear in the text."""
    kind, piece = "array<struct<a:int,b:int>>", lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    at = lambda i: F.get(spans, i)
    before = lambda stop, i: F.when(at(i)["start"] >= stop, piece(stop, at(i)["start"])).otherwise(F.array().cast(kind))
    end = F.lit((1 << 29) - 1)
    kept = F.concat(_scan(F.size(spans), lambda i: at(i)["stop"], F.greatest, before, kind), piece(F.array_max(F.transform(spans, lambda x: x["stop"])), end))
    head = F.encode(F.lit("x"), "UTF-32")  # a mark of byte order at a piece's start would else be lost
    cut = lambda raw: F.transform(kept, lambda p: F.substring(F.decode(F.concat(head, F.substring(raw, 4 * p["a"] + 1, 4 * (p["b"] - p["a"]))), "UTF-32"), F.lit(2), end))
    return F.array_join(let(F.encode(text, "UTF-32"), cut), mask)


def redact_documents(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each reported find's text replaced by ``mask`` and ``n_chars_col`` renewed where
    the text changed. Texts are scanned once; the finds are written beside the rows, whose columns may
    have any names, and rows without finds, the bulk, pass through unshuffled."""
    columns = docs.columns
    marked = docs.select(F.monotonically_increasing_id().alias("skein_row"), F.struct(*map(column, columns)).alias("skein_doc"), _marked(column(text_col)).alias("skein_finds"))
    marked = written(marked, "finds")
    of = lambda c: F.col("skein_doc").getField(c)
    plain = marked.filter(F.size("skein_finds") == 0).select(*(of(c).alias(c) for c in columns))
    some = marked.filter(F.size("skein_finds") > 0).withColumns({"skein_repo": of(repo_col), "skein_owner": of(owner_col)})
    decided = some.select("skein_row", "skein_doc").join(_decided(some.select("skein_row", "skein_repo", "skein_owner", "skein_finds")), "skein_row")
    text = F.when(F.size("skein_spans") > 0, _masked(of(text_col), F.col("skein_spans"), mask)).otherwise(of(text_col))
    redone = decided.select("skein_doc", text.alias("skein_text"))
    new = {text_col: F.col("skein_text")}
    if n_chars_col in columns:
        new[n_chars_col] = F.length("skein_text").cast(docs.schema[n_chars_col].dataType)
    return plain.unionByName(redone.select(*(new.get(c, of(c)).alias(c) for c in columns)))
