"""From hits to authoritative rows: versions, tombstones, parents, evidence, exact locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import issue_number, locator, matched_terms, snippet


def latest(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key: a maximum with partial sums, no sort of a key's versions."""
    rest = [c for c in versions.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("skein_last")
    return versions.groupBy(*keys).agg(last).select(*(c if c in keys else F.col(f"skein_last.`{c}`").alias(c) for c in versions.columns))


def active(sources: DataFrame, tombstones: DataFrame, key: str = "source_id") -> DataFrame:
    return sources.join(tombstones.select(key), key, "left_anti")


def consistent(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with their source and ``ok``: whether it exists in the very version that was indexed. Drop
    what is not ok; counting those gives the mismatches. Nothing is refilled."""
    now = sources.select("source_id", F.col("version").alias("current_version"))
    return hits.join(now, "source_id", "left").withColumn("ok", F.col("version").eqNullSafe(F.col("current_version")) & F.col("current_version").isNotNull())


def with_parent(comments: DataFrame, issues: DataFrame, on: str) -> DataFrame:
    """Comments with ``parent``, a struct of their issue; null where it is not known yet. Those rows are
    deferred, not dropped."""
    parent = issues.select(F.col(on), F.struct(*(c for c in issues.columns if c != on)).alias("parent"))
    return comments.join(parent, on, "left")


def evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (qid, query, source_id, body, version) with the chunk (source_id, version, chunk_index, body) of
    their very version that has the most matched query terms, the first such: chunk_index, matched, and
    the snippet of its text. Where no chunk of that version has a term both are null and the snippet is
    the body's."""
    parts = chunks.select("source_id", "version", "chunk_index", F.col("body").alias("skein_part"))
    scored = hits.select("qid", "query", "source_id", "version").join(parts, ["source_id", "version"]).withColumn("matched", matched_terms(F.col("query"), F.col("skein_part"))).filter("matched > 0")
    best = F.max(F.struct("matched", (-F.col("chunk_index")).alias("o"), "chunk_index", "skein_part")).alias("b")
    found = scored.groupBy("qid", "source_id").agg(best).select("qid", "source_id", "b.chunk_index", "b.matched", "b.skein_part")
    text = F.when(F.col("skein_part") != "", F.col("skein_part")).otherwise(F.col("body"))
    return hits.join(found, ["qid", "source_id"], "left").withColumn("snippet", snippet(text)).drop("skein_part")


def routed(queries: DataFrame, origin: str, text: str = "query") -> DataFrame:
    """Queries with ``route`` (exact or ranked) and what was parsed. A filter on the issue number makes
    any query an exact one."""
    url, number = locator(F.col(text), origin), issue_number(F.col(text))
    given = F.col("filter_issue") if "filter_issue" in queries.columns else F.lit(None).cast("long")
    return queries.withColumns({"locator": url, "number": F.coalesce(given, url["number"], number)}).withColumn("route", F.when(F.col("number").isNotNull(), "exact").otherwise("ranked"))


def exact(queries: DataFrame, issues: DataFrame) -> DataFrame:
    """Routed exact queries with the issue of that number (and of the locator's repository). More than
    one without a repository is an error."""
    q = queries.filter("route = 'exact'")
    hit = q.join(issues, (q["number"] == issues["issue_number"]) & (q["locator"]["repo"].isNull() | (q["locator"]["repo"] == issues["repo"])), "left")
    n = F.count("source_id").over(Window.partitionBy("qid"))
    return hit.withColumn("error", F.when(n > 1, "locator.ambiguous"))


def get_batch(requests: DataFrame, sources: DataFrame, tombstones: DataFrame, most: int = 20) -> DataFrame:
    """requests (request_id, ids array, repo nullable): an item per id, in order: input_index, source_id,
    status: ok, tombstoned, not_found, scope_mismatch. 1 to ``most`` ids are an error otherwise."""
    sized = requests.withColumn("ids", F.when(F.size("ids").between(1, most), F.col("ids")).otherwise(F.raise_error(F.lit("batch size"))))
    each = sized.select("request_id", F.col("repo").alias("wanted_repo"), F.posexplode("ids").alias("input_index", "source_id"))
    dead = tombstones.select("source_id", F.lit(True).alias("dead"))
    known = each.join(dead, "source_id", "left").join(sources, "source_id", "left")
    status = F.when(F.col("dead"), "tombstoned").when(F.col("repo").isNull(), "not_found").when(F.col("wanted_repo") != F.col("repo"), "scope_mismatch").otherwise("ok")
    return known.withColumn("status", status)


def of_generation(members: DataFrame, generations: DataFrame) -> DataFrame:
    """Chunks of embedding generations (generation_id, chunk_id, ...) with their generation's columns; rows
    of an unknown generation go."""
    return members.join(generations, "generation_id")


def aliases(transfers: DataFrame, hops: int = 8) -> DataFrame:
    """(source, target) moves, one of a source, followed to their end, ``hops`` at most: source, final, hops, looped. A
    walk that comes back to where it was ends there and is looped. Walks double their length with each join, so eight hops
    take three."""
    walk, steps = transfers.select("source", F.array("target").alias("walk")), 1
    while steps < hops:
        on = walk.select(F.col("source").alias("last"), F.col("walk").alias("more"))
        end = F.when(F.size("walk") == steps, F.element_at("walk", -1))  # a shorter walk has ended
        walk = walk.withColumn("last", end).join(on, "last", "left").select("source", F.when(F.col("more").isNull(), F.col("walk")).otherwise(F.concat("walk", "more")).alias("walk"))
        steps *= 2
    walk = walk.select("source", F.concat(F.array("source"), F.slice("walk", 1, hops)).alias("walk"))
    back = F.filter(F.sequence(F.lit(1), F.size("walk") - 1), lambda i: F.array_contains(F.slice("walk", F.lit(1), i), F.get("walk", i)))
    known = walk.withColumn("back", F.get(back, 0))
    at = F.coalesce("back", F.size("walk") - 1)
    return known.select("source", F.get("walk", at).alias("final"), at.alias("hops"), F.col("back").isNotNull().alias("looped"))
