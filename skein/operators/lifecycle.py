"""Ingest, purge and derived-state operators on tables that are rewritten, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import body_hash
from skein.operators.resolve import latest


def upsert(current: DataFrame, arriving: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The next snapshot: each key's newest row; of equal rows one stays, so a repeated batch changes
    nothing."""
    both = current.withColumn("skein_new", F.lit(0)).unionByName(arriving.withColumn("skein_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*map(F.col, order), F.col("skein_new")]).drop("skein_new")


def upsert_counts(current: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """One row: added, updated, unchanged keys of a batch, by body hash."""
    old = current.select(*keys, body_hash(F.col("body")).alias("old"))
    new = arriving.select(*keys, body_hash(F.col("body")).alias("new")).dropDuplicates(keys)
    both = new.join(old, keys, "left")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("old") != F.col("new")).alias("updated"), F.count_if(F.col("old") == F.col("new")).alias("unchanged"))


def watermarks(rows: DataFrame, endpoint: str, ts: str) -> DataFrame:
    """The newest time of each endpoint; taken before any row is dropped."""
    return rows.groupBy(endpoint).agg(F.max(ts).alias("watermark"))


def combined_cursors(cursors: DataFrame) -> DataFrame:
    """Open endpoints count with their newest cursor, history ones with their oldest, null before all."""
    history = F.col("endpoint").startswith("history:")
    rows = cursors.withColumn("kind", F.when(history, "history").otherwise("open"))
    missing = F.count_if(F.col("cursor").isNull()) > 0
    return rows.groupBy("kind").agg(F.when(F.first("kind") == "open", F.max("cursor")).when(missing, F.lit(None)).otherwise(F.min("cursor")).alias("cursor"))


def held_watermark(rows: DataFrame, partition: str, ts: str, deferred: Column, tie: str) -> DataFrame:
    """The newest time before the first deferred row of each partition, in order of time; later rows are
    stored all the same. Null if the first row is deferred. Least and greatest values, no sort."""
    place = F.struct(ts, tie)
    marked = rows.withColumn("skein_place", place)
    first = marked.groupBy(partition).agg(F.min(F.when(deferred, F.col("skein_place"))).alias("skein_first"))
    held = F.coalesce(F.col("skein_place") >= F.col("skein_first"), F.lit(False))
    both = marked.join(first, partition)
    return both.groupBy(partition).agg(F.max(F.when(~held, F.col(ts))).alias("watermark"), F.count_if(held).alias("behind"))


def replaced_chunks(chunks: DataFrame, made: DataFrame, versions: DataFrame) -> DataFrame:
    """The chunk table after the versions (source_id, version) were cut anew into ``made``: all their old
    chunks go, also where there are no new ones."""
    return chunks.join(versions.select("source_id", "version"), ["source_id", "version"], "left_anti").unionByName(made)


def stale_versions(chunks: DataFrame, versions: DataFrame, fingerprint: str) -> DataFrame:
    """Versions (source_id, version) that have no chunks, or any that another chunker made."""
    whole = chunks.groupBy("source_id", "version").agg(F.bool_and(F.col("fingerprint") == fingerprint).alias("ok")).filter("ok")
    return versions.join(whole, ["source_id", "version"], "left_anti")


def coalesced(tasks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each source's last pending operation."""
    return latest(tasks, [key], [F.col(c) for c in order])


def deleted_children(active: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """Known children of the fetched parents that the fetch did not bring."""
    parents = fetched.select(keys[0]).distinct()
    return active.join(parents, keys[0], "left_semi").join(fetched.select(*keys), keys, "left_anti")


def removed_repos(known: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Repositories that the policy no longer lists; names compare without case."""
    return known.withColumn("skein_k", F.lower("repo")).join(allowlist.select(F.lower("repo").alias("skein_k")), "skein_k", "left_anti").drop("skein_k")


def subsumed_purges(targets: DataFrame) -> DataFrame:
    """Purge targets (kind, repo, source_id) without threads whose whole repository goes too. Single
    sources are kept."""
    repos = targets.filter("kind = 'repo'").select(F.lower("repo").alias("skein_k"))
    threads = targets.filter("kind = 'thread'").withColumn("skein_k", F.lower("repo")).join(repos, "skein_k", "left_anti").drop("skein_k")
    return targets.filter("kind != 'thread'").unionByName(threads)


def purged(table: DataFrame, targets: DataFrame) -> DataFrame:
    """``table`` (repo, thread_id, source_id, ...) without what the targets cover."""
    by = lambda kind, c: targets.filter(F.col("kind") == kind).select(F.lower("repo").alias("skein_k") if c == "repo" else F.col("source_id").alias(c)).distinct()
    left = table.withColumn("skein_k", F.lower("repo")).join(by("repo", "repo"), "skein_k", "left_anti").drop("skein_k")
    return left.join(by("thread", "thread_id"), "thread_id", "left_anti").join(by("source", "source_id"), "source_id", "left_anti").select(*table.columns)


def missing_chunks(chunks: DataFrame, staged: DataFrame) -> DataFrame:
    """Chunks of a snapshot without an embedding for their very text and context."""
    return chunks.join(staged.select("chunk_id", "context_hash"), ["chunk_id", "context_hash"], "left_anti")


def reconciliation_candidates(sources: DataFrame, now: Column, window_days: int = 7, full: bool = False, repo: str | None = None) -> DataFrame:
    out = sources if full else sources.filter(F.col("updated_at") >= now - F.make_dt_interval(days=F.lit(window_days)))
    return out if repo is None else out.filter(F.col("repo") == repo)


def status_counts(sources: DataFrame, tombstones: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: issues, comments, tombstones, pending tasks."""
    n = sources.agg(F.count_if(F.col("entity_type") == "issue").alias("issues"), F.count_if(F.col("entity_type") == "issue_comment").alias("comments"))
    return n.crossJoin(tombstones.agg(F.count("*").alias("tombstones"))).crossJoin(tasks.agg(F.count("*").alias("dirty_tasks")))


def retained(generations: DataFrame, now: Column, building_hours: int = 24, ready_days: int = 7) -> DataFrame:
    """Generations to delete: builds and ready ones that are too old and not active."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("changed_at").cast("timestamp"))
    old = ((F.col("state") == "building") & (age > 3600 * building_hours)) | ((F.col("state") == "ready") & (age > 86400 * ready_days))
    return generations.filter(old & ~F.col("active"))
