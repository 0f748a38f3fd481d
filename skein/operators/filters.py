"""Hard filters, applied before scoring and checked again on the resolved rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("issue", "issue_comment")


@dataclass(frozen=True)
class Filters:
    """Conjunctive. None: no clause. Labels: all of them. Source types: any of them; () matches nothing."""

    repo: str | None = None
    issue_number: int | None = None
    author: str | None = None
    state: str | None = None
    labels: tuple[str, ...] = ()
    source_types: tuple[str, ...] | None = field(default=None)


def has_all(have: Column, want: Column) -> Column:
    return F.size(F.array_except(want, have)) == 0


def predicate(f: Filters, comments: bool = True) -> Column:
    """Comments have no state or labels: with such a filter they do not match."""
    out = F.lit(True)
    for name in ("repo", "issue_number", "author"):
        if (v := getattr(f, name)) is not None:
            out = out & (F.col(name) == v)
    if f.state not in (None, "all"):
        out = out & (F.col("state") == f.state)
    if f.labels:
        out = out & has_all(F.col("labels"), F.array(*map(F.lit, f.labels)))
    if f.source_types is not None and set(f.source_types) != set(KINDS):
        out = out & (F.col("entity_type").isin(*f.source_types) if f.source_types else F.lit(False))
    if comments and (f.state not in (None, "all") or f.labels):
        out = out & (F.col("entity_type") == "issue")
    return out


def allowed(sources: DataFrame, f: Filters) -> DataFrame:
    return sources.filter(predicate(f)).select("source_id")


def effective(argument: Column, policy: Column, default: Column | None = None) -> Column:
    """An argument goes before the policy's default, and that before the general one."""
    return F.coalesce(argument, policy) if default is None else F.coalesce(argument, policy, default)


def effective_limit(argument: Column, policy: Column) -> Column:
    value = effective(argument, policy, F.lit(10))
    return F.when(value > 0, value).otherwise(F.raise_error(F.lit("limit must be positive")).cast("int"))


def scope_error(allowlist: Column, repo: Column) -> Column:
    """A code where a repository is asked for that the profile does not list; names compare exactly."""
    return F.when(repo.isNotNull() & ~F.array_contains(allowlist, repo), "scope.not_allowed")


#: Characters from which on a raw value must not stand in what is published; those of a stretch of a payload.
RAW, STRETCH = 16, 512


def escaped(payloads: DataFrame, values: DataFrame) -> DataFrame:
    """payloads (payload_id, payload) that hold a raw value (value) of RAW characters or more: payload_id.
    Payloads are cut at every character, stretch by stretch, and the pieces' hashes meet those of the values' beginnings;
    only where they agree the payload itself is looked at. No pair is compared that shares no beginning."""
    hashed = lambda x: F.xxhash64(x)
    heads = values.filter(F.length("value") >= RAW).select("value", hashed(F.left("value", F.lit(RAW))).alias("head")).distinct()
    long = payloads.filter(F.length("payload") >= RAW)
    pieces = F.transform(F.sequence(F.lit(1), F.length("payload") - RAW + 1, F.lit(STRETCH)), lambda at: F.substring("payload", at, F.lit(STRETCH + RAW - 1)))
    cut = lambda piece: F.transform(F.sequence(F.lit(1), F.length(piece) - RAW + 1), lambda i: hashed(F.substring(piece, i, F.lit(RAW))))
    windows = long.select("payload_id", F.explode(pieces).alias("piece")).select("payload_id", F.explode(F.array_distinct(cut(F.col("piece")))).alias("head"))
    hits = windows.join(heads.select("head").distinct(), "head", "left_semi").distinct()
    return hits.join(long, "payload_id").join(heads, "head").filter(F.contains("payload", "value")).select("payload_id").distinct()
