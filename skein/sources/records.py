"""Decoding landed API pages into source rows with fixed schemas."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import body_hash, last_segment_number, source_id

_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_USER = _struct(login=_s)
ISSUE = _struct(
    node_id=_s, id=_l, number=_l, title=_s, body=_s, state=_s, labels=T.ArrayType(_struct(name=_s)), assignees=T.ArrayType(_USER), milestone=_struct(title=_s),
    user=_USER, created_at=_s, updated_at=_s, closed_at=_s, html_url=_s, pull_request=_struct(url=_s),
)
COMMENT = _struct(node_id=_s, id=_l, body=_s, user=_USER, created_at=_s, updated_at=_s, html_url=_s, issue_url=_s)
#: A landed response: what was asked, what came back, the body's items as JSON text.
PAGE = _struct(endpoint=_s, repo=_s, host=_s, page=_l, status=_l, etag=_s, link=_s, remaining=_l, items=T.ArrayType(_s), fetched_at=_s)


def landed(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Landed pages of a folder, as a table or as a stream; malformed lines are an error."""
    reader = (spark.readStream if stream else spark.read).schema(PAGE).option("mode", "FAILFAST")
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def changed(pages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Pages that bring something: not 304 or 204, and not of the tag that the cursor has."""
    known = cursors.select("endpoint", F.col("etag").alias("known_etag"))
    out = pages.filter(~F.col("status").isin(204, 304)).join(known, "endpoint", "left")
    return out.filter(F.col("etag").isNull() | ~F.col("etag").eqNullSafe(F.col("known_etag"))).drop("known_etag")


def items(pages: DataFrame, schema: T.StructType) -> DataFrame:
    """A row per item with ``item``; every page's place is kept, so times can be taken before rows are
    dropped."""
    one = pages.select("endpoint", "repo", "host", "page", "fetched_at", F.explode("items").alias("json"))
    return one.withColumn("item", F.from_json("json", schema, {"mode": "FAILFAST"})).drop("json")


def issues(decoded: DataFrame, scheme: str = "skein") -> DataFrame:
    """Issue rows; pull requests are left out."""
    i = F.col("item")
    names = lambda c, n: F.transform(F.coalesce(c, F.array().cast(f"array<struct<{n}:string>>")), lambda x: x[n])
    return decoded.filter(i["pull_request"].isNull()).select(
        source_id(scheme, F.col("host"), F.lit("issue"), i["node_id"]).alias("source_id"), F.lit("issue").alias("entity_type"), "host", "repo", i["node_id"].alias("node_id"),
        i["id"].alias("github_id"), i["number"].alias("issue_number"), F.coalesce(i["title"], F.lit("")).alias("title"), F.coalesce(i["body"], F.lit("")).alias("body"), i["state"].alias("state"),
        names(i["labels"], "name").alias("labels"), names(i["assignees"], "login").alias("assignees"), i["milestone"]["title"].alias("milestone"), i["user"]["login"].alias("author"),
        i["created_at"].alias("created_at"), i["updated_at"].alias("updated_at"), i["closed_at"].alias("closed_at"), i["html_url"].alias("canonical_url"), body_hash(i["body"]).alias("body_hash"), F.col("fetched_at").alias("indexed_at"),
    )


def comments(decoded: DataFrame, parents: DataFrame, scheme: str = "skein") -> tuple[DataFrame, DataFrame]:
    """(comment rows, deferred rows): comments whose issue is known, with its columns, and the others."""
    i = F.col("item")
    rows = decoded.select(
        source_id(scheme, F.col("host"), F.lit("issue-comment"), i["node_id"]).alias("source_id"), F.lit("issue_comment").alias("entity_type"), "host", "repo", i["node_id"].alias("node_id"),
        i["id"].alias("github_id"), last_segment_number(i["issue_url"]).alias("parent_issue_number"), F.coalesce(i["body"], F.lit("")).alias("body"), i["user"]["login"].alias("author"),
        i["created_at"].alias("created_at"), i["updated_at"].alias("updated_at"), i["html_url"].alias("canonical_url"), body_hash(i["body"]).alias("body_hash"), F.col("fetched_at").alias("indexed_at"),
    )
    known = parents.select("repo", F.col("issue_number").alias("parent_issue_number"), F.col("source_id").alias("parent_issue_source_id"), F.col("title").alias("parent_issue_title"), F.col("canonical_url").alias("parent_issue_canonical_url"))
    both = rows.join(known, ["repo", "parent_issue_number"], "left")
    return both.filter(F.col("parent_issue_source_id").isNotNull()), both.filter(F.col("parent_issue_source_id").isNull())


def all_sources(issue_rows: DataFrame, comment_rows: DataFrame) -> DataFrame:
    """Issues and comments in one table; what a kind lacks is null."""
    return issue_rows.unionByName(comment_rows, allowMissingColumns=True)


def parent_class(found: DataFrame) -> Column:
    """What a deferred comment's parent turned out to be."""
    return F.when(F.col("pull_request").isNotNull(), "pull_request").when(F.col("number").isNotNull(), "issue").otherwise("unknown")


@dataclass(frozen=True)
class Policy:
    """A repository's settings. state "all" is no filter; no source types are both."""

    repo: str
    state: str = "all"
    source_types: tuple[str, ...] = ()
    limit: int = 10
    max_age: str | None = None
    require_fresh: bool = False


@dataclass(frozen=True)
class Profile:
    name: str
    host: str
    repos: tuple[str, ...] = ()
    policies: dict[str, Policy] = field(default_factory=dict)


_PROFILE, _POLICY = {"name", "host", "repos", "policy"}, {"repo", "state", "source_types", "limit", "max_age", "require_fresh"}


def read_config(text: str) -> list[Profile]:
    """Profiles of a TOML text with ``schema_version = "skein.config.v1"``; unknown keys are errors."""
    raw = tomllib.loads(text)
    if raw.pop("schema_version", None) != "skein.config.v1" or set(raw) - {"profile"}:
        raise ValueError("config.invalid")
    out = []
    for p in raw.get("profile", []):
        if extra := set(p) - _PROFILE:
            raise ValueError(f"config.unknown_key: {', '.join(sorted(extra))}")
        policies = {}
        for x in p.get("policy", []):
            if extra := set(x) - _POLICY:
                raise ValueError(f"config.unknown_key: {', '.join(sorted(extra))}")
            policies[x["repo"]] = Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()})
        out.append(Profile(p["name"], p["host"].lower(), tuple(p.get("repos", ())), policies))
    return out


def profile_for(profiles: list[Profile], host: str, repo: str | None = None) -> Profile:
    """The only profile of a host (that lists the repository); none or several are errors."""
    fit = [p for p in profiles if p.host == host.lower() and (repo is None or repo in p.repos)]
    if len(fit) != 1:
        raise LookupError("profile.ambiguous" if fit else "profile.not_found")
    return fit[0]


def matched_profiles(requests: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, host, repo nullable) with ``profile``, the only one of the table of ``profiles`` (name, host,
    repos) that fits, and ``error`` where none does or several do. Without a repository any of the host's fits."""
    listed = profiles.select(F.lower("host").alias("h"), "name", F.explode("repos").alias("r"))
    asked = requests.select(key, F.lower("host").alias("h"), F.col("repo").alias("r"))
    named = asked.filter("r is not null").join(listed.groupBy("h", "r").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")), ["h", "r"], "left")
    whole = profiles.groupBy(F.lower("host").alias("h")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("name"))
    both = named.select(key, "n", "name").unionByName(asked.filter("r is null").join(whole, "h", "left").select(key, "n", "name"))
    found = both.select(F.col(key).alias("skein_key"), F.when(F.col("n") == 1, F.col("name")).alias("profile"), F.when(F.coalesce("n", F.lit(0)) == 0, "profile.not_found").when(F.col("n") > 1, "profile.ambiguous").alias("error"))
    return requests.join(found, requests[key] == found["skein_key"]).drop("skein_key")


def repo_of_remote(url: Column) -> Column:
    """owner/name of a git remote in any of its spellings; null for others."""
    found = F.regexp_extract(url, r"^(?:https?://[^/]+/|ssh://(?:[^@/]+@)?[^/]+/|[^@\s]+@[^:\s]+:)([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)


def trusted_origin(url: Column, host: str, path: str = "/") -> Column:
    """Whether a request to ``url`` may carry credentials: https, this very host, under this path."""
    return (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("AUTHORITY")) == host) & F.startswith(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")), F.lit(path))
