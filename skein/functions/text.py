"""Text expressions: tokens, CJK n-grams, evidence, snippets, locators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest token in bytes (exclusive), snippet size in bytes, CJK ranges (kana, Han, Hangul).
LONGEST_TOKEN, SNIPPET = 40, 180
CJK = r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without those of LONGEST_TOKEN bytes or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < LONGEST_TOKEN))


def cjk_ngrams(text: Column) -> Column:
    """All 2-grams, then all 3-grams, of each CJK run."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK), F.lit(0))

    def grams(run: Column, n: int) -> Column:
        return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3))))


def normalised_query(text: Column) -> Column:
    """Option-like dashes are plain text."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("--"), F.lit(" "))


def expanded_query(text: Column) -> Column:
    """The normalised query followed by its CJK n-grams."""
    return F.concat_ws(" ", normalised_query(text), F.array_join(cjk_ngrams(text), " "))


def matched_terms(query: Column, body: Column) -> Column:
    """How many of the query's white-space terms the body has as substrings, case apart."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(body), t))).cast("long")


def snippet(body: Column, limit: int = SNIPPET) -> Column:
    """The whole body if it has at most ``limit`` bytes, else its longest prefix of whole characters
    within them and three dots. Texts of one-byte characters take the short way."""
    ascii_cut = F.substring(body, 1, limit)
    head = F.substring(body, 1, limit)
    fitting = F.aggregate(
        F.filter(F.split(head, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("out"), F.lit(True).alias("open")),
        lambda s, c: F.struct(
            (s["n"] + F.octet_length(c)).alias("n"),
            F.when(s["open"] & (s["n"] + F.octet_length(c) <= limit), F.concat(s["out"], c)).otherwise(s["out"]).alias("out"),
            (s["open"] & (s["n"] + F.octet_length(c) <= limit)).alias("open"),
        ),
        lambda s: s["out"],
    )
    cut = F.when(F.octet_length(head) == F.length(head), ascii_cut).otherwise(fitting)
    return F.when(F.octet_length(body) <= limit, body).otherwise(F.concat(cut, F.lit("...")))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def body_hash(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")), 256)


def context_hash(*fields: Column) -> Column:
    """sha256 of the fields joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *fields), 256)


def embedding_input(entity: Column, repo: Column, number: Column, title: Column, body: Column) -> Column:
    """What an encoder gets: where the chunk comes from, a blank line, the chunk."""
    where = F.when(entity == "issue_comment", F.concat(F.lit("Comment on issue #"), number.cast("string"), F.lit(": "), title)).otherwise(F.concat(F.lit("Issue #"), number.cast("string"), F.lit(": "), title))
    return F.concat(F.lit("Repository: "), repo, F.lit("\n"), where, F.lit("\n\n"), body)


def percent_encoded(text: Column) -> Column:
    """Every byte but unreserved ASCII characters as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def source_id(scheme: str, host: Column, kind: Column, node_id: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), host, F.lit("/"), kind, F.lit("/"), percent_encoded(node_id))


def source_kind(id_: Column) -> Column:
    return F.when(F.contains(id_, F.lit("/issue-comment/")), "issue_comment").when(F.contains(id_, F.lit("/issue/")), "issue")


def issue_number(query: Column) -> Column:
    """The number of a bare ``123``, ``#123`` or signed integer; null otherwise."""
    digits = F.regexp_extract(F.trim(query), r"^#?([+-]?[0-9]+)$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def locator(query: Column, origin: str) -> Column:
    """struct(repo, number, comment) of a canonical issue URL at ``origin``; null if anything differs:
    user information, a query string, more path, a number of zero, another fragment."""
    pattern = "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in origin) + r"/([^/?#@\s]+/[^/?#@\s]+)/issues/([0-9]+)(?:#issuecomment-([0-9]+))?$"
    part = lambda k: F.regexp_extract(F.trim(query), pattern, k)
    number = part(2).try_cast("bigint")
    return F.when(number > 0, F.struct(part(1).alias("repo"), number.alias("number"), part(3).try_cast("bigint").alias("comment")))


def last_segment_number(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1).try_cast("bigint")


def safe_name(name: Column) -> Column:
    """Lower case, if it is a name of 1 to 64 letters, digits, dashes and underscores."""
    return F.when(name.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lower(name))


#: Home folders (as JSON escapes them), authorisation headers, access tokens.
SENSITIVE = (r"/Users/|/home/|[A-Za-z]:\\\\Users\\\\", r"(?i)authorization\s*:", r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}")


def needs_redaction(text: Column) -> Column:
    """Home folders, authorisation headers, or token shapes."""
    return text.rlike(SENSITIVE[0]) | text.rlike(SENSITIVE[1]) | text.rlike(SENSITIVE[2])


def next_page(link_header: Column) -> Column:
    """The address of the page marked rel="next"; null if there is none."""
    found = F.regexp_extract(link_header, r'<([^<>]*)>\s*;[^,<>]*\brel="?next"?', 1)
    return F.when(found != "", found)


#: Wordings of error bodies, in lower case.
RATE_LIMITED = ("rate limit", "abuse detection")
PERMISSION_LOST = ("resource not accessible", "permission denied", "insufficient permission", "do not have permission", "does not have permission", "must have")


def response_reason(body: Column) -> Column:
    """What an error body's wording says: rate_limited, permission or other."""
    said = F.lower(F.coalesce(body, F.lit("")))
    says = lambda wordings: reduce(or_, (F.contains(said, F.lit(w)) for w in wordings))
    return F.when(says(RATE_LIMITED), "rate_limited").when(says(PERMISSION_LOST), "permission").otherwise("other")
