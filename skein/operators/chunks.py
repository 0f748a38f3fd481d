"""Markdown-aware chunks of a bounded number of tokens, and fixed windows."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target and overlap in tokens, how far from the target a boundary is looked for.
TARGET, OVERLAP, REACH = 900, 135, 200
VERSION = "markdown-token-v3"
#: The default tokeniser: runs of letters and digits, and single other characters that are not white.
TOKEN = re.compile(r"\w+|[^\w\s]")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"\s*(#{1,6})(?!#)(\s.*)", re.DOTALL)
SCHEMA = "chunk_index int, token_start int, token_end int, byte_start int, byte_end int, heading_path array<string>, body string"
Spans = list[tuple[int, int]]


def fingerprint(tokeniser: str) -> str:
    """The chunker's version and a digest of all that decides where its chunks lie: each field with its
    length (8 bytes, little-endian) before it."""
    fields = ("skein.chunks", VERSION, f"{TARGET}/{OVERLAP}/{REACH}", tokeniser)
    return f"{VERSION}:{hashlib.sha256(b''.join(len(x.encode()).to_bytes(8, 'little') + x.encode() for x in fields)).hexdigest()}"


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a line that starts, however far indented, with one to six marks and white space."""
    found = _HEADING.match(line)
    return (len(found[1]), found[2].strip()) if found else None


class Layout:
    """Where a text's lines begin and what they are: fences, boundaries, headings (end of line, level,
    title; also such within fences)."""

    def __init__(self, text: str):
        self.text = text
        self.fences, self.headings, boundaries = [], [], {0, len(text)}
        at, open_ = 0, None
        for line in text.split("\n"):
            stop = min(at + len(line) + 1, len(text))
            bare = line.rstrip("\r")
            found = heading(bare)
            if found:
                self.headings.append((stop, *found))
            if mark := _FENCE.match(bare):
                boundaries |= {at, stop}
                if open_ is None:
                    open_ = (at, mark[1])
                elif mark[1][0] == open_[1][0] and len(mark[1]) >= len(open_[1]):
                    self.fences.append((open_[0], stop))
                    open_ = None
            elif open_ is None:
                if found:
                    boundaries |= {at, stop}
                if not bare.strip() and at < len(text):
                    boundaries.add(stop)
            at += len(line) + 1
        if open_:
            self.fences.append((open_[0], len(text) + 1))
        self.boundaries = sorted(boundaries)

    def paths(self, places: Iterable[int]) -> Iterator[list[str]]:
        """Headings before each of ascending places, outermost first. Of the line that a place is in only
        what stands before it counts."""
        stack, k = [], 0
        for place in places:
            while k < len(self.headings) and self.headings[k][0] <= place:
                _put(stack, *self.headings[k][1:])
                k += 1
            partial = heading(self.text[self.text.rfind("\n", 0, place) + 1 : place])
            own = _put(list(stack), *partial) if partial else stack
            yield [title for _, title in own]


def _put(stack: list[tuple[int, str]], level: int, title: str) -> list[tuple[int, str]]:
    while stack and stack[-1][0] >= level:
        stack.pop()
    stack.append((level, title))
    return stack


def _checked(spans: Spans, size: int) -> None:
    before = 0
    for a, b in spans:
        if not before <= a < b <= size:
            raise ValueError("token spans are empty, overlap or run backwards")
        before = b


def _bytes_at(text: str, places: Iterable[int]) -> Iterator[int]:
    """The byte offsets of ascending places."""
    at, total = 0, 0
    for place in places:
        total += len(text[at:place].encode())
        at = place
        yield total


def cuts(layout: Layout, spans: Spans, target: int = TARGET, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, int]]:
    """First and last token (exclusive) of each chunk. A chunk ends at the boundary within ``reach`` that
    is nearest to the target, the earlier of two, else at the target. No end lies inside a fence: it
    moves to the fence's start, or to its end where the chunk began at it. The next chunk begins
    ``overlap`` tokens before, or at the start of the fence that this place is in; without overlap
    where a fence begins at the end, or where it would not advance. Work is linear but for bisections."""
    starts, n = [a for a, _ in spans], len(spans)
    at = lambda place: bisect_left(starts, place)
    edges = sorted({at(b) for b in layout.boundaries})
    fences = [(a, b) for a, b in ((at(x), at(y)) for x, y in layout.fences) if a < b]
    opens = [a for a, _ in fences]

    def around(token: int) -> tuple[int, int] | None:
        k = bisect_left(opens, token) - 1
        return fences[k] if k >= 0 and token < fences[k][1] else None

    out, start = [], 0
    while start < n:
        goal = start + target
        if goal >= n:
            end = n
        else:
            k = bisect_left(edges, goal)
            lowest = max(start + 1, start + target - reach)
            near = [e for e in edges[max(0, k - 1) : k + 1] if lowest <= e <= min(goal + reach, n)]
            end = min(near, key=lambda e: (abs(e - goal), e)) if near else goal
            while inside := around(end):
                end = inside[0] if inside[0] > start else min(inside[1], n)
            end = min(max(end, start + 1), n)
        out.append((start, end))
        following = end - min(overlap, end - start - 1)
        if inside := around(following):
            following = inside[0]
        k = bisect_right(opens, end) - 1
        if (following < end and k >= 0 and opens[k] == end) or following <= start:
            following = end
        start = following if end < n else n
    return out


def chunk(text: str, target: int = TARGET, overlap: int = OVERLAP, reach: int = REACH, spans: Spans | None = None, original: tuple[str, Spans] | None = None) -> list[dict]:
    """The chunks of a text; see ``cuts``. ``spans``: of its tokens, as character offsets. ``original``: the
    text as it was before it was normalised, with a span for each token; bodies are cut from it."""
    if target < 1:
        raise ValueError("target must be positive")
    spans = [m.span() for m in TOKEN.finditer(text)] if spans is None else spans
    source, places = original or (text, spans)
    if len(places) != len(spans):
        raise ValueError("there must be an original span for each token")
    _checked(spans, len(text))
    _checked(places, len(source))
    layout = Layout(text)
    made = cuts(layout, spans, target, overlap, reach)
    first, last = [places[a][0] for a, _ in made], [places[b - 1][1] for _, b in made]
    rows = zip(made, first, last, _bytes_at(source, first), _bytes_at(source, last), layout.paths(spans[a][0] for a, _ in made), strict=True)
    return [{"chunk_index": i, "token_start": a, "token_end": b, "byte_start": x, "byte_end": y, "heading_path": path, "body": source[lo:hi]} for i, ((a, b), lo, hi, x, y, path) in enumerate(rows)]


def library_spans(text: str, tokeniser) -> tuple[str, Spans, tuple[str, Spans]]:
    """What ``chunk`` needs of a text and a ``tokenizers`` tokeniser: the normalised text, its tokens' spans,
    and the text itself with theirs. Tokens that stand for nothing of their own go."""
    plain = tokeniser.normalizer.normalize_str(text) if tokeniser.normalizer else text
    both = zip(tokeniser.encode(plain, add_special_tokens=False).offsets, tokeniser.encode(text, add_special_tokens=False).offsets, strict=True)
    own, theirs, end, last = [], [], 0, 0
    for (a, b), (x, y) in both:
        a, x = max(a, end), max(x, last)
        if a < b and x < y:
            own.append((a, b))
            theirs.append((x, y))
            end, last = b, y
    return plain, own, (text, theirs)


def chunked(sources: DataFrame, keep: list[str], text: str = "body", target: int = TARGET, overlap: int = OVERLAP, reach: int = REACH, tokenise: Callable[[str], tuple] | None = None) -> DataFrame:
    """A row per chunk with the ``keep`` columns. Texts without tokens have no chunks. ``tokenise``: gives
    for a text what ``library_spans`` gives; it is sent to the workers."""
    rows = sources.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("skein_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "skein_text") + ", " + SCHEMA
    types = [("chunk_index", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("heading_path", pa.list_(pa.string())), ("body", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, made = [], []
            for i, t in enumerate(b.column("skein_text")):
                plain, spans, original = tokenise(t.as_py()) if tokenise else (t.as_py(), None, None)
                for c in chunk(plain, target, overlap, reach, spans, original):
                    of.append(i)
                    made.append(c)
            kept = b.select(keep).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([c[n] for c in made], t) for n, t in types)], names=[*keep, *(n for n, _ in types)])

    return rows.mapInArrow(run, schema)


def fixed_windows(n_tokens: Column, size: int = TARGET, step: int = TARGET - OVERLAP) -> Column:
    """array<struct<start, stop>>: windows every ``step`` tokens up to the first that reaches the end."""
    last = F.ceil(F.greatest(n_tokens - size, F.lit(0)) / step).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("long").alias("start"), F.least(n_tokens, i * step + size).cast("long").alias("stop")))
    return F.when(n_tokens > 0, made).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
