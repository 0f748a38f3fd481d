"""WARC archives with a two-level capture index.

Writing: each partition of the pages becomes one ``.warc.gz`` file in the folder, a gzip member per
record. Of records with equal payloads the one with the smallest id is written as a response, the
others as revisits that name it. Only digests are grouped for that; payloads are not shuffled unless
there are too many repeated digests to look them up in every task.

Index: captures are sorted by reversed-host URL key over all partitions and written in compressed
blocks of BLOCK_LINES lines, with a sparse directory that has each block's first entry, offset and
length. Reading: a key is searched in the list of index files, then in one file's directory, then in
one block, each by bisection; the record is then read by its range. A task holds one directory and a
few blocks.

Files are written under a task's own name and then moved, and partitions are sorted before, so a
repeated task leaves the same bytes. Folders may be any that pyarrow's file systems open.

Results: a null payload is empty. A null URL has an empty key. A null id is written as '', an empty one as a
backslash (see ``_named``), and both come back as they were. Of rows that repeat id and payload one, with the least
URL, is the response if that id is the smallest; the others revisit it, by the same id. No pages give an archive
without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import new_folder, written

BLOCK_LINES = 512
#: Repeated digests that may be broadcast (about 60 bytes each); beyond it pages are joined by shuffle.
MOST_BROADCAST = 500_000
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "id string, url_key string, digest string, type string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort key with the host's labels reversed: http://www.a.org:80/x?y -> org,a,www)/x?y."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return quote(url, safe="/:?#[]@!$&'()*+,;=%~")
    labels = ",".join(reversed(host.split(".")))
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return quote(labels + (f":{port}" if port not in (None, 80, 443) else "") + ")" + path, safe="/:?#[]@!$&'()*+,;=%~")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(id_: str) -> str:
    return f"<urn:x-page:{quote(id_, safe='')}>"


def record(id_: str, url: str | None, payload: bytes, refers_to: str | None, date: str, payload_digest: str | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(id_), "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or _urn(id_)[1:-1]),
        "WARC-Payload-Digest": f"sha1:{payload_digest or digest(payload)}", "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    text = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"{VERSION}\r\n{text}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and its block."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record has a wrong length")
    return fields, rest[:size]


class Folder:
    """Files of a folder on any file system that pyarrow opens."""

    def __init__(self, uri: str):
        self.files, self.path = fs.FileSystem.from_uri(uri)

    def write(self, name: str):
        return _Atomic(self.files, f"{self.path}/{name}")

    def open(self, name: str):
        return self.files.open_input_file(f"{self.path}/{name}")


class _Atomic:
    """A file that has its name once it is whole."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path, self.own, self.at = files, path, f"{path}.{uuid4().hex}", 0

    def __enter__(self):
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.own)
        return self

    def write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.files.move(self.own, self.path)
        else:
            self.files.delete_file(self.own)


# -- writing ------------------------------------------------------------------------------------
def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages into ``folder``; returns the captures, a written table with FIELDS."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    each = rows.filter(F.length("payload") >= least_bytes).groupBy("sha1", "page").agg(F.count("*").alias("n"))
    firsts = each.groupBy("sha1").agg(F.min("page").alias("first"), F.min_by("n", "page").alias("again"), F.sum("n").alias("n"))
    repeated = written(firsts.filter("n > 1 and first is not null").select("sha1", "first", "again"), "repeated")
    known = rows.join(F.broadcast(repeated) if repeated.count() <= MOST_BROADCAST else repeated, "sha1", "left")
    own = F.col("page").eqNullSafe(F.col("first"))
    ready = known.select(_named("page").alias("id"), "url", "payload", "sha1", F.when(F.col("first").isNotNull() & ~own, _named("first")).alias("refers_to"), (own & (F.col("again") > 1)).alias("again"))
    if repeated.filter("again > 1").head(1):  # rows that repeat an id and its payload: one of them is the response
        twice = ready.filter("again").groupBy("id", "sha1", "url").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
        one = twice.groupBy("sha1").agg(F.min(F.struct("url")).alias("one"))
        dealt = twice.join(one, "sha1").select("id", "url", "payload", "sha1", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda k: F.col("one.url").eqNullSafe(F.col("url")) & (k == 1))).alias("response"))
        ready = ready.filter("not coalesce(again, false)").select("id", "url", "payload", "sha1", "refers_to").unionByName(dealt.select("id", "url", "payload", "sha1", F.when(~F.col("response"), F.col("id")).alias("refers_to")))
    return written(ready.drop("again").sortWithinPartitions("id", "url", "sha1").mapInArrow(_writer(folder, date), FIELDS), "captures")


def _named(c: str) -> Column:
    """An id as text: null is empty; what is empty, or of backslashes alone, has one more in front."""
    x = F.col(c).cast("string")
    return F.when(x.isNull(), "").when(x.rlike(r"\A\\*\z"), F.concat(F.lit("\\"), x)).otherwise(x)


def _unnamed(c: str) -> Column:
    x = F.col(c)
    return F.when(x == "", None).when(x.rlike(r"\A\\+\z"), F.substring(x, F.lit(2), F.length(x))).otherwise(x)


def _writer(folder: str, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        with Folder(folder).write(name) as out:
            info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(z.compress(info.encode()) + z.flush())
            while first is not None:
                made = []
                for id_, url, payload, sha1, refers_to in zip(*(first.column(k) for k in ("id", "url", "payload", "sha1", "refers_to")), strict=True):
                    id_, url, refers_to, payload_digest = id_.as_py(), url.as_py(), refers_to.as_py(), base64.b32encode(sha1.as_py()).decode()
                    at, size = out.write(record(id_, url, payload.as_py(), refers_to, date, payload_digest))
                    made.append((id_, url_key(url), payload_digest, "response" if refers_to is None else "revisit", name, at, size))
                first = next(batches, None)
                yield _batch(made)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FIELDS.split(", ")])


# -- index --------------------------------------------------------------------------------------
_ORDER = ("url_key", "id", "digest", "type")


def write_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Write the captures' index into ``folder``. Returns its top level, sorted: for each index file
    its first entry and its name; there is one per partition."""
    ranged = captures.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER, "file", "offset")
    top = ranged.mapInArrow(_indexer(folder), "url_key string, id string, digest string, type string, file string")
    return sorted(tuple(r) for r in written(top, "index-top").collect())


def _indexer(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():06d}"
        directory, lines, first = [], [], None
        with Folder(folder).write(f"{name}.blocks") as out:

            def close() -> None:
                at, size = out.write(zlib.compress("\n".join(lines).encode()))
                directory.append(f"{first[0]} {quote(first[1], safe='')} {first[2]} {first[3]} {at} {size}")
                lines.clear()

            for b in batches:
                for key, id_, sha, kind, file, at, size in zip(*(b.column(k).to_pylist() for k in (*_ORDER, "file", "offset", "length")), strict=True):
                    if not lines:
                        first = (key, id_, sha, kind)
                    lines.append(f"{key} {quote(id_, safe='')} {sha} {kind} {file} {at} {size}")
                    if len(lines) == BLOCK_LINES:
                        close()
            if lines:
                close()
        if directory:
            with Folder(folder).write(f"{name}.directory") as out:
                out.write(zlib.compress("\n".join(directory).encode()))
            key, id_, sha, kind = directory[0].split(" ")[:4]
            yield pa.RecordBatch.from_pydict({"url_key": [key], "id": [unquote(id_)], "digest": [sha], "type": [kind], "file": [name]})

    return run


class Reader:
    """Looks captures up in an index and reads their records."""

    def __init__(self, folder: str, top: list[tuple]):
        self.folder, self.top = Folder(folder), top
        self.directory, self.block, self.file = (lru_cache(n)(f) for n, f in ((2, self._directory), (8, self._block), (64, self.folder.open)))

    @staticmethod
    def _entries(data: bytes) -> list[tuple]:
        return [((x := line.split(" "))[0], unquote(x[1]), *x[2:]) for line in zlib.decompress(data).decode().split("\n")]

    def _directory(self, name: str) -> list[tuple]:
        with self.folder.open(f"{name}.directory") as f:
            return self._entries(f.read())

    def _block(self, name: str, at: int, size: int) -> list[tuple]:
        return self._entries(self.file(f"{name}.blocks").read_at(size, at))

    def find(self, key: tuple[str, str, str, str]) -> tuple | None:
        """The index entry of (url_key, id, digest, type)."""
        k = bisect_right(self.top, (*key, "\U0010ffff")) - 1
        if k < 0:
            return None
        name = self.top[k][4]
        blocks = self.directory(name)
        entry = blocks[max(0, bisect_right(blocks, key, key=lambda e: e[:4]) - 1)]
        lines = self.block(name, int(entry[4]), int(entry[5]))
        line = lines[bisect_right(lines, key, key=lambda e: e[:4]) - 1]
        return line if line[:4] == key else None

    def record(self, entry: tuple) -> tuple[dict[str, str], bytes]:
        return parse(self.file(entry[4]).read_at(int(entry[6]), int(entry[5])))


def read_captures(lookups: DataFrame, folder: str, top: list[tuple]) -> DataFrame:
    """Read the records of ``lookups`` (url_key, id, digest, type) back through the index. Returns id,
    payload_bytes, payload_digest (of the full payload; for revisits as their record says), record_type,
    refers_to (as text). A lookup without a capture gives nulls."""
    ranged = lookups.select(*_ORDER).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, top)
        for b in batches:
            out = []
            for key in zip(*(b.column(k).to_pylist() for k in _ORDER), strict=True):
                entry = reader.find(key)
                if entry is None:
                    out.append((key[1], None, None, None, None))
                    continue
                fields, block = reader.record(entry)
                http, _, payload = block.partition(b"\r\n\r\n")
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
                    raise ValueError(f"payload of {key} is damaged")
                of = fields.get("warc-refers-to")
                out.append((key[1], size, said, fields["warc-type"], unquote(of[len("<urn:x-page:") : -1]) if of else None))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return ranged.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive all pages, index them, and read every record back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    captures = write_archives(pages, folder, id_col=id_col, url_col=url_col, payload_col=payload_col)
    top = write_index(captures, folder)
    kind = pages.schema[id_col].dataType
    read = read_captures(captures, folder, top)
    id_ = lambda c: _unnamed(c).cast(kind)
    return read.select(id_("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_("refers_to").alias("refers_to"))
