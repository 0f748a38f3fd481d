"""A scan over landed API pages as a data source of its own: ``spark.read.format("skein_pages")``.

Pages lie as ``<path>/<endpoint>/<number>.json``, the endpoint percent-encoded, the number with leading
zeros, one response each. A scan goes on behind each endpoint's cursor and reads so many pages of an
endpoint at most; each endpoint is a partition of its own, or several of so many pages. Options: path;
cursors, a JSON object of the last page read by endpoint; pages, most per endpoint; endpoints, a prefix.

As a stream (``spark.readStream``) the cursors of all endpoints are the offset, and a step ends before a page that
asks to wait or fails, so that a later one begins there again. Further options: landing, the path of a
``landing`` table whose cursors a stream starts from; seconds, after which no step is begun. Planning a step reads
the pages that it admits for their status; tasks read them for their rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skein.sources.landing import Landing, Notes, landed_rows
from skein.sources.records import PAGE

#: Pages that a partition reads.
PART = 64


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_pages"

    def schema(self):
        return PAGE

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


class Part(InputPartition):
    def __init__(self, endpoint: str, paths: list[str]):
        super().__init__(endpoint)
        self.paths = paths


def waits(status: int | None) -> bool:
    """Whether a page asks to wait, or failed."""
    return status is not None and (status in (403, 429) or status >= 500)


class _Folder:
    """The pages under a path."""

    def __init__(self, path: str, prefix: str):
        self.path, self.prefix = path, prefix

    def behind(self, cursors: dict[str, int], most: int) -> dict[str, list[tuple[int, str]]]:
        """(number, path) of the next pages of each endpoint, in order. Only numbers behind the cursors are kept."""
        files, root = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[tuple[int, str]]] = {}
        for folder in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            endpoint = unquote(folder.base_name)
            if folder.type == fs.FileType.Directory and endpoint.startswith(self.prefix):
                names = (x for x in files.get_file_info(fs.FileSelector(folder.path)) if x.base_name.endswith(".json"))
                new = sorted((n, x.path) for x in names if (n := int(x.base_name.removesuffix(".json"))) > cursors.get(endpoint, 0))
                found[endpoint] = new[:most] if most else new
        return found

    def page(self, path: str) -> dict:
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(path) as f:
            page = json.loads(f.read())
        if extra := set(page) - set(PAGE.names):
            raise ValueError(f"page {path} has unknown fields: {', '.join(sorted(extra))}")
        return page

    def rows(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            page = self.page(path)
            yield tuple(page.get(k) for k in PAGE.names)


def _parts(found: dict[str, list[tuple[int, str]]]) -> list[Part]:
    out = [Part(endpoint, [p for _, p in pages[k : k + PART]]) for endpoint, pages in sorted(found.items()) for k in range(0, len(pages), PART)]
    return out or [Part("", [])]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options["path"], options.get("endpoints", ""))
        self.cursors, self.most = json.loads(options.get("cursors", "{}")), int(options.get("pages", 0))

    def partitions(self) -> list[Part]:
        return _parts(self.folder.behind(self.cursors, self.most))

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.folder.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options["path"], options.get("endpoints", ""))
        self.first, self.most, self.seconds = json.loads(options.get("cursors", "{}")), int(options.get("pages", 0)), float(options.get("seconds", "inf"))
        self.landing, self.began, self.last = options.get("landing"), time.monotonic(), None

    def _start(self) -> dict[str, int]:
        known = {k: page for k, (page, _) in Notes(self.landing).cursors().items()} if self.landing else {}
        return {k: max(self.first.get(k, 0), known.get(k, 0)) for k in {*self.first, *known}}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._start()

    def latestOffset(self) -> dict:  # noqa: N802
        """The cursors after the next step: what is behind the last one's, up to a page that waits."""
        at = dict(self._start() if self.last is None else self.last)
        if time.monotonic() - self.began < self.seconds:
            found = self.folder.behind(at, self.most)
            with ThreadPoolExecutor(16) as pool:
                status = dict(pool.map(lambda p: (p, self.folder.page(p).get("status")), [p for pages in found.values() for _, p in pages]))
            for endpoint, pages in found.items():
                for number, path in pages:
                    if waits(status[path]):
                        break
                    at[endpoint] = number
        self.last = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = end if self.last is None else {k: max(end.get(k, 0), self.last.get(k, 0)) for k in {*end, *self.last}}
        found = self.folder.behind(start, 0)
        return _parts({k: [x for x in pages if x[0] <= end.get(k, 0)] for k, pages in found.items()})

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.folder.rows(partition)


def scan(spark: SparkSession, path: str, cursors: dict[str, int] | None = None, pages: int = 0, endpoints: str = "") -> DataFrame:
    """The landed pages behind the cursors, ``pages`` of an endpoint at most (0: all)."""
    spark.dataSource.register(Pages)
    return spark.read.format("skein_pages").options(path=path, cursors=json.dumps(cursors or {}), pages=str(pages), endpoints=endpoints).load()


def landed(spark: SparkSession, path: str, landing: str, checkpoint: str, pages: int = 0, endpoints: str = "", seconds: float | None = None) -> DataFrame:
    """One bounded run from where the landing is: the pages behind its cursors, ``pages`` of an endpoint at most, up to
    those that ask to wait, and all rows that the landing has afterwards."""
    spark.dataSource.register(Pages)
    spark.dataSource.register(Landing)
    options = {"path": path, "landing": landing, "pages": str(pages), "endpoints": endpoints} | ({} if seconds is None else {"seconds": str(seconds)})
    stream = spark.readStream.format("skein_pages").options(**options).load()
    stream.writeStream.format("skein_landing").option("path", landing).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return landed_rows(spark, landing, PAGE)


def committed(pages: DataFrame) -> DataFrame:
    """Pages without those from the first on that asks to wait or fails (status 403, 429 or 5xx), by
    endpoint: what a run may store, so that the next one begins there again."""
    bad = pages.filter(F.col("status").isin(403, 429) | (F.col("status") >= 500)).groupBy("endpoint").agg(F.min("page").alias("skein_stop"))
    return pages.join(bad, "endpoint", "left").filter(F.col("skein_stop").isNull() | (F.col("page") < F.col("skein_stop"))).drop("skein_stop")


def cursors(pages: DataFrame) -> DataFrame:
    """endpoint, page, etag: where the next scan of each endpoint goes on."""
    return pages.groupBy("endpoint").agg(F.max("page").alias("page"), F.max_by("etag", "page").alias("etag"))
