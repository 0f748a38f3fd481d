"""Near-duplicate vectors by cosine, exactly, from int8 tile products.

Vectors are scaled to length one (pairs that are recomputed are not) and quantised to int8 with a scale of their own. With e_x the length
of x's quantisation error, the true cosine of x and y differs from the quantised product by at most
e_x + (1 + e_x) e_y, so most pairs are settled, above or below the threshold, by integer products
alone; only those in between are recomputed in double precision.

Equal vectors form a class first and are never compared. Classes go to the nearest of a few sampled
pivots and then into blocks of about BLOCK vectors, each a file in the shared folder with its centre and
the widest angle from it. Every pair of blocks is looked at once: a task takes a block and a stretch of
those after it, going round, and reads their files; no vector is shuffled more than once. Where the
angle between two centres less both widest angles is over the threshold's no pair can link, and the other
block is not even read. A pair of blocks returns link counts and a spanning forest of its links, never
its pairs, so a group of thousands of near copies costs no more rows than others. Forests are joined by
distributed connected components.

Results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths do not link. Repeated rows count as further vectors. A null id's row has
a null component. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import dropped, new_folder, written
from skein.llm.components import connected_components
from skein.llm.warc import Folder

#: Vectors of a block, at most about; a task holds two blocks and a strip of their product. Small tables
#: get LEAST_BLOCKS blocks, so that they make several tasks too. Pivots at most; blocks of a stretch.
BLOCK, STRIP, LEAST_BLOCKS, PIVOTS, STRETCH = 8192, 512, 8, 256, 32
#: Room for rounding in single precision products and scales.
SLACK = 1e-5
#: Beyond so many dimensions a product of int8 values might not be exact in single precision.
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)
#: Pairs recomputed at once.
AT_ONCE = 1 << 17


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, vectors = [], []
        for v in b.column("vector").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
            raw = x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None
            keys.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
            vectors.append(raw)
        yield pa.RecordBatch.from_pydict({"id": b.column("id"), "key": pa.array(keys, pa.binary()), "raw": pa.array(vectors, pa.binary())})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the length
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component is about one: no rounding, no overflow in sums."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


class _Side:
    """A block's vectors: raw (but for powers of two), of length one, and quantised, with error bounds; ``where``:
    their places among both blocks'."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, first: int):
        self.where, self.copies, self.raw, self.full = np.arange(first, first + len(raw)), copies, raw, _unit(raw)
        self.square = (raw * raw).sum(1)
        self.scale = np.abs(self.full).max(1) / 127
        q = np.rint(self.full / self.scale[:, None])
        self.error = np.sqrt(((self.full - q * self.scale[:, None]) ** 2).sum(1))
        self.q = q.astype(np.int8)

    def wide(self) -> np.ndarray:
        return self.q.astype(np.float32 if self.q.shape[1] <= EXACT_DIMENSIONS else np.float64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _linked(a: _Side, b: _Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs as row numbers in a and b; of a block with itself each pair once."""
    left, right = a.wide(), b.wide().T
    spread = b.error.max()
    for i in range(0, len(left), STRIP):
        rows = slice(i, i + STRIP)
        product = left[rows] @ right
        product *= b.scale[None, :].astype(product.dtype)
        bound = a.error[rows] + (1 + a.error[rows]) * spread + SLACK
        x, y = np.nonzero(product >= ((threshold - bound) / a.scale[rows]).astype(product.dtype)[:, None])
        if same:
            x, y = x[y > x + i], y[y > x + i]
        near = product[x, y] * a.scale[rows][x]
        own = a.error[rows][x] + (1 + a.error[rows][x]) * b.error[y] + SLACK
        sure, open_ = near - own >= threshold, np.abs(near - threshold) < own
        for k in range(0, len(ask := np.flatnonzero(open_ & ~sure)), AT_ONCE):
            part = ask[k : k + AT_ONCE]
            u, v = x[part] + i, y[part]
            sure[part] = (a.raw[u] * b.raw[v]).sum(1) / np.sqrt(a.square[u] * b.square[v]) >= threshold
        yield x[sure] + i, y[sure]


def _sorted_out(pivots: list[bytes]):
    """Adds each vector's cluster: its length and the nearest pivot of that length."""
    by_size: dict[int, np.ndarray] = {}
    for size in {len(p) for p in pivots}:
        by_size[size] = _unit(np.stack([np.frombuffer(p) for p in pivots if len(p) == size]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").to_pylist()
            size, near = np.array([len(r) for r in raw], np.int32), np.zeros(len(raw), np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if d in by_size:
                    near[at] = (_unit(np.stack([np.frombuffer(raw[i]) for i in at])) @ by_size[d].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size // 8), pa.array(near)], names=[*b.schema.names, "length", "near"])

    return run


def _writer(folder: str):
    """Over rows sorted by (length, near, part): writes each group as a block with its head; gives their names."""

    def put(group: pa.Table) -> tuple[str, int]:
        name = "-".join(str(group.column(k)[0].as_py()) for k in ("length", "near", "part"))
        raw_ = _even(np.frombuffer(b"".join(group.column("raw").to_pylist())).reshape(group.num_rows, -1))
        full = _unit(raw_)
        centre = full.mean(0)
        size = np.sqrt(centre @ centre)
        widest = np.pi  # no centre: nothing is ruled out
        if size > 1e-9:
            centre = centre / size
            widest = float(np.arccos(np.clip((full @ centre).min(), -1, 1)))
        out = Folder(folder)
        for kind, arrays in (("block", {"key": np.frombuffer(b"".join(group.column("key").to_pylist()), np.uint8).reshape(-1, 16), "raw": raw_, "copies": group.column("copies").to_numpy()}), ("head", {"centre": centre, "widest": np.array(widest)})):
            raw = io.BytesIO()
            np.savez(raw, **arrays)
            with out.write(f"{name}.{kind}") as f:
                f.write(raw.getvalue())
        return name, group.num_rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, made = None, []
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            keys = np.stack([t.column(k).to_numpy() for k in ("length", "near", "part")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            made += [put(t.slice(i, j - i)) for i, j in zip(cuts, cuts[1:], strict=False)]
            rest = t.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            made.append(put(rest))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["name", "n"])

    return run


def _load(folder: Folder, name: str) -> dict[str, np.ndarray]:
    with folder.open(name) as f, np.load(io.BytesIO(f.read())) as arrays:
        return dict(arrays)


def apart(a: dict[str, np.ndarray], b: dict[str, np.ndarray], threshold: float) -> bool:
    """Whether no vector of one block can reach the threshold with one of the other, by their heads."""
    between = float(np.arccos(np.clip(a["centre"] @ b["centre"], -1, 1)))
    return between - float(a["widest"]) - float(b["widest"]) > float(np.arccos(threshold)) + 1e-6


def partners(i: int, n: int) -> range:
    """How far after block ``i`` of ``n``, going round, its partners lie, so that each two blocks meet once."""
    return range(0, n // 2 + 1 if n % 2 or i < n // 2 else n // 2)


def _compared(folder: str, lists: list[list[str]], threshold: float, stretch: int):
    """Over (list, block, first): the links of a block with those of a stretch of its partners."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(folder)
        head = lru_cache(4096)(lambda name: _load(files, f"{name}.head"))
        block = lru_cache(2)(lambda name: _load(files, f"{name}.block"))
        for b in batches:
            for which, i, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names = lists[which]
                for k in partners(i, len(names))[first : first + stretch]:
                    one, other = names[i], names[(i + k) % len(names)]
                    if k and apart(head(one), head(other), threshold):
                        continue
                    made = _links(block(one), block(other) if k else None, threshold)
                    if made is not None:
                        yield made

    return run


def _links(one: dict[str, np.ndarray], other: dict[str, np.ndarray] | None, threshold: float) -> pa.RecordBatch | None:
    """Of one block, or of one with another: how many links each vector has, and its tree in a forest."""
    a = _Side(one["raw"], one["copies"], 0)
    b = a if other is None else _Side(other["raw"], other["copies"], len(a.raw))
    keys = [x.tobytes() for x in (one["key"] if other is None else np.concatenate((one["key"], other["key"])))]
    count, parent = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for x, y in _linked(a, b, other is None, threshold):
        u, v = a.where[x], b.where[y]
        np.add.at(count, u, b.copies[y])
        np.add.at(count, v, a.copies[x])
        while len(u):
            ru, rv = parent[u], parent[v]
            unlike = ru != rv
            u, v, ru, rv = u[unlike], v[unlike], ru[unlike], rv[unlike]
            np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
            parent = _roots(parent)
    found = np.flatnonzero(count)
    if not len(found):
        return None
    return pa.RecordBatch.from_arrays([pa.array([keys[x] for x in found], pa.binary()), pa.array([keys[parent[x]] for x in found], pa.binary()), pa.array(count[found], pa.int64())], names=["key", "root", "n"])


def link_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links (other vectors with a cosine of ``threshold`` or more),
    component_id (the smallest id reachable by links, itself included), kept (it is its component's
    smallest). Only the two named columns are read."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    keyed = written(rows.mapInArrow(_classes, f"id {kind}, key binary, raw binary"), "vectors")
    classes = written(keyed.filter("key is not null").groupBy("key").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("id").alias("least")), "vector-classes")
    size = classes.count()
    blocks = max(1, min(LEAST_BLOCKS, size // 64), -(-size // BLOCK))
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "blocks")
    pivots = [bytes(r["raw"]) for r in classes.orderBy(F.xxhash64("key"), "key").select("raw").limit(min(blocks, PIVOTS)).collect()]
    placed = written(classes.select("key", "raw", "copies").mapInArrow(_sorted_out(pivots), "key binary, raw binary, copies long, length int, near int"), "placed")
    sizes = placed.groupBy("length", "near").agg(F.count("*").alias("size"))
    most = max(1, min(BLOCK, -(-size // blocks)))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / most)).cast("int")
    dealt = placed.join(F.broadcast(sizes), ["length", "near"]).select("key", "raw", "copies", "length", "near", part.alias("part"))  # sizes: a row per pivot and length
    made = dealt.repartition("length", "near", "part").sortWithinPartitions("length", "near", "part").mapInArrow(_writer(folder), "name string, n long")
    lists: dict[str, list[str]] = {}
    for r in written(made, "block-names").orderBy("name").select("name").collect():  # a name per block
        lists.setdefault(r["name"].split("-")[0], []).append(r["name"])
    names = list(lists.values())
    stretch = STRETCH if size > LEAST_BLOCKS * BLOCK else 1
    todo = None
    if names:
        sized = spark.createDataFrame([(k, len(own)) for k, own in enumerate(names)], "list int, blocks int")
        todo = sized.select("list", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("list", "block", F.explode(F.sequence(F.lit(0), F.expr("blocks div 2"), F.lit(stretch))).alias("first"))
    total = sum(len(own) * (len(own) // 2 // stretch + 1) for own in names)
    found = classes.select("key", F.col("key").alias("root"), F.col("copies").alias("n")).limit(0)
    if todo is not None:
        tasks = min(total, max(4 * spark.sparkContext.defaultParallelism, total // 64))
        found = written(todo.repartition(tasks).mapInArrow(_compared(folder, names, threshold, stretch), "key binary, root binary, n long"), "links")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    part = connected_components(found, "key", "root").withColumnRenamed("node", "key")
    labelled = written(classes.select("key", "copies", "least").join(counts, "key", "left").join(part, "key", "left").withColumn("component", F.coalesce("component", "key")), "labelled")
    dropped(placed)
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    known = labelled.join(ids, "component").select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    shown = keyed.select("id", "key").join(known, "key", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return shown.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
