"""Near-duplicate texts by SetSketch registers over word shingles.

A text's set holds the hashes of its distinct five-word shingles. Its sketch has REGISTERS values:
each is the least of an exponential variable over the set's elements, floored on a scale that is
exponentially spaced (base BASE) and truncated to 16 bits. Sketches of parts merge by the greater
value; two sets agree in a register about as often as their Jaccard similarity says.

Texts with equal sets form classes first, so copies cost nothing more. Classes that agree in a band
of registers share a bucket. Each class is first compared with one leader, the member of its buckets
that most others share buckets with; that joins groups of near copies around their centres. Buckets
whose members are then all in one component are done. In the others, each pair across components is
looked at inside a task, in blocks of bounded size: a bucket's largest component is not compared with
itself, so its members go to as many tasks only as the others have blocks. A pair is passed on only if
the registers' agreement and a rigorous bound leave it a chance: a bitmap of the parities of the set's
hashed elements, where two sets' bitmaps never differ in more bits than the sets differ in elements.
What is passed on is estimated by the likelihood of the registers' order and equality, given both set
sizes, and what may reach the threshold is confirmed on the full sets.

At a similarity of 0.75 the bands miss a pair with probability (1 - 0.75^4)^40, about 3 in 10^7, and
the estimates drop it with about 1 in 10^6; above it both fall steeply.

Results: texts without words have no set and link with nothing, so do rows with a null id. With fewer
than five words the whole sequence is the only shingle. Rows that repeat an id are one document, with
the links of all its texts: each is returned, with the size of its own set and the document's component.
No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, dropped, parts, share, written
from skein.llm.components import connected_components

WORDS = 5
REGISTERS, BAND, BASE, RATE = 160, 4, 1.001, 20.0
#: Below this estimate, or this share of equal registers, nothing is confirmed: nearly five standard
#: errors under the threshold of 0.75.
LEAST_ESTIMATE, LEAST_EQUAL = 0.6, 0.58
#: Bits of the parity bitmap. Members of a bucket that a task compares at once with as many others.
PARITIES, BLOCK_MEMBERS = 2048, 2048
#: Ids that a lookup side may have to be broadcast (16 bytes each, about); else both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Set elements hashed at once for a sketch: a block of this times REGISTERS 64-bit numbers.
BLOCK = 256

#: Words, of at most so many bytes, whose hashes a worker keeps.
KEPT_WORDS, KEPT_BYTES = 1 << 16, 64

_u = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_SALT, _FACTOR = _rng.integers(0, 2**64, (2, REGISTERS), dtype=_u)
_FACTOR |= _u(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _u(33))) * _u(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _u(33))) * _u(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _u(33))


class _Words(dict):
    """Words' hashes: 64 bits of BLAKE2b, so that no text can be written whose words collide."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit shingle hashes, each mixed from its words' hashes in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _u)
    each = np.fromiter(map(_words.__getitem__, words), _u, len(words))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, _u)
    for i in range(k):
        h = _mixed(h + each[i : i + n])
    return np.unique(h)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The set's registers, 16 bits each."""
    least = np.full(REGISTERS, 2**64 - 1, _u)
    for i in range(0, len(elements), BLOCK):
        least = np.minimum(least, ((elements[i : i + BLOCK, None] ^ _SALT) * _FACTOR).min(axis=0))
    exponential = -np.log1p(-((least >> _u(11)).astype(float) + 0.5) / 2**53) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype("<u2")


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarities of pairs. a, b: registers, a row for each pair."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.clip(1 - x - y, 1e-12, None))

    for _ in range(30):  # it has one maximum: thirds of the range go
        c, d = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(c) < likelihood(d)
        low, high = np.where(up, c, low), np.where(up, high, d)
    return (low + high) / 2


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in parts(batches):
        sets = [shingles(t) for t in texts]
        digest, registers = [_digest(s) if len(s) else None for s in sets], [sketch(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_shingles": pa.array(map(len, sets), pa.int64()), "digest": pa.array(digest, pa.binary()), "registers": pa.array(registers, pa.binary())})


def parity(elements: np.ndarray) -> np.ndarray:
    """For each of PARITIES cells whether an odd number of elements falls into it, 8 to a byte."""
    return np.packbits(np.bincount((elements >> _u(20)) % _u(PARITIES), minlength=PARITIES).astype(np.uint8) & 1)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose text is the class's: an id's other texts go."""
    for b, texts in parts(batches):
        made = [shingles(t) for t in texts]
        own = [i for i, (s, d) in enumerate(zip(made, b.column("digest").to_pylist(), strict=True)) if _digest(s) == d]
        made, node = [made[i] for i in own], b.column("node").take(pa.array(own, pa.int64()))
        ends = np.cumsum([0, *map(len, made)])
        registers = [sketch(s) for s in made]
        yield pa.RecordBatch.from_pydict(
            {
                "node": node, "n": pa.array([len(s) for s in made], pa.int64()), "registers": pa.array([r.tobytes() for r in registers], pa.binary()),
                "low": pa.array([r.astype(np.uint8).tobytes() + parity(s).tobytes() for r, s in zip(registers, made, strict=True)], pa.binary()),
                "elements": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*made, np.zeros(0, _u)]).view(np.int64))),
            }
        )


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in ("registers_a", "registers_b"))
            good = estimated(a, c, *(b.column(k).to_numpy().astype(float) for k in ("n_a", "n_b"))) >= LEAST_ESTIMATE
            yield b.select(["a", "b"]).filter(pa.array(good))


def _chances(low: np.ndarray, n: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, one of ``left`` and one of ``right``, in different components, that low bytes of
    the registers and parities leave a chance to be linked. The largest component is not compared
    with itself."""
    common = np.bincount(component).argmax()
    for rows, others in ((left[component[left] != common], right), (left[component[left] == common], right[component[right] != common])):
        for i in range(0, len(rows) if len(others) else 0, 256):
            part = rows[i : i + 256]
            same = np.zeros((len(part), len(others)), np.uint8)
            for r in range(REGISTERS):
                same += low[part, r][:, None] == low[others, r][None, :]
            x, y = np.nonzero(same >= LEAST_EQUAL * REGISTERS)
            x, y = part[x], others[y]
            ok = component[x] != component[y]
            x, y = x[ok], y[ok]
            for k in range(0, len(x), 1 << 14):
                u, v = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                apart = np.bitwise_count(low[u, REGISTERS:] ^ low[v, REGISTERS:]).sum(1, dtype=np.int64)
                both = n[u] + n[v]
                fit = 100 * (both - apart) >= percent * (both + apart)
                yield u[fit], v[fit]


def _compared(percent: int):
    """Over rows sorted by (bucket, i, j): the pairs of each group that have a chance."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            keys = np.stack([t.column(k).to_numpy() for k in ("bucket", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if len(cuts):
                yield from _groups(t.slice(0, cuts[-1]), np.concatenate(([0], cuts)), percent)
            rest = t.slice(cuts[-1] if len(cuts) else 0)
        if rest is not None and rest.num_rows:
            yield from _groups(rest, np.array([0, rest.num_rows]), percent)

    return run


def _groups(t: pa.Table, cuts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    nodes = t.column("node").combine_chunks()
    low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    n, component, block = t.column("n").to_numpy(), t.column("component").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("block").to_numpy()
    i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
    a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, stop in zip(cuts[:-1], cuts[1:], strict=True):
        rows = np.arange(first, stop)
        inner = np.unique(component[first:stop], return_inverse=True)[1]
        if not inner.any():
            continue
        left, right = (rows[block[first:stop] == k[first]] - first for k in (i, j))
        for x, y in _chances(low[first:stop], n[first:stop], inner, left, right, percent):
            a.append(x + first)
            c.append(y + first)
    pairs = [nodes.take(pa.array(np.concatenate(k))) for k in (a, c)]
    if len(pairs[0]):
        yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, a written table, to be broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def link_documents(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links). documents: doc_id, n_shingles, component_id, kept, a row per input row;
    component_id is the smallest id reachable by links. links: confirmed links (a, b) between ids of
    different sets, enough to connect each component. Only the two named columns are read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signatures, f"doc_id {kind}, n_shingles long, digest binary, registers binary"), "signatures")
    # a class: an equal set; a document without words is a class by itself, which nothing is compared with
    alone = F.unhex(F.md5(F.concat(F.lit("id:"), F.col("doc_id").cast("string")).cast("binary")))
    keyed = signed.filter(F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("digest", alone))
    classes = written(
        keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).select(F.monotonically_increasing_id().alias("node"), "*"), "classes"
    )
    repeated = written(keyed.groupBy("doc_id").agg(F.count("*").alias("times"), F.min("key").alias("low"), F.max("key").alias("high")).filter("times > 1"), "repeated")

    width = 2 * BAND
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(REGISTERS // BAND)))
    banded = classes.filter("n > 0").select("node", F.explode(bands).alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = written(banded.join(shared, "bucket"), "members")

    wanted = written(members.groupBy("node").agg(F.sum("size").alias("company")), "wanted")
    sought = written(classes.join(wanted, "node", "left_semi").select("node", F.col("least").alias("doc_id"), F.col("key").alias("digest")), "sought")
    made = written(rows.join(_few(sought), "doc_id").select("node", "doc_id", "digest", "text").mapInArrow(_sets, "node long, n long, registers binary, low binary, elements array<long>"), "made")
    twice = sought.join(_few(repeated.select("doc_id")), "doc_id", "left_semi").select("node")  # an id's equal rows give a set each
    again = made.join(twice, "node", "left_semi").dropDuplicates(["node"])
    sets = made
    if repeated.head(1):
        sets = written(made.join(twice, "node", "left_anti").unionByName(again), "sets")
        dropped(made)
    dropped(sought)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose full sets are similar enough."""
        side = lambda k, *cols: sets.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
        known = pairs.join(side("a", "n", "registers"), "a").join(side("b", "n", "registers"), "b").select("a", "b", "n_a", "n_b", "registers_a", "registers_b")
        likely = known.mapInArrow(_likely, "a long, b long")
        both = likely.join(side("a", "elements"), "a").join(side("b", "elements"), "b")
        common = F.size(F.array_intersect("elements_a", "elements_b"))
        of_both = both.select("a", "b", common.alias("i"), (F.size("elements_a") + F.size("elements_b")).alias("s"))
        return written(of_both.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), "links")

    lead = members.join(wanted, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("lead"))
    first = members.join(lead, "bucket").groupBy("node").agg(F.max("lead").alias("lead")).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
    links = confirmed(first.filter("a != b"))
    part = written(connected_components(links), "components")

    now = written(members.join(part, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "labelled")
    dropped(members, wanted, shared, part)
    seen = _tiles(now, sets.select("node", "n", "low")).mapInArrow(_compared(percent), "a long, b long")
    more = confirmed(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = links.union(more)
    dropped(now, sets)

    # texts of one id are one document
    node_of = lambda c, name: classes.select(F.col("key").alias(c), F.col("node").alias(name))
    other = keyed.select("doc_id", "key").join(_few(repeated.filter("low < high").select("doc_id", "low")), "doc_id").filter("key != low").select("key", "low").distinct()
    same = other.join(node_of("key", "a"), "key").join(node_of("low", "b"), "low").select("a", "b")
    part = written(connected_components(links.union(same)), "components")
    ids = part.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    mapped = classes.join(part.join(ids, "component"), "node", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    of_all = signed.withColumn("key", F.coalesce("digest", alone)).join(mapped, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    shown = of_all.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    least_of = lambda c: classes.select(F.col("node").alias(f"{c}_node"), F.col("least").alias(c))
    return shown, links.toDF("a_node", "b_node").join(least_of("a"), "a_node").join(least_of("b"), "b_node").select("a", "b")


def _tiles(members: DataFrame, low: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, dealt to tiles (bucket, i, j) and sorted by
    them. A bucket's largest component has blocks of its own, after those of the rest; tiles are pairs
    of the rest's blocks, and of each of them with each block of the largest."""
    by = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    mixed = by.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.max("size").alias("large"), F.sum("size").alias("size")).filter("large < size")
    number = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    sized = mixed.select("bucket", "largest", number(F.col("size") - F.col("large")).alias("few"), number(F.col("large")).alias("many"))
    open_ = members.join(sized, "bucket").join(low, "node").withColumn("rest", F.col("component") != F.col("largest"))
    place = lambda n: F.floor(share(F.col("node"), "block") * n).cast("int")
    block = F.when(F.col("rest"), place(F.col("few"))).otherwise(F.col("few") + place(F.col("many")))
    others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    dealt = open_.withColumn("block", block).withColumn("other", F.explode(others))
    tiles = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "low")
    return tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest id. Of rows that
    repeat an id one stays; rows with a null id all stay."""
    linked, _ = link_documents(docs, percent, id_col, text_col)
    state = linked.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter(F.col("doc_id").isNotNull())
    gone = written(state.filter("not kept or n > 1").select(F.col("doc_id").alias(id_col), F.col("kept").alias("skein_again")), "gone")
    small = gone.count() <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda t: t)
    stay = docs.join(hint(gone.select(id_col)), id_col, "left_anti")
    again = docs.join(hint(gone.filter("skein_again").select(id_col)), id_col, "left_semi").dropDuplicates([id_col])
    return stay.select(*map(column, docs.columns)).unionByName(again.select(*map(column, docs.columns)))
