"""Harmonic packing of token sequences into fixed-length training sequences.

A document's ids (with an end id) are cut: full stretches of ``capacity`` ids are sequences by
themselves; of the rest, each piece gets the length that fits ``k`` times into a sequence, for the
largest such length there is, so that pieces fall into reciprocal-capacity classes k = 2, 3, ...
A class's bins take exactly k pieces. What is smaller than ``capacity / SMALL`` goes to a last class
that fills sequences end to end, cutting at their borders. Every partition packs for itself: no
shuffle, and its open bins hold a few hundred short records. At a partition's end the unfilled bins
are emptied into the last class, whose final sequences have power-of-two lengths, which need no
padding.

The sequence id is (partition number << 40) + a counter, so the packing follows the partitioning of
the input; for the same partitions it is the same again, also when a lost task is repeated.

Results: a null text is an empty text and yields the end id alone. Repeated rows are packed again
each. No input gives no rows. Sequence lengths differ from ``capacity`` by the padding only.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from skein.llm import bpe
from skein.llm.common import parts, worker_threads

#: Part of the capacity below which a piece goes to the last class.
SMALL = 32
#: Ids that a bin may lack for its piece to stay whole.
SLACK = 4
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Tokeniser:
    """Ids by the tokenizers library, which is asked once for each pre-token that a worker has not
    lately seen, in one call for a batch of texts. Its model gets the pre-tokens as the vocabulary's
    characters; what it would do before and after that is left out."""

    def __init__(self, spec: bytes):
        worker_threads()
        whole = json.loads(spec)
        self.pieces = Tokenizer.from_str(json.dumps(whole | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "truncation", "padding")) | {"added_tokens": []}))
        self.chars = {b: c for c, b in bpe.byte_chars().items()}
        self.own = bpe.encoder(spec)
        self.seen = self.own.table(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode().decode("latin-1").translate(self.chars) for w in words]
        ids = np.array(self.pieces.encode_batch_fast([raw], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(np.diff(self.own.offset)[ids])  # of tokens and of words, in bytes
        return ids, np.diff(np.searchsorted(ends, np.cumsum([0, *map(len, raw)]) , "right"))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.own.encode_texts(texts, self.seen)


_tokenisers: dict[bytes, Tokeniser] = {}


def tokeniser(spec: bytes) -> Tokeniser:
    """The vocabulary's tokeniser, made once in each Python worker."""
    if spec not in _tokenisers:
        _tokenisers[spec] = Tokeniser(spec)
    return _tokenisers[spec]


class Packer:
    """The bins of one partition. ``add`` and ``close`` fill ``self.rows`` with finished pieces."""

    def __init__(self, capacity: int, number: int):
        self.capacity, self.next_id = capacity, number << 40
        self.bins: dict[int, list[tuple]] = {}
        self.small: list[tuple] = []
        self.small_used = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        c, n, at = self.capacity, len(ids) // 4, 0
        while n - at >= c:
            self.emit([(doc_id, at, c, ids, n)])
            at += c
        while (rest := n - at) > 0:
            if rest < c // SMALL:
                self.add_small(doc_id, at, rest, ids, n)
                return
            k = c // rest
            if c - k * rest > SLACK:
                k += 1
            size = min(rest, c // k)
            bin_ = self.bins.setdefault(k, [])
            bin_.append((doc_id, at, size, ids[4 * at : 4 * (at + size)], n))
            if len(bin_) == k:
                self.emit(self.bins.pop(k))
            at += size

    def add_small(self, doc_id, at: int, size: int, ids: bytes, n: int, whole: bool = True) -> None:
        part = ids[4 * at : 4 * (at + size)] if whole else ids
        while size:
            take = min(size, self.capacity - self.small_used)
            self.small.append((doc_id, at, take, part[: 4 * take], n))
            self.small_used += take
            at, size, part = at + take, size - take, part[4 * take :]
            if self.small_used == self.capacity:
                self.emit(self.small)
                self.small, self.small_used = [], 0

    def close(self) -> None:
        for k in sorted(self.bins):
            for doc_id, at, size, part, n in self.bins[k]:
                self.add_small(doc_id, at, size, part, n, whole=False)
        self.bins = {}
        pieces, self.small, left, self.small_used = self.small[::-1], [], self.small_used, 0
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            sequence = []
            while size:
                doc_id, at, has, part, n = pieces.pop()
                take = min(has, size)
                sequence.append((doc_id, at, take, part[: 4 * take], n))
                size -= take
                if take < has:
                    pieces.append((doc_id, at + take, has - take, part[4 * take :], n))
            self.emit(sequence)

    def emit(self, pieces: list[tuple]) -> None:
        """One finished sequence. A piece of full length comes with its document's ids."""
        offset = 0
        for doc_id, at, size, part, n in pieces:
            if len(part) != 4 * size:
                part = part[4 * at : 4 * (at + size)]
            self.rows.append((doc_id, at, size, zlib.crc32(part), n, self.next_id, offset))
            offset += size
        self.next_id += 1


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and pack into sequences of ``capacity`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all
    but doc_id long). Only the two named columns are read."""
    spec = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary(vocabulary_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = tokeniser(spec.value), Packer(capacity, TaskContext.get().partitionId())
        arrow_id = None

        def made() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [[]] * len(FIELDS)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_id), *(pa.array(x, pa.int64()) for x in cols[1:])], names=FIELDS)

        for b, texts in parts(batches):
            arrow_id = b.schema.field("doc_id").type
            for doc_id, coded in zip(b.column("doc_id").to_pylist(), enc.encode_many(texts), strict=True):
                packer.add(doc_id, coded + end)
            yield made()
        if arrow_id is not None:
            packer.close()
            yield made()

    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
