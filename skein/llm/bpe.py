"""Exact byte-level BPE encoding and decoding over whole texts.

Encoding runs per pre-token. An Aho-Corasick automaton over the vocabulary gives the longest token
at every position; a sequence of tokens is *the* BPE result exactly if each neighbouring pair is
compatible, that is, if merging the pair's bytes by rank yields the two tokens again. The table of
pairs is filled as pairs turn up. Where a pair does not fit, the encoder takes the next shorter
token at that place, or steps back; positions found hopeless are never tried again, so the work
stays linear in the pre-token's length. Decoding reads token bytes from one blob by an offset table.

Pre-tokens that a worker has lately seen are looked up (``pretokens``); only new ones are encoded.

Results: a null text is an empty text (no ids). Special tokens that stand in a text become their
ids, as the tokenizers library does by default. Bytes that are not UTF-8 after decoding become
U+FFFD. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import parts
from skein.llm.pretokens import Words

#: The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens tried that a worker keeps, at most.
KEEP_PAIRS = 300_000


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand
    for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _late() -> dict[str, str]:
    """Letters and numbers that the regex module knows and this Python's Unicode tables do not: the
    tokenizers library treats them as unassigned."""
    late = {"L": "", "N": ""}
    kinds = {k: regex.compile(rf"\p{{{k}}}").match for k in late}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x32000)]):
        if unicodedata.category(c) == "Cn":
            for k, match in kinds.items():
                late[k] += c if match(c) else ""
    return late


@cache
def _exact_pattern() -> regex.Pattern:
    """PATTERN with the late letters and numbers taken for other characters."""
    l, n = (rf"[\p{{{k}}}--[{v}]]" for k, v in _late().items())
    return regex.compile(PATTERN.replace(r"\p{L}+", l + "+", 1).replace(r"\p{N}+", n + "+", 1).replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{''.join(_late().values())}])"), regex.V1)


class Encoder:
    """A byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        if d["model"]["type"] != "BPE" or d.get("normalizer") or (d["pre_tokenizer"] or {}).get("type") != "ByteLevel" or d["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        of = byte_chars()
        raw = lambda s: bytes(of[c] for c in s).decode("latin-1")
        vocab = {raw(k): v for k, v in d["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.ids = vocab
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        text = [""] * size
        for k, v in vocab.items():
            text[v] = k
        self.text = text
        self.auto = ahocorasick.Automaton()
        for k, v in vocab.items():
            self.auto.add_word(k, v)
        self.auto.make_automaton()
        self.widest, self.width = max(map(len, vocab)), [len(x) for x in text]
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.late = frozenset("".join(_late().values()))
        self.seen = self.table(self.encode_words)
        said = [b""] * size
        for k, v in vocab.items():
            said[v] = k.encode("latin-1")
        for k, v in self.special.items():
            said[v] = k.encode()
        self.blob = np.frombuffer(b"".join(said), np.uint8)
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in said], out=self.offset[1:])

    # -- encoding -----------------------------------------------------------------------------
    def merged(self, text: str) -> list[int]:
        """The ids of ``text`` by applying merges in order of rank: what defines a pair's fit."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            t = self.text[token]
            known = self.shorter[token] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        return known

    def tokens(self, s: str) -> list[int]:
        """The ids of one pre-token, given as latin-1 text of its bytes: the longest token at each place
        that fits what stands before, stepping back where none does."""
        n, widest, width, find, pairs, shorter = len(s), self.widest, self.width, self.auto.iter_long, self.pairs, self.shorter
        hopeless = bytearray(n + 1)
        out, at = [], 0
        token = next(find(s[:widest]))[1]
        while at < n:
            end = at + width[token]
            if not hopeless[end]:
                good = pairs.get((out[-1], token)) if out else self.self_made(token)
                if self.fits(out[-1], token) if good is None else good:
                    out.append(token)
                    at = end
                    if at < n:
                        token = next(find(s[at : at + widest]))[1]
                    continue
            token = shorter[token] if token in shorter else self.next_shorter(token)
            while token < 0:
                hopeless[at] = 1
                token = out.pop()
                at -= width[token]
                token = self.next_shorter(token)
        return out

    def self_made(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        known = self.pairs.get((token, -1))
        if known is None:
            known = self.pairs[token, -1] = self.merged(self.text[token]) == [token]
        return known

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens, one after another, and how many each has. The automaton's longest
        matches stand where all neighbours fit; the other words are searched."""
        if len(self.pairs) > KEEP_PAIRS:
            self.pairs.clear()
        raw = [w.encode().decode("latin-1") for w in words]
        found = [[t for _, t in self.auto.iter_long(s)] for s in raw]
        pairs, fits = self.pairs.get, self.fits
        for i, out in enumerate(found):
            if len(out) == 1:
                if not self.self_made(out[0]):
                    found[i] = self.tokens(raw[i])
            else:
                for p in zip(out, out[1:], strict=False):
                    if not (pairs(p) or fits(*p)):
                        found[i] = self.tokens(raw[i])
                        break
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size

    # -- pre-tokens ---------------------------------------------------------------------------
    def table(self, encode) -> Words:
        """A table of pre-tokens whose ids ``encode`` gives."""
        pattern = lambda t: self.pattern if self.late.isdisjoint(t) else _exact_pattern()
        return Words(encode, lambda t: pattern(t).findall(t), lambda t: (m[0] for m in pattern(t).finditer(t)))

    def encode_texts(self, texts: list[str], seen: Words | None = None) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Special tokens in a text are
        pre-tokens by themselves."""
        seen = seen or self.seen
        if not self.special_split or not any(s in t for t in texts for s in self.special):
            return seen.texts(texts)
        parts = [[p for p in self.special_split.split(t) if p] for t in texts]
        coded = iter(seen.texts([p for t in parts for p in t if p not in self.special]))
        return [b"".join([self.special[p].to_bytes(4, "little") if p in self.special else next(coded) for p in t]) for t in parts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_texts([text or ""])[0]

    # -- decoding -----------------------------------------------------------------------------
    def decode_bytes(self, ids: bytes, step: int = 1 << 19) -> bytes:
        """The bytes behind ids (little-endian 32-bit), as valid UTF-8; ``step`` ids at a time."""
        at, out = np.frombuffer(ids, "<u4"), []
        for i in range(0, len(at), step):
            t = at[i : i + step]
            first, size = self.offset[t], self.offset[t + np.uint32(1)] - self.offset[t]
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(first - ends + size, size) + np.arange(int(ends[-1]))].tobytes())
        made = b"".join(out)
        try:
            made.decode()
        except UnicodeDecodeError:
            made = made.decode("utf-8", "replace").encode()
        return made


_encoders: dict[bytes, Encoder] = {}


def encoder(spec: bytes) -> Encoder:
    """The vocabulary's encoder, made once in each Python worker."""
    key = hashlib.sha256(spec).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns (doc_id, n_tokens long, ids_sha256, decoded_sha256), with ``with_ids`` also the ids as
    binary (little-endian unsigned 32-bit). Only the two named columns are read, so other columns
    may have any name. The vocabulary goes to the workers as a broadcast of fixed size."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b, texts in parts(batches):
            n, sha, back, kept = [], [], [], []
            for ids in enc.encode_texts(texts):
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""))


def decode_documents(ids: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts behind binary ids: (doc_id, text); null ids give an empty text."""
    spec = ids.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    rows = ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array([enc.decode_bytes(x.as_py() or b"").decode() for x in b.column("ids")], pa.string())})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
