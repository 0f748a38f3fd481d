"""Pre-tokens cut with numpy against the pattern, and the table of pre-tokens against the library."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import bpe, packing, pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
L, N, S = pretokens.LETTERS, pretokens.NUMBERS, pretokens.WHITE
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
PARTS = ["'", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "ll", "d", "m", "x", "S", "1", "²", "!", "é", "ª", "\xa0", "\x85", "\x1c", "\x00", ".", "'s", "'ll "]


def test_starts_equal_the_pattern():
    rng = np.random.default_rng(1)
    for _ in range(5000):
        texts = ["".join(rng.choice(PARTS, rng.integers(0, 9))) for _ in range(rng.integers(1, 5))]
        raw = [t.encode("latin-1") for t in texts]
        size = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        if len(flat):
            at = pretokens.starts(flat, np.concatenate(([0], np.cumsum(size)))[:-1][size > 0])
            got = [flat[i:j].tobytes().decode("latin-1") for i, j in zip(at, [*at[1:], len(flat)], strict=True)]
            assert got == [w for t in texts for w in PATTERN.findall(t)]


def texts(n):
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdeé'1 .\n"), rng.integers(1, 24)))
    out = [" ".join(word() for _ in range(rng.integers(0, 60))) for _ in range(n)]
    return [*out, "日本語 text's <|endoftext|> x", "<|endoftext|>", "", "x" * 3000, "a\x00b \x00", "a\x00", "'s're 's 'll'", *out[:5]]


def library(many):
    t = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(many, add_special_tokens=False)]


@pytest.fixture(scope="module")
def coders():
    spec = bpe.vocabulary(PATH)
    return bpe.encoder(spec).encode_texts, packing.tokeniser(spec).encode_many


def test_both_coders_equal_the_library(coders):
    many = texts(300)
    want = library(many)
    for f in coders:
        assert f(many) == want
        assert f(many) == want  # now from the table
        assert f([]) == []


def test_tables_thin_out(coders, monkeypatch):
    """Full tables keep what was met often, and give the same ids."""
    monkeypatch.setattr(pretokens, "KEEP", 900)
    many = texts(200)
    want = library(many)
    for seen in (bpe.encoder(bpe.vocabulary(PATH)).seen, packing.tokeniser(bpe.vocabulary(PATH)).seen):
        seen._renew()
        for k in range(0, len(many), 7):
            part = many[k : k + 7] + many[:3]
            assert [x for t in part if "<|" not in t for x in seen.texts([t])] == [w for t, w in zip(part, want[k : k + 7] + want[:3], strict=True) if "<|" not in t]
            assert seen.next <= 900 + 1000
        assert 0 < seen.next


def test_long_texts_go_in_parts(coders, monkeypatch):
    monkeypatch.setattr(pretokens, "BLOCK", 50)
    monkeypatch.setattr(pretokens, "AT_ONCE", 7)
    many = ["the cat, and the dog's " * 40, "日本 語 " * 90, "é " * 200, "x" * 900, "a.b;c " * 99, "no cut" + "!" * 300]
    for f in coders:
        assert f(many) == library(many)


def test_a_token_that_merges_cannot_make():
    """Such a token is never given, neither for a whole pre-token nor inside one."""
    chars = {b: c for c, b in bpe.byte_chars().items()}
    vocab = {chars[b]: b for b in range(256)} | {"ab": 256, "abc": 257, "bc": 258}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "b c"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": True}, "added_tokens": [], "normalizer": None}
    import json

    e = bpe.Encoder(json.dumps(spec).encode())
    assert np.frombuffer(e.encode("abc"), "<u4").tolist() == [256, 99]
    assert np.frombuffer(e.encode("abcbc xbc"), "<u4").tolist() == [256, 99, 258, 32, 120, 258]


def test_repeated_documents_with_other_texts_are_packed_each(spark):
    rows = [(1, "one two three"), (1, "four five"), (1, "one two three"), (2, None)]
    made = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    ids = Counter()
    for (i, _), raw in zip(rows, library([t or "" for _, t in rows]), strict=True):
        ids[i, len(raw) // 4 + 1] += len(raw) // 4 + 1
    got = defaultdict(int)
    for r in made:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert dict(got) == dict(ids)
    crcs = {zlib.crc32(raw + bytes(4)) for raw in library(["one two three", "four five", ""])}
    assert {r["ids_crc32"] for r in made if r["start"] == 0 and r["length"] == r["doc_tokens"]} <= crcs
