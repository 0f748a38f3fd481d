import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from skein.operators import chunks
from skein.operators.chunks import Layout, chunk, chunked, heading

WORDS = st.lists(st.sampled_from(["word", "# Head", "\n", "\n\n", "```\n", "~~~~\n", "x.", "漢字", " ", "  ## Two ", "#", "#####", "\r\n"]), max_size=120).map(" ".join)


def words(text):
    """Spans of what stands between white space."""
    out, at = [], 0
    for w in text.split():
        a = text.index(w, at)
        out.append((a, at := a + len(w)))
    return out


def path(text, place):
    return next(Layout(text).paths([place]))


def plain_cuts(text, spans, target, overlap, reach):
    """The rules in plain loops over all boundaries and fences."""
    layout, n = Layout(text), len(spans)
    at = lambda place: next((i for i, (a, _) in enumerate(spans) if a >= place), n)
    edges, fences = {at(b) for b in layout.boundaries}, [(at(a), at(b)) for a, b in layout.fences]
    inside = lambda x: [f for f in fences if f[0] < x < f[1]]
    out, start = [], 0
    while start < n:
        end, goal = n, start + target
        if goal < n:
            good = [e for e in edges if start < e and start + max(0, target - reach) <= e <= goal + reach]
            end = min(good, key=lambda e: (abs(e - goal), e), default=goal)
            while f := inside(end):
                end = f[0][0] if f[0][0] > start else f[0][1]
            end = max(end, start + 1)
        out.append((start, end))
        if end == n:
            return out
        back = end - min(overlap, end - start - 1)
        back = inside(back)[0][0] if inside(back) else back
        if any(a == end and b > a for a, b in fences) or back <= start:
            back = end
        start = back
    return out


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(1, 25), st.integers(0, 12), st.integers(0, 30))
def test_cuts_equal_plain_loops(text, target, overlap, reach):
    spans = [m.span() for m in chunks.TOKEN.finditer(text)]
    assert chunks.cuts(Layout(text), spans, target, overlap, reach) == plain_cuts(text, spans, target, overlap, reach)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_chunks_cover_and_advance(text):
    made = chunk(text, 20, 4, 6)
    if not made:
        return
    assert made[0]["token_start"] == 0
    for a, b in zip(made, made[1:], strict=False):
        assert a["token_start"] < b["token_start"] <= a["token_end"] < b["token_end"]
    for c in made:
        assert text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["body"]


def test_empty_and_short():
    assert chunk("") == []
    assert chunk("  \n ") == []
    assert [c["body"] for c in chunk("a b c")] == ["a b c"]


@pytest.mark.parametrize("spans", [[(0, 3), (2, 4)], [(1, 1)], [(2, 3), (0, 1)], [(0, 9)]])
def test_bad_spans_are_an_error(spans):
    with pytest.raises(ValueError, match="spans"):
        chunk("abcd", spans=spans)


def test_target_of_nothing_is_an_error():
    with pytest.raises(ValueError, match="target"):
        chunk("abcd", 0)


@pytest.mark.parametrize("fence", ["```", "~~~~", "   ```"])
def test_fence_is_never_divided(fence):
    inside = "\n".join(f"code{i}" for i in range(30))
    mark = fence.strip()
    text = " ".join(f"w{i}" for i in range(15)) + f"\n{fence}\n{inside}\n{mark}\n" + " ".join(f"v{i}" for i in range(15))
    for c in chunk(text, 20, 4, 5):
        body = c["body"]
        assert ("code0" in body) == ("code29" in body)


def test_fences():
    assert Layout("a\n```\nb\n# c").fences == [(2, 12)]  # unclosed: to the end
    assert Layout("```\na\n~~~\nb\n```` x\nc").fences == [(0, 19)]  # closed by the same mark, as long at least
    assert Layout("    ```\na").fences == []


def test_overlap_at_a_fence():
    """A fence of 86 tokens at the start, target 100, overlap 30: where the overlap would begin inside the
    fence it begins at the fence, and as that does not advance, there is none."""
    text = "```\n" + " ".join(f"f{i}" for i in range(84)) + "\n```\n" + " ".join(f"t{i}" for i in range(200))
    assert chunks.cuts(Layout(text), words(text), 100, 30, 0)[:2] == [(0, 100), (100, 200)]


def test_short_start_before_a_long_fence():
    text = "a b c d\n\n```text\n" + " ".join(f"f{i}" for i in range(8)) + "\n```\n\ny z"
    assert chunks.cuts(Layout(text), words(text), 6, 4, 0) == [(0, 4), (4, 14), (14, 16)]


@pytest.mark.parametrize(("before", "inside", "after"), [(135, 1062, 24), (56, 6188, 23)])
def test_long_fences_give_three_chunks(before, inside, after):
    text = " ".join(f"a{i}" for i in range(before)) + "\n\n```text\n" + " ".join(f"b{i}" for i in range(inside)) + "\n```\n\n" + " ".join(f"c{i}" for i in range(after))
    made = chunk(text, spans=words(text))
    assert len(made) == 3
    assert all(c["body"].count("```") != 1 for c in made)


def test_boundaries_sizes_and_overlap():
    text = "# One two\n\na1 a2 a3 a4 a5 a6 a7 a8\n\n## Three\n\nb1 b2 b3 b4 b5 b6 b7 b8\n\n## Four\n\nc1 c2 c3 c4 c5 c6 c7 c8"
    made = chunk(text, 10, 2, 4, words(text))
    assert [(c["token_start"], c["token_end"]) for c in made] == [(0, 11), (9, 21), (19, 31)]
    assert made[0]["body"].endswith("a8")
    assert [c["heading_path"] for c in made] == [[], ["One two"], ["One two", "Three"]]


@pytest.mark.parametrize(("line", "want"), [("# A", (1, "A")), ("      ## B  ", (2, "B")), ("#", None), ("# ", (1, "")), ("#A", None), ("####### x", None), ("## C ##", (2, "C ##")), ("\t# D", (1, "D")), ("", None), ("a # b", None)])
def test_heading_lines(line, want):
    assert heading(line) == want


def test_heading_path_is_a_stack_of_what_stands_before():
    text = "# A\n## B\nx\n## C\n### D\ny\n```\n# in fence\n```\nz"
    assert path(text, text.index("y")) == ["A", "C", "D"]
    assert path(text, text.index("x")) == ["A", "B"]
    assert path(text, 0) == []  # the heading at the place itself does not count
    assert path(text, text.index("## C")) == ["A", "B"]
    assert path(text, text.index("z")) == ["in fence"]
    assert path("# Long title\n", 7) == ["Long"]  # of its own line what stands before


def test_work_is_linear():
    def took(n):
        text = "\n\n".join(f"# H{i}\nword é word. next" for i in range(n))
        began = time.perf_counter()
        chunk(text, 50, 5, 10)
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 16 * max(took(4_000), 0.02)


def test_original_text_is_cut():
    """Tokens of the normalised text, bodies of the text as it was."""
    t = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()]), pre_tokenizers.Whitespace()
    text = "# Überschrift\n\nÉté à Zürich und MEHR Wörter hier"
    plain, spans, original = chunks.library_spans(text, t)
    assert plain.startswith("# uberschrift")
    made = chunk(plain, 4, 1, 0, spans, original)
    assert [c["body"] for c in made] == ["# Überschrift\n\nÉté à", "à Zürich und MEHR", "MEHR Wörter hier"]
    assert all(text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["body"] for c in made)
    with pytest.raises(ValueError, match="original span"):
        chunk(plain, spans=spans, original=(text, original[1][1:]))


def test_fingerprint_depends_on_the_tokeniser():
    assert chunks.fingerprint("a") == chunks.fingerprint("a") != chunks.fingerprint("b")
    assert chunks.fingerprint("a").startswith("markdown-token-v3:")


def test_null_text_has_no_chunks(spark):
    rows = spark.createDataFrame([(1, None), (2, "one two")], "id long, body string")
    assert [r["id"] for r in chunked(rows, ["id"]).collect()] == [2]
    split = lambda t: (t, [(0, 3)], None)
    assert [r["body"] for r in chunked(rows.filter("id = 2"), ["id"], tokenise=split).collect()] == ["one"]
