"""Scores, fits and votes of the three classifiers against plain loops; the pipeline on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import common, embeddings, langid, linear, minhash, ngrams, quality, toxicity, warc
from skein.plans import storage

MULTIPLY = [0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491]
TEXTS = ["The quick brown fox", "", "a bb ccc dddd eeeee ffffff ggggggg", "Émile était là là", "x", "  spaced   out\n\nlines ", "ALL CAPS!! HERE!! HERE!!", "word " * 50, "12 34 %%"]


def bucket(gram, bits):
    h = len(gram)
    for b in gram:
        h = (h + b) * MULTIPLY[len(gram)] % 2**32
        h ^= h >> 15
    return (h * 0x9E3779B1 % 2**32) >> (32 - bits)


# -- toxicity -----------------------------------------------------------------------------------
def word_grams(word):
    s = f" {word} ".encode()
    return [bucket(s[i : i + n], toxicity.BITS) for n in toxicity.LENGTHS for i in range(len(s) - n + 1)]


def test_toxicity_scores_equal_plain_loops():
    values = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    got = toxicity.Model(values, 1.7, 0.3).score(TEXTS)
    for text, s in zip(TEXTS, got, strict=True):
        means = [sum(float(values[g]) for g in word_grams(w)) / len(word_grams(w)) for w in text.lower().split()]
        want = 1 / (1 + math.exp(-max(1.7 * (max(means) - 0.3), -500))) if means else 1 / (1 + math.exp(500))
        assert s == pytest.approx(want, abs=1e-6)


def test_softmax_step_equals_differences():
    """One step moves vectors and weights against the loss's gradient, by differences."""
    net = toxicity._Softmax(0)
    net.e, net.w, net.b = net.e.astype(float), net.w.astype(float), net.b.astype(float)
    index, size, y = np.array([3, 5, 3, 9, 11]), np.array([2, 3]), np.array([1, 0])
    weight = np.array([0.5, 0.5, 0.2, 0.3, 0.5])

    def loss():
        v = [sum(net.e[i] * w for i, w in zip(index[a:b], weight[a:b], strict=True)) for a, b in ((0, 2), (2, 5))]
        z = [x @ net.w + net.b for x in v]
        return sum(math.log(np.exp(x).sum()) - x[k] for x, k in zip(z, y, strict=True)) / 2

    slopes = {}
    for i in (3, 9, 20):
        for d in (0, 4):
            net.e[i, d] += 1e-5
            up = loss()
            net.e[i, d] -= 2e-5
            slopes[i, d] = (up - loss()) / 2e-5
            net.e[i, d] += 1e-5
    before = net.e.copy()
    net.step(index, weight, size, y)
    for (i, d), slope in slopes.items():
        moved = net.e[i, d] - before[i, d]
        assert moved == pytest.approx(-toxicity.RATE * slope / math.sqrt(float(net.se[i])), abs=2e-3) if i != 20 else moved == 0


# -- quality ------------------------------------------------------------------------------------
def plain_indicators(text):
    raw = text.encode()
    s = b" " + raw + b" " if raw else b""
    found = {bucket(s[i : i + n], quality.BITS) for n in quality.LENGTHS for i in range(len(s) - n + 1)}
    words, shapes = text.split(), []
    for i, w in enumerate(words):
        case = 4 if w.isupper() else 3 if w[0].isupper() else 2 if w[0].islower() else 1
        shapes.append(case + (0 if w[-1].isalnum() else 8) + (16 if i and words[i - 1] == w else 0))
    for codes, lengths, salt in (([zlib.crc32(w.encode()) for w in words], (1, 2), 0), (shapes, (1, 2, 3, 4), 100)):
        for n in lengths:
            for i in range(len(codes) - n + 1):
                h = salt + n
                for c in codes[i : i + n]:
                    h = (h ^ c) * 0xD6E8FEB86659FD93 % 2**64
                    h ^= h >> 32
                found.add((h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS))
    return found


def test_quality_indicators_equal_plain_loops():
    rows = quality.indicators(TEXTS)
    for i, t in enumerate(TEXTS):
        assert set(rows.index[rows.start[i] : rows.start[i + 1]].tolist()) == plain_indicators(t)
    assert rows.start[2] - rows.start[1] == 0  # an empty text has no features


def test_quality_fit_equals_plain_loops():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 6)) + ("!!" if k % 2 else ".") for k in range(20)]
    labels = [k % 2 for k in range(20)]
    model = quality.fit(texts, labels)
    sets = [plain_indicators(t) for t in texts]
    ratio = {}
    for f in set().union(*sets):
        good, bad = (1 + sum(f in s for s, y in zip(sets, labels, strict=True) if y == k) for k in (1, 0))
        ratio[f] = math.log((good / 12) / (bad / 12))
    rows = [{f: ratio[f] / math.sqrt(len(s)) for f in s} for s in sets]
    w, b = plain_hinge(rows, [1 if y else -1 for y in labels], quality.COST, 12)
    mean = sum(map(abs, w.values())) / quality.SIZE
    for f in ratio:
        assert model.weights[f] == pytest.approx((quality.MIX * w.get(f, 0.0) + (1 - quality.MIX) * mean) * ratio[f], abs=1e-4)
    assert model.bias == pytest.approx(b, abs=1e-4)
    score = model.score(texts)
    for t, s in zip(texts, score, strict=True):
        f = plain_indicators(t)
        margin = (sum(model.weights[k] for k in f) + model.bias) / math.sqrt(len(f))
        assert s == pytest.approx(1 / (1 + math.exp(-model.slope * (margin - model.shift))), abs=1e-6)
    assert [int(s >= 0.3) for s in score] == labels


def plain_hinge(rows, y, cost, rounds, seed=0):
    """Dual coordinate descent, one row at a time, in the fit's order."""
    w, b, alpha, rng = defaultdict(float), 0.0, [0.0] * len(rows), np.random.default_rng(seed)
    count = Counter(y)
    most = {k: cost * len(y) / (2 * count[k]) for k in count}
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (sum(w[f] * v for f, v in rows[i].items()) + b) - 1
            norm = sum(v * v for v in rows[i].values()) + 1
            new = min(max(alpha[i] - slope / norm, 0.0), most[y[i]])
            for f, v in rows[i].items():
                w[f] += (new - alpha[i]) * y[i] * v
            b += (new - alpha[i]) * y[i]
            largest = max(largest, abs(new - alpha[i]) * norm)
            alpha[i] = new
        if largest < 1e-3:
            break
    return w, b


def test_hinge_equals_plain_loops():
    rng = np.random.default_rng(4)
    rows = [{int(f): float(v) for f, v in zip(rng.permutation(9)[:4], rng.normal(size=4), strict=True)} for _ in range(20)]
    y = [1 if sum(r.values()) > 0 else -1 for r in rows]
    x = linear.Rows(np.array([f for r in rows for f in r]), np.array([v for r in rows for v in r.values()]), np.arange(0, 81, 4))
    w, b = linear.hinge(x, np.array(y), 9, 0.7, 12)
    want, bias = plain_hinge(rows, y, 0.7, 12)
    assert w.tolist() == pytest.approx([want[k] for k in range(9)])
    assert b == pytest.approx(bias)


# -- language -----------------------------------------------------------------------------------
def plain_margin(text, weights, bias, bits):
    raw = b" ".join(text.lower().encode().split())
    s = b" " + raw + b" " if raw else b""
    grams = [bucket(s[i : i + n], bits) for n in langid.LENGTHS for i in range(len(s) - n + 1)]
    return sum(float(weights[g]) for g in grams) * langid.SCALE / max(len(grams), 1) + bias


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "fr"], ["en", "de", "nl", "fr", "it"], ["en", "de", "fr", "it", "ru", "xx", "yy"]])
def test_votes_equal_plain_loops(langs):
    m = langid.Model(langs)
    rng = np.random.default_rng(len(langs))
    m.weights[:] = rng.normal(size=m.weights.shape) * 0.05
    m.bias[:] = rng.normal(size=len(m.bias)) * 0.1
    names, scores = m.predict(TEXTS)
    sure = lambda x: 1 / (1 + math.exp(-langid.SHARPNESS * min(max(x, -30), 30)))
    for text, name, score in zip(TEXTS, names, scores, strict=True):
        if not re.search(r"[^\W\d_]", text):
            assert (name, score) == ("und", 0)
            continue
        margins = [plain_margin(text, w, b, m.bits) for w, b in zip(m.weights, m.bias, strict=True)]
        families = m.families
        of = dict(zip(families, margins if len(families) > 2 else [margins[0], -margins[0]] if len(families) == 2 else [0.0], strict=False))
        best = max(families, key=of.get)
        lead = sorted(of.values())[-2:]
        p = sure((lead[1] - lead[0]) / 2) if len(lead) == 2 else sure(30)
        pairs = dict(zip(m.pairs, margins[len(m.judged) :], strict=True))
        own = [x for x in m.langs if langid.family(x) == best]
        total, least = dict.fromkeys(own, 0.0), dict.fromkeys(own, 30.0)
        for a, b in combinations(own, 2):
            for x, v in ((a, pairs[a, b]), (b, -pairs[a, b])):
                total[x] += min(max(v, -1), 1)
                least[x] = min(least[x], v)
        want = max(own, key=total.get)
        assert name == want
        assert score == pytest.approx(p * sure(least[want]), abs=1e-4)


def test_many_languages_are_all_learned():
    """None is left out; the table's width shrinks instead."""
    langs = [f"l{i:03d}" for i in range(300)]
    m = langid.Model(langs)
    assert m.langs == langs
    assert len(m.weights) << m.bits <= langid.WEIGHTS
    wide = langid.Model([f"l{i:04d}" for i in range(3000)])
    assert len(wide.weights) << wide.bits <= langid.WEIGHTS
    assert wide.bits < m.bits


def test_fifteen_languages_are_told_apart(spark):
    rng = np.random.default_rng(2)
    codes = ["en", "de", "nl", "fr", "it", "es", "ru", "pl", "fi", "tr", "xx", "yy", "zz", "qa", "qb"]
    word = {c: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(40)] for c in codes}
    rows = [(i, " ".join(rng.choice(word[c], 20)), c) for i, c in enumerate(codes * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = langid.identify(docs).filter("held_out").join(docs, "doc_id").toPandas()
    assert (d["lang"] == d["lang_pred"]).mean() > 0.95


# -- samples ------------------------------------------------------------------------------------
def test_sample_is_bounded_by_characters_of_any_text(spark):
    rows = [(i, "x" * (100 if i % 10 else 5000), str(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, skein_class string")
    texts, classes = common.sampled(df, "s", 20_000)
    for k in "01":
        own = [len(t) for t, c in zip(texts, classes, strict=True) if c == k]
        assert 15_000 <= sum(own) <= 25_000 + 5000
    assert any(len(t) == 5000 for t in texts)
    chosen = common.share_of_class(df, 50, "s").groupBy("skein_class").count().collect()
    assert all(25 <= r["count"] <= 85 for r in chosen)


def test_labels_of_one_id_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, None), (2, None), (3, 7), (4, 1), (None, 1)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", F.lit(True), 100, "s")
    assert got == (["text 0", "text 1", "text 4"], [1, 0, 1])


def test_arrow_settings_are_restored(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k, None) for k in (rows, size)}
    for key, given, inside in ((size, "64MB", str(8 << 20)), (size, "1k", "1k"), (size, None, str(8 << 20)), (rows, "-1", "1000"), (rows, "0", "1000"), (rows, "50", "50"), (rows, None, "1000")):
        spark.conf.unset(key) if given is None else spark.conf.set(key, given)
        kept = spark.conf.get(key, None)
        with common.small_batches(spark):
            assert spark.conf.get(key) == inside
        assert spark.conf.get(key, None) == kept
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_tables_go_when_they_are_done(spark):
    one = storage.written(spark.range(3), "one")
    with storage.temporary(spark) as keep:
        two, three = storage.written(spark.range(4), "two"), storage.written(spark.range(5), "three")
        keep.append(two)
    assert (one.count(), two.count()) == (3, 4)
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT|PATH_NOT"):
        spark.read.parquet(three.skein_path).count()
    storage.dropped(one, two)
    storage.dropped(one)


# -- near-duplicates ----------------------------------------------------------------------------
def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (8, c), (9, ""), (9, c), (10, None), (11, None), (11, ""), (12, "lone text of some words here"), (12, a + " more")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect())
    assert got == Counter([(1, 26, 1, True), (5, 26, 1, False), (5, 26, 1, False), (7, 26, 1, False), (8, 26, 8, True), (9, 0, 8, False), (9, 26, 8, False), (10, 0, 10, True), (11, 0, 11, True), (11, 0, 11, True), (12, 2, 1, False), (12, 27, 1, False)])
    left = sorted(r["doc_id"] for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == [1, 8, 10, 11]


def test_majority_of_a_bucket_goes_to_few_tiles(spark, monkeypatch):
    """Members of a bucket's largest component go to as many tiles as the rest has blocks."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 10)
    members = spark.createDataFrame([(1, i, 0) for i in range(200)] + [(1, 1000 + i, 1000 + i) for i in range(3)] + [(2, i, 0) for i in range(50)], "bucket long, node long, component long")
    low = members.select("node").distinct().selectExpr("node", "1L as n", "cast('' as binary) as low")
    tiles = minhash._tiles(members, low).collect()
    assert Counter(r["node"] for r in tiles if r["component"] == 0) == Counter({i: 1 for i in range(200)})
    met = {frozenset((a["node"], b["node"])) for a in tiles for b in tiles if (a["i"], a["j"]) == (b["i"], b["j"]) and a["component"] != b["component"] and {a["block"], b["block"]} == {a["i"], a["j"]}}
    assert len(met) == 3 * 200 + 3
    assert {r["bucket"] for r in tiles} == {1}


def hot_texts():
    """Short texts: one group of 1,500 near copies of one text, some beyond the threshold, one of 400 exact copies, thirty small
    groups, and 1,200 others."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(3000)]
    text = lambda n=50: list(rng.choice(vocabulary, n))

    def changed(words, most):
        words = list(words)
        for _ in range(rng.integers(0, most + 1)):
            words[rng.integers(0, len(words))] = str(rng.choice(vocabulary))
        return words

    common, copied = text(), text(30)
    made = [changed(common, 3) for _ in range(1500)] + [copied] * 400 + [changed(g, 2) for g in (text() for _ in range(30)) for _ in range(12)] + [text(rng.integers(1, 60)) for _ in range(1200)]
    return [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(made)), made, strict=True)]


@pytest.mark.parametrize("which", ["sf0.1", "hot group"])
def test_recall_against_all_links(spark, which):
    """Components of a whole table against those of every pair that shares a shingle."""
    if which == "hot group":
        docs = spark.createDataFrame(hot_texts(), "doc_id long, text string").repartition(4)
    else:
        docs = spark.read.parquet(f"/root/testdata/{which}/documents.parquet").select("doc_id", "text")
    rows = docs.toPandas()
    sets = {i: minhash.shingles(t) for i, t in zip(rows["doc_id"], rows["text"], strict=True)}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i].tobytes(), i)
    classes = {i: sets[i] for k, i in first.items() if k}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)  # prefixes by rarity: two similar sets share one of their rarest quarter
    counts = Counter(x for s in classes.values() for x in s.tolist())
    for i, s in classes.items():
        rare = sorted(s.tolist(), key=lambda x: (counts[x], x))
        for x in rare[: len(rare) - math.ceil(0.75 * len(rare)) + 1]:
            by[x].append(i)
    seen = set()
    for group in by.values():
        for a, b in combinations(group, 2):
            x, y = sorted((len(classes[a]), len(classes[b])))
            if root(a) != root(b) and 100 * x >= 75 * y and (a, b) not in seen:
                seen.add((a, b))
                n = len(np.intersect1d(classes[a], classes[b], assume_unique=True))
                if 100 * n >= 75 * (x + y - n):
                    u, v = root(a), root(b)
                    parent[max(u, v)] = min(u, v)
    want = {i: root(first[s.tobytes()]) if len(s) else i for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in minhash.link_documents(docs)[0].collect()} == want


def test_words_made_to_collide_stay_apart(spark):
    """The Thue-Morse word and its complement have equal sums modulo 2^64 in any base."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    assert len(np.intersect1d(minhash.shingles(a), minhash.shingles(b))) == 0
    shown, links = minhash.link_documents(spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y z v"), (4, f"{b} x y z v")], "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in shown.collect()} == {(i, i, True) for i in (1, 2, 3, 4)}
    assert links.count() == 0


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(minhash, "KEPT_WORDS", 3)
    text = " ".join(f"w{i}" for i in range(20)) + " " + "x" * 100
    want, minhash._words = minhash.shingles(text), minhash._Words()
    assert np.array_equal(minhash.shingles(text), want) and len(minhash._words) <= 3


def test_near_duplicates_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(f"{i % 9}w{k}" for k in range(20)), "x") for i in range(40)] + [(3, "other words", "y"), (None, "a b", "z"), (None, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    want = sorted(map(tuple, minhash.drop_near_duplicates(docs).collect()), key=str)
    monkeypatch.setattr(minhash, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, minhash.drop_near_duplicates(docs).collect()), key=str) == want and len(want) == 11


# -- vectors ------------------------------------------------------------------------------------
def test_a_pair_at_the_threshold_is_linked(spark):
    """A cosine of 0.9 in double precision, from vectors of any size; one that is a little less is none."""
    y = (1 - 0.81) ** 0.5
    for size in (1.0, 1e-150, 1e150, 3e-7):
        rows = [(1, [size, 0.0]), (2, [0.9, y]), (3, [0.0, size * 2]), (4, [0.9 * (1 - 1e-14), y])]
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert got == {1: (1, 1), 2: (2, 1), 3: (0, 3), 4: (1, 1)}


# -- archives -----------------------------------------------------------------------------------
def test_revisits_name_a_response_with_their_payload(spark, tmp_path, monkeypatch):
    """Each revisit's response, read through the index, has the digest and length that the revisit states;
    on both sides of the switch of joins."""
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"body {i % 7}" * (i % 7)) for i in range(60)], "page_id long, url string, html string").repartition(3)
    for k, most in enumerate((500_000, 0)):
        monkeypatch.setattr(warc, "MOST_BROADCAST", most)
        folder = f"file://{tmp_path}/{k}"
        captures = warc.write_archives(pages, folder)
        reader = warc.Reader(folder, warc.write_index(captures, folder))
        by = {r["id"]: (r["url_key"], r["id"], r["digest"], r["type"]) for r in captures.collect()}
        revisits = 0
        for key in by.values():
            fields, block = reader.record(reader.find(key))
            if fields["warc-type"] == "revisit":
                revisits += 1
                said, payload = reader.record(reader.find(by[fields["warc-refers-to"][len("<urn:x-page:") : -1]]))
                assert said["warc-type"] == "response"
                body = payload.partition(b"\r\n\r\n")[2]
                assert f"Content-Length: {len(body)}\r\n".encode() in block
                assert fields["warc-payload-digest"] == f"sha1:{warc.digest(body)}"
        assert revisits == 53


def test_ids_that_are_empty_null_or_repeated(spark, tmp_path):
    odd = [None, "", "\\", "\\\\", "a\\", " "]
    pages = [(i, f"http://h.org/{k}", f"body {k}") for k, i in enumerate(odd)] + [("", "http://h.org/z", "same"), ("b", None, "same"), (None, None, "same")]
    pages += [("r", "http://r.org/2", "twice"), ("r", "http://r.org/1", "twice"), ("r", "http://r.org/1", "twice"), ("s", "http://r.org/1", "twice"), ("r", None, "other"), ("r", None, "other")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    want = Counter((i, 6, "response", None) for i in odd) + Counter([("", 4, "response", None), ("b", 4, "revisit", ""), (None, 4, "revisit", "")])
    want += Counter([("r", 5, "response", None), ("r", 5, "revisit", "r"), ("r", 5, "revisit", "r"), ("s", 5, "revisit", "r"), ("r", 5, "response", None), ("r", 5, "revisit", "r")])
    assert got == want


# -- pipeline -----------------------------------------------------------------------------------
CLASHES = ("score", "digest", "n", "node", "kept", "skein_row", "skein_finds", "skein_spans", "skein_doc", "skein_text", "odd.name", "component_id", "words")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8)))
    rows = [(i, " ".join(word() for _ in range(40)) + (". token=abcdef123 " if i % 5 == 0 else "."), "en", f"src{i % 4}", None) for i in range(120)]
    rows += [(200 + i, "### " * 60, "en", "src1", 1) for i in range(40)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " \n ", None, "s", 3), (None, rows[3][1], "en", "s", 1), rows[4], rows[4], (5, rows[6][1], "en", "s", 1), (303, rows[7][1] * 3000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in CLASHES if "." not in c}).withColumn("odd.name", F.lit("clash"))
    folder = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(40)] + [(1, None, None), (None, 1, 1), (3, 9, 9)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, schema = docs.columns, docs.schema.simpleString()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, odd).write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert made.columns == columns
            assert made.schema.simpleString() == schema
            assert made.filter("score != 'clash' or `odd.name` != 'clash'").count() == 0
            before, docs = docs, made
    ids = {r["doc_id"] for r in before.select("doc_id").collect()}
    assert {r["doc_id"] for r in made.select("doc_id").distinct().collect()} == ids
    assert not ids & set(range(200, 240))
    assert docs.filter("text like '%abcdef123%'").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, odd).select("doc_id").collect()} == ids


def test_pipeline_takes_no_rows(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ngrams_of_nothing():
    flat, starts = ngrams.joined(["", "", "a"], lower=True, words=True)
    assert flat.tobytes() == np.array([32, 97, 32], np.uint32).tobytes()
    assert starts.tolist() == [0, 0, 0, 3]
    assert [len(ngrams.hashed(flat[:0], n, 8)) for n in (1, 2, 6)] == [0, 0, 0]
