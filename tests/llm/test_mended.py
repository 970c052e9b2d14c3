"""Cases that once had a wrong, cut or unbounded result."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import packing, pii, queries, toxicity, urltree, winnow
from txrisk.llm.tokens import Encoder

# -- op9: folding and depth ------------------------------------------------------------


def judged(spark, paths, labels=None, host="h.test"):
    rows = [(i, f"http://{host}{p}") for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    marks = None if labels is None else spark.createDataFrame(labels, "page_id long, bad int")
    got = urltree.judged(df, urltree.rules_table(spark, queries.RULES), marks).collect()
    return [r for r in sorted(got, key=lambda r: r.page_id)]


def test_op9_clean_pages_beside_a_blocked_branch(spark):
    """Eleven blocked pages under one segment say nothing about thirty other segments."""
    paths = [f"/de/{'abcdefghijk'[i]}" for i in range(11)] + [f"/{chr(97 + i)}{chr(97 + i)}x{i // 26}z" for i in range(30)]
    got = judged(spark, paths, host="www.example.com")
    assert [r.verdict for r in got] == ["block"] * 11 + ["allow"] * 30
    assert {r.rule for r in got[11:]} == {None}


@pytest.mark.parametrize("bad", [1, 4, 9])
def test_op9_few_labelled_pages_take_no_others_along(spark, bad):
    paths = [f"/ads{i}x/p" for i in range(0)] + [f"/bad/{'x' * (i + 1)}" for i in range(bad)] + ["/news", "/about", "/x/5"]
    got = judged(spark, paths, [(i, 1) for i in range(bad)])
    assert [r.verdict for r in got[bad:]] == ["allow"] * 3


def test_op9_templates_of_labelled_pages_judge_the_others_of_their_shape(spark):
    """Numbers are one shape, and labelled branches that look alike are one template."""
    paths = [f"/ads/{i}" for i in range(30)] + [f"/news/{i}" for i in range(30)]
    paths += [f"/promo/{'abcdefghij'[i]}/{j}" for i in range(10) for j in range(6)]
    labels = [(i, 1) for i in range(0, 30, 3)] + [(i, 0) for i in range(30, 60, 3)] + [(i, 1) for i in range(60, 120, 2)]
    got = judged(spark, paths, labels)
    assert {r.verdict for r in got[:30]} == {"block"} and {r.verdict for r in got[30:60]} == {"allow"}
    assert {r.verdict for r in got[60:]} == {"block"} and {r.template for r in got[60:]} == {"/promo/?/#"}


def test_op9_variable_segments(spark):
    """Many small children of a kind become a wildcard, those of the other kind another one."""
    small = [f"/{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    got = judged(spark, small, [(i, 1) for i in range(25)])
    assert {r.template for r in got[:25]} == {"/?"} and {r.template for r in got[25:]} == {"/??"}
    assert {r.verdict for r in got[25:]} == {"allow"}


def test_op9_long_paths_take_few_rounds(spark):
    """What paths share is passed in one step: three hundred segments as fast as five."""
    took = {}
    for n in (5, 300):
        base = "".join(f"/s{'x' * (i % 7)}" for i in range(n))
        start = time.perf_counter()
        got = judged(spark, [base + "/left/a", base + "/right/b", base])
        took[n] = time.perf_counter() - start
        assert [r.template for r in got] == [base + "/left/a", base + "/right/b", base]
    assert took[300] < 2 * took[5] + 5


def test_op9_repeated_pages_and_odd_urls(spark):
    rows = [(1, "http://a.test/x"), (1, "http://a.test/x"), (None, None), (2, "no scheme"), (3, "http://"), (4, "http://a.test" + "/y" * 3000)]
    df = spark.createDataFrame([(*r, "h", 1.0, "t") for r in rows], "page_id long, url string, host string, purity double, template string")
    rules = urltree.rules_table(spark, queries.RULES)
    got = urltree.judged(df, rules).collect()
    assert sorted((r.page_id or 0) for r in got) == [0, 1, 1, 2, 3, 4]
    assert {r.verdict for r in got} == {"allow"}
    assert urltree.judged(df.limit(0), rules).collect() == []


# -- op5: candidates of any length ----------------------------------------------------------


def test_op5_long_names_and_hosts():
    name = "n" * 70
    text = f"mail {name} (at) example.com or bob (at) a1.b2.c3.d4.e5.f6.com now"
    found = {text[a:b] for k, a, b, sure in pii.candidates(text) if k == "email" and not sure}
    assert found == {f"{name} (at) example.com", "bob (at) a1.b2.c3.d4.e5.f6.com"}


def test_op5_long_runs_take_linear_time():
    start = time.perf_counter()
    for text in ("a" * 300_000, "a." * 150_000 + " (at) " + "b." * 150_000, "x at " * 60_000, "a (at) b dot " * 30_000):
        pii.candidates(text)
    assert time.perf_counter() - start < 10


def _plain_em(votes, sure, n, rounds=50):
    """The estimate of ``reliabilities`` with loops."""
    posterior = [1.0 if s else 1 / (1 + math.exp(-sum(v))) for v, s in zip(votes, sure)]
    width = len(votes[0])
    prior = {0: (2.0, 2.0, 1.0), 1: (1.0, 2.0, 2.0)}
    for _ in range(rounds):
        rates = {}
        for labeler in range(width):
            for c in (0, 1):
                cell = list(prior[c])
                for v, p, m in zip(votes, posterior, n):
                    cell[v[labeler] + 1] += m * (p if c else 1 - p)
                rates[labeler, c] = [x / sum(cell) for x in cell]
        free = [(p, m) for p, m, s in zip(posterior, n, sure) if not s]
        share = (sum(p * m for p, m in free) + 1) / (sum(m for _, m in free) + 2)
        new = []
        for v, s in zip(votes, sure):
            odds = [math.log(1 - share), math.log(share)]
            for c in (0, 1):
                odds[c] += sum(math.log(rates[i, c][v[i] + 1]) for i in range(width))
            new.append(1.0 if s else 1 / (1 + math.exp(min(40, max(-40, odds[0] - odds[1])))))
        posterior = new
    return posterior, share, rates


def test_op5_estimate_equals_plain():
    rng = np.random.default_rng(4)
    votes = rng.integers(-1, 2, (40, 5))
    sure, n = rng.random(40) < 0.2, rng.integers(1, 50, 40).astype(float)
    got, share, rates = pii.reliabilities(votes, sure, n)
    want, plain_share, plain_rates = _plain_em(votes.tolist(), sure.tolist(), n.tolist())
    assert np.allclose(got, want, atol=1e-9) and abs(share - plain_share) < 1e-9
    assert all(np.allclose(rates[i, c], plain_rates[i, c], atol=1e-9) for i in range(5) for c in (0, 1))


def test_op5_classifier_is_where_its_loss_is_least(spark):
    """The weights are a stationary point of the ridge-regularised log loss over all patterns."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.pattern_counts(docs).collect()
    model = pii.fit(docs)
    target = {}
    for kind in pii.KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if own:
            p, _, _ = _plain_em([r["votes"] for r in own], [r["sure"] for r in own], [float(r["n"]) for r in own])
            target |= {(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["sure"]): q for r, q in zip(own, p)}
    total = sum(r["n"] for r in rows)
    gradient = 1e-4 * model.weights
    for r in rows:
        key = (r["kind"], tuple(r["votes"]), tuple(r["features"]))
        x = pii._vector(*key)
        gradient = gradient + x * (model.probability(key) - target[(*key, r["sure"])]) * r["n"] / total
    assert np.abs(gradient).max() < 1e-6


def test_op5_added_spans_on_planted_data(spark):
    """Personal data in a form that the base patterns miss, beside numbers of the same shape that are none."""
    import random

    random.seed(7)
    rows, truth, traps = [], {}, {}
    for i in range(400):
        d = lambda n: "".join(random.choices("123456789", k=n))
        name = "".join(random.choices("abcdefgh", k=6))
        good = random.choice([
            ("email", "please write to email ", f"{name} (at) {name}.com"),
            ("ssn", "her social security ssn ", f"{random.randint(101, 665)}-{random.randint(10, 99)}-{random.randint(1000, 9999)}"),
            ("phone", "call my phone ", f"({random.randint(201, 989)}) {d(3)}-{d(4)}"),
        ])
        text = good[1] + good[2]
        truth[i] = (good[0], len(good[1]), len(text))
        trap = " and see invoice number "
        text += trap
        bad = f"{random.choice(['000', '666'])}-00-0000"
        traps[i] = (len(text), len(text) + len(bad))
        rows.append((i, text + bad + " again"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs, pii.fit(docs)).collect()}
    found = {i: {tuple(s.split(":")) for s in spans.split(",") if s} for i, spans in got.items()}
    hits = sum((k, str(a), str(b)) in found[i] for i, (k, a, b) in truth.items())
    wrong = sum(any(int(s[1]) < b and a < int(s[2]) for s in found[i]) for i, (a, b) in traps.items())
    assert hits >= 0.95 * len(truth) and wrong <= 0.05 * len(traps)


# -- op2: a bounded sample -----------------------------------------------------------------------


def test_op2_sample_is_bounded(spark):
    """One label and very many rows of its document are one row of the sample, or one per text."""
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    other = spark.range(3000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = same.union(other)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled(docs, labels, 50).collect()
    assert len(rows) <= 50 and {r.grade for r in rows} <= {0, 2}
    assert toxicity.labelled(same, labels, 50).count() == 1


def test_op2_expected_grade_equals_plain(spark):
    """Severity is the sum of the thresholds' probabilities over the distinct words of a text."""
    from txrisk.llm.words import batches
    import pyarrow as pa

    rng = np.random.default_rng(3)
    model = toxicity.OrdinalModel(rng.normal(0, 1, toxicity.FEATURES), np.array([0.5, 1.7]))
    rows = [(1, "Some words some WORDS more"), (2, ""), (3, None), (4, "other, words! 12 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for doc, text in rows:
        words = (text or "").lower().replace(",", " ").replace("!", " ").split()
        seen = set()
        for word in words:
            for _, _, found, _ in batches(pa.array([word])):
                seen.add(int(found[0] & np.uint64(toxicity.FEATURES - 1)))
        z = sum(model.weights[f] for f in seen)
        above = [1 / (1 + math.exp(-(z - t))) for t in model.thetas]
        assert abs(got[doc].severity - sum(above)) < 1e-9 and abs(got[doc].p_toxic - above[0]) < 1e-9
        assert got[doc].toxic == (bool(seen) and above[0] >= 0.5)


def test_op2_weights_are_shared_and_thresholds_rise(spark):
    docs = spark.createDataFrame([(i, ("bad awful " if i % 3 else "nice fine ") + f"w{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 2), int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.thetas[0] <= model.thetas[1] and model.weights.ndim == 1
    flagged = {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()}
    assert flagged == {i for i in range(300) if i % 3}


# -- op1, op4: pieces and cuts ---------------------------------------------------------------------


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_equal_whole_texts(name, drops):
    import random

    random.seed(1)
    parts = ["a", "B", " ", "\n", ".", ",", "é", "日", "<|endoftext|>", "1", "  ", "\t", "'s", "word", " The", "!?", "x" * 70]
    texts = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(4000)]
    coder = Encoder(queries._vocabulary(name), drops, limit=50)
    assert list(coder.ids(texts)) == [coder.whole(x) for x in texts]
    assert list(coder.ids([])) == []


def test_op4_a_word_is_merged_once_however_it_is_written():
    """Capitals, marks and line ends once made other pieces of a word, and each was merged anew."""
    coder = Encoder(queries._vocabulary("word_bpe_49k.json"), True)
    merges, met = coder.merges, []
    coder.merges = lambda letters: met.append(letters) or merges(letters)
    texts = ["Zorbling\nzorbling, ZORBLING?! (zorbling) \"Zorbling\"; zorbling... québrox", "QUÉBROX. Zorbling"]
    assert list(coder.ids(texts)) == [coder.whole(x) for x in texts]
    assert len(met) == 2 and met[0] == "zorbling"


def test_op4_latin_1_pieces_equal_whole_texts():
    """Every character beside letters, marks, numbers and apostrophes, and mixtures of them."""
    import random

    random.seed(4)
    every = [chr(i) for i in range(256)]
    texts = [a + c + b for c in every for a, b in (("x", "Yz"), ("x.", "x"), ("'", "s"), ("", "'s, d"), ("1", "2"))]
    parts = [*every[:48], *every[160:192], "It's", "'", "don't", "'re", "..", "<|EndOfText|>", "<|endoftext|>", "Ñandú", "×", "\u0301", "’", "Σ", "İ"]
    texts += ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(3000)]
    coder = Encoder(queries._vocabulary("word_bpe_49k.json"), True, limit=50)
    assert list(coder.ids(texts)) == [coder.whole(x) for x in texts]


def test_op4_cuts_at_sentences_where_they_fit():
    """With an end of a sentence every thirty ids, hardly a cut lies inside a sentence."""
    n = 400_000
    rng = np.random.default_rng(2)
    sentences = np.cumsum(rng.integers(10, 50, n // 30))
    sentences = sentences[sentences < n]
    documents = np.append(sentences[::40], n)
    at = packing.cuts(n, documents, sentences)
    fits = set(sentences.tolist()) | set(documents.tolist())
    inside = sum(c not in fits for c in at[1:])
    assert inside <= 0.05 * len(at) and (len(at) - 1) * 2048 < 1.01 * n + 2048
    # Without any, the grid keeps windows full.
    bare = packing.cuts(n, np.array([n]), np.array([], int))
    assert all(b - a == 2048 for a, b in zip(bare[:-2], bare[1:-1]))


# -- op10: selected fingerprints ----------------------------------------------------------------------


def test_op10_each_fingerprint_once(spark):
    """A text of one repeated word has one fingerprint and is hit in every place."""
    docs = spark.createDataFrame([(1, "Same " * 500), (2, "same " * 12), (None, "x SAME " + "same " * 13), (3, None), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "same " * 20), ("r", "x same")], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in winnow.contamination(docs, bench).collect())
    assert got == [(0, 15, 15, 2, True), (1, 500, 500, 1, True), (2, 12, 0, 0, False), (3, 0, 0, 0, False), (3, 0, 0, 0, False)]
    marked = winnow.minima(docs.where("doc_id = 1").select(winnow.raw_words_of("text").alias("words")), 13, 13)
    assert marked.select(F.size(F.array_distinct("m"))).first()[0] == 1


def test_op10_capitals_outside_ascii_differ(spark):
    """Only A-Z become lower case for the comparison, whatever the hash does."""
    words = " ".join(f"wört{i}" for i in range(13))
    docs = spark.createDataFrame([(1, words.upper().replace("Ö", "ö")), (2, words.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([("q", words)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in winnow.contamination(docs, bench).collect()} == {1: 13, 2: 0}


def test_op10_empty_benchmark_and_table(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "some words")], "item_id string, text string")
    assert [r.n_words for r in winnow.contamination(docs, bench.limit(0)).orderBy("doc_id").collect()] == [3, 0]
    assert winnow.contamination(docs.limit(0), bench).collect() == []
    assert winnow.clean(docs, bench).collect() == [r for r in docs.collect() if r.doc_id == 2]
