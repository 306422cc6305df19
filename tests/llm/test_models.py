"""Letter models, toxicity, quality rules and language profiles."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriloom.llm import catalog, kneser_ney, language, quality, toxicity
from tests.llm import brute
from tests.llm.conftest import SF

LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def plain_model(words, order):
    """Modified Kneser-Ney with dictionaries: log-probability of a word."""
    events = Counter()
    for w, n in words.items():
        s = ["^"] * (order - 1) + list(w.lower()) + ["$"]
        for i in range(order - 1, len(s)):
            events[tuple(s[i - order + 1 : i + 1])] += n
    grams = [None] * (order + 1)
    grams[order] = events
    for k in range(order - 1, 0, -1):
        plain, before = Counter(), defaultdict(set)
        for g, n in events.items():
            plain[g[-k:]] += n
            before[g[-k:]].add(g[-k - 1])
        grams[k] = {g: n if g[0] == "^" else len(before[g]) for g, n in plain.items()}
    discounts = [None] + [kneser_ney.discounts(np.array(list(grams[k].values()))) for k in range(1, order + 1)]
    totals, taken = [None], [None]
    for k in range(1, order + 1):
        total, less = Counter(), Counter()
        for g, n in grams[k].items():
            total[g[:-1]] += n
            less[g[:-1]] += discounts[k][min(n, 3)]
        totals.append(total)
        taken.append(less)

    def probability(g, k):
        if k == 0:
            return 1.0 / (len(grams[1]) + 1)
        own, context = g[-k:], g[-k:-1]
        lower = probability(g, k - 1)
        if context not in totals[k]:
            return lower
        n = grams[k].get(own, 0)
        seen = (n - discounts[k][min(n, 3)]) if n else 0.0
        return (seen + taken[k][context] * lower) / totals[k][context]

    def score(w):
        s = ["^"] * (order - 1) + list(w.lower()) + ["$"]
        return sum(math.log(probability(tuple(s[i - order + 1 : i + 1]), order)) for i in range(order - 1, len(s)))

    return score, probability, grams


def test_letter_model_equals_dictionaries(spark):
    text = "the quick brown fox the lazy dog The quicker foxes lazily dogged than then quite brownish " * 3 + "über straße"
    docs = spark.createDataFrame([(text, 0), ("another fox text", 0), (None, 0), ("", 0)], "text string, group int")
    model = kneser_ney.fit(kneser_ney.ngram_counts(docs, order=4, bits=24), order=4, bits=24)
    words = Counter(brute.WORD.findall(text) + ["another", "fox", "text"])
    score, probability, grams = plain_model(words, 4)
    asked = ["the", "fox", "quickest", "zzz", "Über", "brownish"]
    events, logs = model.word_scores(asked)
    assert events.tolist() == [len(w) + 1 for w in asked]
    assert np.allclose(logs[0], [score(w) for w in asked], rtol=1e-4)
    letters = {g[-1] for g in grams[1]}  # shares of all letters and of an unseen one add up to one
    for context in [("^", "^", "t"), ("t", "h", "e")]:
        assert math.isclose(sum(probability((*context, x), 4) for x in letters) + probability((*context, "unseen"), 4), 1.0, rel_tol=1e-9)


def test_letter_model_of_nothing(spark, none):
    model = kneser_ney.fit(kneser_ney.ngram_counts(none.select("text", F.lit(0).alias("group"))))
    assert model.word_scores([])[0].tolist() == []
    assert np.isfinite(model.word_scores(["a"])[1]).all()


def test_toxicity_on_held_out_documents(spark):
    rows = catalog.QUERIES["op4_toxicity"](spark, LARGEST).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGEST}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LARGEST}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for t, s in known if t], [s for t, s in known if not t]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert np.mean([s < 0.5 for s in clean]) > 0.95


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    assert len(toxicity.score(spark, odd, labels).collect()) == len(odd_rows)
    assert toxicity.score(spark, none, labels).collect() == []
    unlabelled = toxicity.score(spark, odd, labels.filter("false")).collect()
    assert len(unlabelled) == len(odd_rows) and all(r.score < 1e-6 and r.predicted == 0 for r in unlabelled)


def test_logistic_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 10)
    w, b = toxicity.logistic(x, (x[:, 0] > 1.5).astype(float))
    assert w[0] > 0 and 1.2 < -b / w[0] < 1.8


def test_quality_counts(spark, documents):
    for r in catalog.QUERIES["op5_quality"](spark, SF).collect():
        n, chars, symbols, lines, repeats = expected = brute.base_quality(documents[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.kept and r.base_failed)


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    rows = quality.judge(spark, odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in odd_rows)
    by_text = {i: brute.base_quality(t) for i, t, *_ in odd_rows}
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:6] == by_text[r.doc_id]
    assert quality.judge(spark, none).collect() == []
    kept = quality.accepted(spark, odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)


def test_repeated_words_by_hand():
    def of(text):
        words = text.split()
        codes = {w: i for i, w in enumerate(words)}
        values = np.array([hash(codes[w]) + 1 for w in words], np.uint64)
        return quality.repeated_words(np.array([0, len(words)]), values, 8)[0]

    assert of("a b c d e f g h") == 0
    assert of("a b c d e f g h x a b c d e f g h") == 16
    assert of("a " * 9) == 9  # overlapping windows
    assert quality.repeated_lines("a\n\na\n \nb\nb\nb") == 3


def test_bands_reject_only_what_is_far(spark):
    usual = [(i, " ".join(f"some usual words number {k % 7} of text" for k in range(i % 5 + 8))) for i in range(60)]
    far = [(100, " ".join("xqzvj kkwq zzxy qqvx jjqz"[k % 5 :] + "qx" * (k % 3) + chr(97 + k % 26) * (k % 4) for k in range(60)))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in usual + far], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.judge(spark, docs, width=6.0, least=0.1).collect()}
    ppl = {i: r.log_perplexity for i, r in rows.items() if not r.base_failed}
    assert all(rows[i].kept for i in ppl if i < 100)
    if 100 in ppl:
        assert not rows[100].kept


def test_language_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = catalog.QUERIES["op8_language"](spark, LARGER).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.98


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    rows = language.predict(spark, odd).collect()
    assert len(rows) == len(odd_rows)
    texts = {i: t for i, t, *_ in odd_rows}
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert language.predict(spark, none).collect() == []
    untaught = language.predict(spark, odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in untaught)


def test_profiles_bind_permute_and_bundle():
    rows, some = language.profiles(pa.array(["Ab", "12 !", None, "ab ab"]), 256, 3)
    assert some.tolist() == [True, False, False, True]
    vectors = {c: language.letter_vectors(np.array([ord(c)]), 256)[0].astype(float) for c in " ab"}

    def gram(x, y, z):
        return np.roll(vectors[x], 2) * np.roll(vectors[y], 1) * vectors[z]

    one = gram(" ", "a", "b") + gram("a", "b", " ")
    assert np.array_equal(rows[0], one)
    assert np.array_equal(rows[3], 2 * one + gram("b", " ", "a"))


@pytest.mark.parametrize("pieces", [1, 4])
def test_prototypes_do_not_depend_on_partitions(spark, pieces):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = language.prototypes(docs.coalesce(1), 128)
    more = language.prototypes(docs.repartition(pieces), 128)
    assert set(one) == set(more) and all(np.allclose(one[k], more[k], atol=1e-3) for k in one)
