"""Language models as sorted arrays, against dictionaries of whole texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriloom.llm import ngram_arrays as na
from seriloom.llm import quality
from seriloom.llm.kneser_ney import discounts_of
from tests.llm import brute

TEXTS = [
    "the quick brown fox jumps over the lazy dog while seven birds sing",
    "The quicker  foxes\nlazily dogged the brown birds, then quite brownish",
    "über die Straße naïve café 你好 世界 🙂 and the fox",
    "a b c the the the fox of the river and the old tree",
    "some other words about the quick river and its seven foxes",
    "birds of the lazy river sing while the dog jumps over a fox",
    "",
    None,
    " \n ",
    "x",
]


def symbols(text):
    words = brute.WORD.findall(text or "")
    return [*([na.START] * 4), *na.classes(np.array([ord(c) for c in " ".join(words)], np.uint32)).tolist(), na.END] if words else []


def plain_model(texts):
    """Probability of a symbol after four others, with dictionaries."""
    grams = {5: Counter()}
    for t in texts:
        s = symbols(t)
        grams[5].update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    plain = grams[5]
    for k in (4, 3, 2, 1):
        longer, before, sums = plain, defaultdict(set), Counter()
        for g, n in longer.items():
            sums[g[1:]] += n
            before[g[1:]].add(g[0])
        plain = sums
        grams[k] = {g: n if g[0] == na.START else len(before[g]) for g, n in sums.items()}
    d = {k: discounts_of([float(sum(n == i for n in grams[k].values())) for i in range(1, 5)]) for k in grams}
    total, less = defaultdict(float), defaultdict(float)
    for k in grams:
        for g, n in grams[k].items():
            total[k, g[:-1]] += n
            less[k, g[:-1]] += d[k][min(n, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / max(len(grams[1]) + 1, 2)
        lower, n = p(g[1:]), grams[k].get(g, 0)
        if not total[k, g[:-1]]:
            return lower
        return ((n - d[k][min(n, 3)] if n else 0.0) + less[k, g[:-1]] * lower) / total[k, g[:-1]]

    return p


@pytest.mark.parametrize("repeat", [1, 7])
def test_log_perplexity_of_whole_texts(spark, repeat):
    rows = [(100 * k + i, t, "de" if i == 2 else "en") for k in range(repeat) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    halves = {r.doc_id: r.h for r in docs.select("doc_id", na.half_of(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    models = {}
    for lang in ("de", "en"):
        for h in (0, 1):
            own = [t for i, t, x in rows if x == lang and halves[i] == h and symbols(t)]
            models[lang, h] = plain_model(own) if own else lambda g: math.exp(na.UNKNOWN)
    got = {r.doc_id: r.log_perplexity for r in quality.measures(docs).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        s, p = symbols(t), models[lang, 1 - halves[i]]
        want = -sum(math.log(p(tuple(s[k - 4 : k + 1]))) for k in range(4, len(s))) / max(len(s) - 4, 1)
        assert math.isclose(got[i], want, rel_tol=1e-5, abs_tol=1e-6)


def test_arrays_keep_their_numbers():
    x = np.unique(np.random.default_rng(3).integers(0, 1 << 60, 5000))
    assert np.array_equal(na.opened_ascending(na.shut_ascending(x)), x)
    assert len(na.opened_ascending(na.shut_ascending(x[:0]))) == 0
    assert np.array_equal(na.opened(na.shut(x), np.int64), x)


def test_letters_below_the_border_are_themselves():
    points = np.array([10, 32, 97, 0xE9, 0x44F, 0x7FF, 0x4F60, 0x1F642], np.uint32)
    got = na.classes(points)
    assert got[:6].tolist() == points[:6].tolist() and (got[6:] >= na.PLAIN).all() and (got < na.LETTERS).all()


def test_events_by_hand():
    sizes, grams = na.events_of(pa.array(["ab c", None, "  ", "d"]))
    assert sizes.tolist() == [5, 0, 0, 2]
    spelt = [tuple(int(g) >> (12 * j) & 4095 for j in (4, 3, 2, 1, 0)) for g in grams]
    s = na.START
    assert spelt[:3] == [(s, s, s, s, ord("a")), (s, s, s, ord("a"), ord("b")), (s, s, ord("a"), ord("b"), ord(" "))]
    assert spelt[-1] == (s, s, s, ord("d"), na.END)


def test_merging_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(na, "FAN_IN", 2)
    rows = [(p, "en", 0, 1, na.shut_ascending(np.array([1, 5, 900 + p])), na.shut(np.array([1, 2, 3]))) for p in range(9)]
    asked = spark.createDataFrame(rows, f"packet long, {na.ARRAYS}")
    r = na.merged(asked, 9).collect()
    assert len(r) == 1
    assert na.opened_ascending(r[0].grams).tolist() == [1, 5, *range(900, 909)] and na.opened(r[0].counts, np.int64).tolist() == [9, 18, *[3] * 9]


def test_wrong_language_is_far_and_length_classes_have_their_own_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    swapped = docs.filter("lang = 'en' AND doc_id % 97 = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("fr").alias("lang"))
    rows = quality.judge(spark, docs.union(swapped)).collect()
    passing = [r for r in rows if not r.base_failed]
    wrong = [r for r in passing if r.doc_id >= 10**6]
    assert wrong and not any(r.kept for r in wrong)
    right = [r for r in passing if r.doc_id < 10**6]
    assert np.mean([r.kept for r in right]) > 0.95
