"""Ranked search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from seriloom.llm import lexical
from tests.llm.conftest import CLASHING

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc_id, _), count, n in zip(docs, counts, sizes):
            m = 100 - 25 + (25 * n * n_docs) // n_terms if n_terms else 0
            score = 0
            for t in terms(text):
                if count[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * count[t]) // (1000 * count[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort()
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(found[:top], 1)]
    return sorted(map(str, out))


def found(frame):
    return sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in frame.collect())


@pytest.mark.parametrize("chunk_bytes", [1 << 18, 2000])
def test_every_document_scored(spark, documents, chunk_bytes):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(5)
    want = plain(list(documents.items()), [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical.search(docs, items, chunk_bytes=chunk_bytes)) == want


def test_odd_rows(spark, odd, odd_rows, none):
    asked = [(1, "Fox, FOX and the dog"), (1, "Fox, FOX and the dog"), (2, None), (3, ""), (4, "w1x1 w5x5"), (5, "!!"), (None, "straße 你好"), (6, "nowhere"), (7, "three x")]
    items = spark.createDataFrame([(*a, "z", 1, "z", "z", "z", 2, "z", "z", "z") for a in asked], f"item_id long, text string, {CLASHING}")
    docs = [(i, t) for i, t, *_ in odd_rows]
    assert found(lexical.search(odd, items)) == plain(docs, asked)
    assert found(lexical.search(odd, items, top=2)) == plain(docs, asked, 2)
    assert lexical.search(none, items).collect() == [] and lexical.search(odd, items.filter("false")).collect() == []
    # only documents without a term
    assert lexical.search(odd.filter("doc_id < 4"), items).collect() == []


def test_many_equal_scores_go_by_id(spark):
    docs = spark.createDataFrame([(i * 7919 % 5003, "same words here" if i % 2 else "other text") for i in range(5000)], "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([(0, "same words")], "item_id long, text string")
    got = [r.doc_id for r in lexical.search(docs, items).orderBy("rank").collect()]
    assert got == sorted(i * 7919 % 5003 for i in range(5000) if i % 2)[:20]


def test_signatures_never_say_too_little():
    rng = np.random.default_rng(1)
    n, terms_of_all = 300, 900
    entries = rng.random((n, terms_of_all)) < 0.1
    docs, term = np.nonzero(entries)
    counts = rng.integers(1, 9, len(docs))
    hashes = rng.integers(0, 1 << 63, terms_of_all).astype(np.uint64)
    slices = lexical.signatures(n, docs, hashes[term], counts, 2048)
    highest = np.zeros(n, np.int64)
    np.maximum.at(highest, docs, counts)
    m = rng.integers(75, 200, n)
    limits = lexical.bounds(slices, 2048, hashes, highest, m)
    true = np.zeros((terms_of_all, n))
    true[term, docs] = lexical.worth(counts, m[docs])
    assert (limits >= true * (1 - 1e-6)).all()
    assert (limits[true == 0] == 0).mean() > 0.8  # most absent terms are seen to be absent
