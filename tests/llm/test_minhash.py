"""Near-duplicates against all pairs."""

import random

import numpy as np
import pyarrow as pa

from seriloom.llm import catalog, minhash
from tests.llm import brute
from tests.llm.conftest import SF


def test_query_equals_all_pairs(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in catalog.QUERIES["op3_minhash"](spark, SF).collect()}
    expected = brute.components(documents)
    assert got == {i: (len(brute.shingles(t)), expected[i], expected[i] == i) for i, t in documents.items()}


def test_odd_rows(spark, odd, odd_rows, none):
    rows = minhash.near_duplicates(spark, odd).collect()
    assert len(rows) == len(odd_rows)
    expected = brute.components({i: t for i, t, *_ in odd_rows if i is not None})
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (expected[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(spark, none).collect() == []


def families(seed):
    """Chains, stars and a large family of edited copies, most of them not similar enough to each other."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts, i = {}, 0
    for _ in range(6):
        words = [random.choice(vocabulary) for _ in range(120)]
        for _ in range(25):
            texts[i] = " ".join(words)
            i += 1
            words = list(words)
            for _ in range(random.randint(1, 4)):  # a chain of small edits
                words[random.randrange(len(words))] = random.choice(vocabulary)
    base = [random.choice(vocabulary) for _ in range(150)]
    for _ in range(120):
        words = list(base)
        for _ in range(random.randint(1, 8)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        texts[i] = " ".join(words)
        i += 1
    for _ in range(40):
        texts[i] = texts[random.randrange(i)]
        i += 1
    keys = list(range(1000, 1000 + len(texts)))
    random.shuffle(keys)
    return dict(zip(keys, texts.values()))


def test_families_of_copies(spark):
    texts = families(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rounds in (0, 3):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs, star_rounds=rounds).collect()}
        assert got == brute.components(texts)


def test_links_at_the_threshold(spark):
    # 9 common shingles of 12 are exactly 75 %
    words = [f"a{i}" for i in range(16)]  # 12 shingles
    exact, below = " ".join(words[:13]), " ".join(words[:12])  # 9 and 8 shingles, all common
    docs = spark.createDataFrame([(1, " ".join(words)), (2, exact)], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(spark, docs).collect()} == {1}
    docs = spark.createDataFrame([(1, " ".join(words)), (2, below)], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(spark, docs).collect()} == {1, 2}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 600).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)]))
    one = a[:1]
    starts = np.cumsum([0, len(a), len(b), len(one)])
    sketch = minhash.sketches(starts, np.concatenate([a, b, one]), 1024)
    assert (sketch != minhash.FULL).all()
    assert abs((sketch[0] == sketch[1]).mean() - 600 / 800) < 0.06
    alone = minhash.sketches(np.array([0, len(b)]), b, 1024)
    assert (alone[0] == sketch[1]).all()  # a sketch depends on its own set alone


def test_shingles_of_short_texts():
    starts, elements = minhash.shingle_sets(pa.array(["a b c", "A B  C", "a b", "", None, "a b c d e", "a b c d e f"]))
    assert np.diff(starts).tolist() == [1, 1, 1, 0, 0, 1, 2]
    assert elements[0] == elements[1] != elements[2]
