"""Bottom-k fingerprints against whole shingle sets."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seriloom.llm import fingerprints
from tests.llm import brute


def shingle_set(text):
    words = brute.WORD.findall(text or "")
    if len(words) < 5:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def spelt(text, k):
    return "".join(sorted(hashlib.md5(s.encode()).hexdigest()[:15] for s in shingle_set(text))[:k])


def edits(rows):
    """{doc_id: (n_chars, edited, next text)} of (doc_id, text) with distinct ids."""
    ring = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(ring):
        text, after = text or "", ring[(i + 1) % len(ring)][1] or ""
        third = len(text) // 3
        out[doc_id] = len(text), text[: len(text) - third] + after[:third], after
    return out


def exact(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, found, k):
    expected = edits(rows)
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        n, edited, after = expected[r.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == spelt(text, k) and r.edited_fingerprint == spelt(edited, k)
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            small = max(len(shingle_set(text)), len(shingle_set(other))) < k
            assert abs(near - exact(text, other)) < (1e-9 if small else 2.5 / k**0.5)


@pytest.mark.parametrize("k", [128, 16])
def test_whole_sets(spark, documents, k):
    rows = [(i, t) for i, t in documents.items() if i % 3 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(rows, fingerprints.compare_with_edits(docs, k).collect(), k)


def test_odd_rows(spark, odd, odd_rows, none):
    found = fingerprints.compare_with_edits(odd).collect()
    assert len(found) == len(odd_rows)
    assert fingerprints.compare_with_edits(none).collect() == []
    texts = {i: t for i, t, *_ in odd_rows if i is not None}
    by_id = {r.doc_id: r for r in found}
    for i, t in texts.items():
        assert by_id[i].n_chars == len(t or "") and by_id[i].fingerprint == spelt(t, 128)
    assert len({(r.edited_sha256, r.near_next) for r in found if r.doc_id == 5}) == 1
    assert by_id[1].near_edited == 1.0 and by_id[1].fingerprint == ""
    # doc 1 comes before the null rows, the null rows before the highest id
    nulls = [r for r in found if r.doc_id is None]
    assert len(nulls) == 2 and {r.n_chars for r in nulls} == {0, len(odd_rows[6][1])}
    long = next(r for r in nulls if r.n_chars)
    text = odd_rows[6][1]
    assert long.edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 3] + "x").encode()).hexdigest()


def test_one_document_is_its_own_next(spark):
    rows = [(3, "one two three four five six seven eight")]
    r = fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert r.near_next == 1.0
    check(rows, [r], 128)


def test_ring_over_many_stretches(spark):
    ids = spark.range(0, 5000, 7).select((F.col("id") * 13 % 100003).alias("doc_id")).repartition(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = dict(fingerprints.next_of(ids).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((i * 13 % 100003 for i in range(0, 5000, 7)), reverse=True)
    assert got == dict(zip(order, [*order[1:], order[0]]))


def test_parts_merge_to_the_whole(spark):
    words = [f"w{i * i % 997}" for i in range(3000)]
    parts = [("a", " ".join(words[i : i + 204])) for i in range(0, 3000, 200)]  # four words over, so no shingle is lost
    parts += [("b", "few words"), ("b", None), ("c", ""), (None, "no key here")]
    rows = spark.createDataFrame(parts, "name string, text string").select("name", fingerprints.sketch(F.col("text"), 32).alias("fingerprint"))
    got = {r.name: r.fingerprint for r in fingerprints.merge_parts(rows, "name", k=32).collect()}
    whole = spark.createDataFrame([("a", " ".join(words)), ("b", "few words"), ("c", ""), (None, "no key here")], "name string, text string")
    want = {r.name: r.s for r in whole.select("name", fingerprints.sketch(F.col("text"), 32).alias("s")).collect()}
    assert got == want and len(got["a"]) == 32
    pair = spark.createDataFrame([(got["a"][:20], got["a"])], "a array<long>, b array<long>")
    assert pair.select(fingerprints.merged(F.col("a"), F.col("b"), 32)).first()[0] == got["a"]


def test_estimates(spark):
    a = " ".join(f"x{i}" for i in range(4004))  # 4,000 shingles, the first 3,000 also in b
    b = " ".join([*(f"x{i}" for i in range(3004)), *(f"y{i}" for i in range(6000))])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        *[fingerprints.sketch(F.col(c), 1024).alias(c) for c in "ab"]
    )
    d, near, held = row.select(
        fingerprints.distinct(F.col("a"), 1024), fingerprints.resemblance(F.col("a"), F.col("b"), 1024), fingerprints.containment(F.col("a"), F.col("b"), 1024)
    ).first()
    assert abs(d / 4000 - 1) < 0.15 and abs(near - 3000 / 10000) < 0.07 and abs(held - 0.75) < 0.15


def test_no_python_in_the_plan(spark, odd):
    plan = fingerprints.compare_with_edits(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
