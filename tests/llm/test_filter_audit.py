"""The filter audit against filters that are really applied, order by order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from seriloom.llm import filter_audit
from tests.llm import brute


def plain(rows, labels):
    """{(part, order, step): counts} of (doc_id, text, source) and {doc_id: (good, toxic)}."""
    fails = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = brute.WORD.findall(text)
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            own.add("C")
        if re.search("[#$%&*|]", text):
            own.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            own.add("E")
        fails.append(own)
    out, total = {}, Counter()
    parts = defaultdict(list)
    for k, (_, _, source) in enumerate(rows):
        parts[source or ""].append(k)
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = list(members)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                marks = [labels.get(rows[k][0], (0, 0)) for k in gone]
                failing = sum(f in fails[k] for k in members)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(fails[k] == {f} for k in members), sum(m[0] for m in marks), sum(m[1] for m in marks),
                ]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_every_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    marks = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in labels.collect()}
    got = found(filter_audit.audit(docs, labels))
    assert got == plain(rows, marks)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, None, 1), (5, 1, None), (None, 1, 1), (2, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    rows = [(i, t, s) for i, t, _, s in odd_rows]
    got = found(filter_audit.audit(odd, labels))
    assert got == plain(rows, {4: (1, 1), 5: (1, 0), 2: (0, 1)})
    assert filter_audit.audit(none, labels).collect() == []
    assert found(filter_audit.audit(odd, labels.filter("false"))) == plain(rows, {})


def test_copies_within_and_between_parts(spark):
    rows = [(9, "same", "a"), (2, "same", "b"), (2, "same", "b"), (None, "same", "b"), (5, "same", None), (7, "other", "a"), (7, "other", "a"), (8, None, "a"), (3, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    assert found(filter_audit.audit(docs, labels)) == plain(rows, {2: (1, 1)})


def test_values_add_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    games = filter_audit.with_shapley(filter_audit.worths(filter_audit.patterns(docs, labels)))
    for r in games.collect():
        assert sum(r.shapley) == 120 * r.n[31]
