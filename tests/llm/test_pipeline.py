"""The pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline
from seriloom.functions.storage import cut_lineage
from seriloom.llm import catalog, secrets
from tests.llm import brute
from tests.llm.conftest import SF


def staged(spark, docs, sf_dir=SF):
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut_lineage(stage(spark, frames[-1], sf_dir)))
    return frames


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, kept, alone, clean, mixed, encoded = staged(spark, docs)
    assert all(x.columns == docs.columns for x in (kept, alone, clean, mixed))

    wanted = {r.doc_id for r in catalog.QUERIES["op5_quality"](spark, SF).collect() if r.kept}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == wanted and kept.count() == len(wanted)

    groups = brute.components(texts)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i in texts if groups[i] == i)

    for r in clean.collect():
        spans = [*secrets.base_spans(texts[r.doc_id]), *secrets.confirmed_spans(texts[r.doc_id])]
        assert r.text == secrets.cover(texts[r.doc_id], spans, "[secret]") and r.n_chars == len(r.text)
        assert not brute.base_secrets(r.text)

    before, after = Counter(clean.collect()), Counter(mixed.collect())
    assert set(before) == set(after) and all(before[x] <= after[x] <= 2 * before[x] for x in before)
    by_source = Counter()
    for r, n in after.items():
        by_source[r.source] += (n - before[r]) * len(brute.WORD.findall(r.text))
    totals = Counter()
    for r in before:
        totals[r.source] += len(brute.WORD.findall(r.text))
    assert all(by_source[s] <= (corpus_pipeline.REPETITION - 1) * totals[s] + max(len(brute.WORD.findall(r.text)) for r in before) for s in totals)

    encoder = brute.tokenizer()
    expected = Counter((r.doc_id, *brute.bpe_digest(encoder, r.text)) for r in mixed.collect())
    assert Counter(tuple(r) for r in encoded.collect()) == expected
    assert corpus_pipeline.run(spark, SF).count() == encoded.count()


def test_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        frames = staged(spark, cut_lineage(docs))
        assert all(f.columns == docs.columns for f in frames[:-1])
    assert frames[-1].collect() == []
