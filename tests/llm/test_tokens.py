"""Byte-level BPE and token counts against whole-text encoding."""

import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriloom.llm import bpe, catalog, token_counts
from tests.llm import brute
from tests.llm.conftest import SF

PATH = P.path("byte_bpe_50k.tiktoken")
ENCODER = brute.tokenizer()


def digests(docs, **options):
    return bpe.digests(bpe.encode(docs, PATH, P.PATTERN, **options), PATH).collect()


def test_query_equals_whole_text_encoding(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["op1_byte_bpe"](spark, SF).collect()}
    assert got == {i: brute.bpe_digest(ENCODER, t) for i, t in documents.items()}


@pytest.mark.parametrize("block_bytes", [1, 1000, 8 << 20])
def test_odd_rows_keep_their_places(odd, odd_rows, block_bytes):
    stored = odd.coalesce(1).cache()
    got = sorted(map(repr, ((r.doc_id, *r[1:]) for r in digests(stored, block_bytes=block_bytes))))
    assert got == sorted(repr((i, *brute.bpe_digest(ENCODER, t))) for i, t, *_ in odd_rows)


def test_empty_table(none):
    assert digests(none) == []


def test_units_never_cut_a_match():
    random.seed(1)
    letters = "ab1!'s \n\t\r\x85\xa0 \x1c\x1f　é "
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    starts, units = bpe.units_of(pa.array(texts))
    units = units.to_pylist()
    for i, text in enumerate(texts):
        own = units[starts[i] : starts[i + 1]]
        assert "".join(own) == text
        assert [x for u in own for x in ENCODER.encode_ordinary(u)] == ENCODER.encode_ordinary(text)


def test_decode_joins_the_token_bytes(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, decoded_ string")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: ENCODER.decode_bytes([1, 2, 3]), 2: b"", 3: b""}
    unknown = spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(unknown, PATH).collect()


def plain_counts(text, sections, rule):
    """Character by character: each token's characters, then the rule."""
    counts, n, outside = [0.0] * len(sections), 0, 0.0
    raw, at = text.encode(), 0
    for i in ENCODER.encode_ordinary(text):
        size = len(ENCODER.decode_single_token_bytes(i))
        start = len(raw[: at + 1].decode("utf-8", "ignore")) if (raw[at] & 0xC0) != 0x80 and raw[at] < 0x80 else None
        first = sum((b & 0xC0) != 0x80 for b in raw[: at + 1]) - 1
        last = sum((b & 0xC0) != 0x80 for b in raw[: at + size]) - 1
        assert start is None or start - 1 == first
        at += size
        n += 1
        chars = range(first, last + 1)
        owners = [next((k for k, (a, b) in enumerate(sections) if a <= c < b), None) for c in chars]
        if rule in ("start", "end"):
            own = owners[0 if rule == "start" else -1]
            if own is None:
                outside += 1
            else:
                counts[own] += 1
        elif rule == "share":
            for own in owners:
                if own is None:
                    outside += 1 / len(owners)
                else:
                    counts[own] += 1 / len(owners)
        else:
            found = [o for o in owners if o is not None]
            if found:
                counts[max(sorted(set(found)), key=found.count)] += 1
            else:
                outside += 1
    return n, outside, counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules_against_characters(spark, rule):
    text = "Hello wörld, 你好 🙂🙂 again and again\n\nnew   lines here"
    sections = [(0, 3), (3, 3), (3, 9), (11, 16), (16, 40), (41, len(text))]
    rows = spark.createDataFrame([(1, text, [(a, b) for a, b in sections]), (2, text, None), (3, None, [(0, 0)])], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    got = {r.doc_id: r for r in token_counts.count_tokens(rows, PATH, P.PATTERN, rule).collect()}
    n, outside, counts = plain_counts(text, sections, rule)
    assert got[1].n_tokens == n and np.isclose(got[1].outside, outside) and np.allclose(got[1].section_tokens, counts)
    assert got[2].section_tokens == [] and got[2].outside == n
    assert got[3].n_tokens == 0 and got[3].section_tokens == [0.0]


def test_sections_must_be_disjoint():
    with pytest.raises(ValueError, match="disjoint"):
        token_counts.allocate(np.array([0]), np.array([1]), np.array([0, 1]), np.array([2, 3]), "start")


def test_lines_add_up(spark, odd, none):
    for docs in (odd, none):
        cut = docs.withColumn("sections", token_counts.line_sections(docs["text"]))
        rows = token_counts.count_tokens(cut, PATH, P.PATTERN).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert sum(r.section_tokens) + r.outside == r.n_tokens and r.outside == 0


def test_count_query(spark, documents):
    got = {r.doc_id: r for r in catalog.QUERIES["op2_token_counts"](spark, SF).collect()}
    assert set(got) == set(documents)
    for i, text in list(documents.items())[:25]:
        lines, at = [], 0
        for line in (text or "").split("\n"):
            lines.append((at, min(at + len(line) + 1, len(text or ""))))
            at += len(line) + 1
        if len(text or "") < 4000:
            n, _, counts = plain_counts(text or "", lines, "start")
            assert got[i].n_tokens == n and got[i].section_tokens == ",".join(str(int(x)) for x in counts)
            assert got[i].n_sections == len(lines) and got[i].largest_section == max(counts)


def test_a_million_lines_in_seconds(spark):
    text = "ab\n" * 1_000_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "\n"), (4, "ü\n🙂 x")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, catalog.vocabulary(), catalog.pattern()).collect()}
    assert time.time() - began < 60
    assert len(rows[1].section_tokens) == 1_000_001 and sum(rows[1].section_tokens) == rows[1].n_tokens
    assert len(rows[2].section_tokens) == 1 and len(rows[3].section_tokens) == 2
    given = docs.filter("doc_id > 1").withColumn("sections", token_counts.line_sections(F.col("text")))
    same = {r.doc_id: r for r in token_counts.count_tokens(given, catalog.vocabulary(), catalog.pattern()).collect()}
    assert all(same[i] == rows[i] for i in (2, 3, 4))
