"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded whole, once, since a token may reach over a section's edge. Every token gets
the character span that its bytes cover (a token that holds a part of a character covers that
character), the spans are interval-joined to the sections' spans, and tokens are allocated by one
of these rules:

* ``start``: to the section with the token's first character;
* ``end``: to the section with its last character;
* ``majority``: to the section with most of its characters, the earlier one in a tie;
* ``share``: to every section it reaches, by the fraction of its characters there.

Sections are disjoint and ascending; characters between them belong to none, and what a rule gives
to none is reported as ``outside``. So the sections' counts and ``outside`` always add up to
``n_tokens``. Both sides of the join are sorted and belong to one document, so the join is a
merge inside the row and nothing is shuffled.

Edge cases: a null text is an empty text with zero tokens; null or empty sections give an empty
list of counts; an empty section counts zero; rows are independent, so repeated rows and null
doc_ids are kept; sections that overlap or run backwards are an error. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriloom.llm.batches import filled, slices
from seriloom.llm.bpe import _encoder

RULES = ("start", "end", "majority", "share")


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Half-open character spans of the lines of a text, each with the line end that closes it; linear in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    return starts, np.append(starts[1:], len(points))


def line_sections(text: Column) -> Column:
    """``line_spans`` as a column of sections for ``count_tokens``."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(a), "end": int(z)} for a, z in zip(*line_spans(t or ""))] for t in texts], dtype=object)

    return spans(F.coalesce(text, F.lit("")))


def char_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of tokens of ``sizes`` bytes each."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char_of_byte[ends - sizes], char_of_byte[ends - 1] + 1


def allocate(
    first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, float, int]:
    """(tokens of each section, tokens outside, tokens that reach into more than one section)."""
    n = len(starts)
    if n and ((ends < starts).any() or (starts[1:] < ends[:-1]).any()):
        raise ValueError("sections must be disjoint and ascending")
    some = np.flatnonzero(ends > starts)  # empty sections hold no character
    starts, ends = starts[some], ends[some]
    counts = np.zeros(n)
    if not len(some) or not len(first):
        return counts, float(len(first)), 0
    # sections low..high - 1 overlap the token
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(starts, end, "left")
    reach = np.maximum(high - low, 0)
    given = np.zeros(len(some))
    if rule in ("start", "end"):
        char = first if rule == "start" else end - 1
        at = np.searchsorted(ends, char, "right")
        hit = (at < len(some)) & (starts[np.minimum(at, len(some) - 1)] <= char)
        given = np.bincount(at[hit], minlength=len(some)).astype(float)
    else:
        token = np.repeat(np.arange(len(first)), reach)
        at = np.arange(len(token)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(low, reach)
        chars = np.minimum(end[token], ends[at]) - np.maximum(first[token], starts[at])
        if rule == "share":
            given = np.bincount(at, chars / (end - first)[token], minlength=len(some))
        else:
            order = np.lexsort((at, -chars, token))
            _, best = np.unique(token[order], return_index=True)
            given = np.bincount(at[order][best], minlength=len(some)).astype(float)
    counts[some] = given
    return counts, float(len(first) - given.sum()), int((reach > 1).sum())


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, rule: str = "start") -> DataFrame:
    """(doc_id, n_tokens, n_crossing, outside, section_tokens) of ``docs(doc_id, text, sections)``.

    ``sections`` is an array of structs whose fields ``start`` and ``end`` are character positions; without that column, the
    sections are the lines of the text, found in the task that counts.
    ``section_tokens`` is an array of doubles; under all rules but ``share`` they are whole numbers.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()

    def count(batches):
        encoder, sizes = None, None
        for batch in slices(batches, "text"):
            if encoder is None:
                encoder = _encoder(vocabulary, pattern)
                sizes = np.array([len(encoder.decode_single_token_bytes(i)) for i in range(encoder.n_vocab)])
            n_tokens, crossing, outside, counts = [], [], [], []
            spans = batch.column("sections") if "sections" in batch.schema.names else None
            if spans is not None:
                bounds = spans.flatten()
                edges = [
                    bounds.field(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for name in ("start", "end")
                ]
                at = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            for i, text in enumerate(filled(batch.column("text")).to_pylist()):
                ids = np.array(encoder.encode_ordinary(text), np.int64)
                first, end = char_spans(text, sizes[ids]) if len(ids) else (ids, ids)
                sections = line_spans(text) if spans is None else [e[at[i] : at[i + 1]] for e in edges]
                own, rest, over = allocate(first, end, *sections, rule)
                n_tokens.append(len(ids))
                crossing.append(over)
                outside.append(rest)
                counts.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(crossing, pa.int64()),
                    pa.array(outside, pa.float64()),
                    pa.array(counts, pa.list_(pa.float64())),
                ],
                ["doc_id", "n_tokens", "n_crossing", "outside", "section_tokens"],
            )

    given = docs.select(F.col("doc_id").cast("long"), "text")
    if "sections" in docs.columns:
        spans = F.transform(
            F.coalesce("sections", F.array().cast("array<struct<start:int,end:int>>")),
            lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")),
        )
        given = docs.select(F.col("doc_id").cast("long"), "text", spans.alias("sections"))
    schema = "doc_id long, n_tokens long, n_crossing long, outside double, section_tokens array<double>"
    return given.mapInArrow(count, schema)
