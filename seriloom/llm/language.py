"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds
(multiplies) the letters' vectors, each permuted by its place (rolled by one step per place), and a
text's profile bundles (adds) the vectors of its n-grams. A language's prototype bundles the
profiles of its learning documents, each scaled to length one, so that long documents do not outweigh others. A
document gets the language whose prototype has the greatest cosine with its profile; ties go to the smaller name.

The profile of a text is linear in its n-gram counts, so each slice of documents draws the vector
of each of its distinct n-grams once. Partial prototypes of each task are added up by language:
a language with most of the documents is one row per task, and the result has one row per language.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learnt; documents with a null lang teach nothing; a null doc_id is not learnt from and its held_out
is null; repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.llm.batches import filled, mixed, slices
from seriloom.llm.toxicity import remainder

SIZE = 1024
GRAM = 3
UNKNOWN = "und"
SPACE = 32
SLICE = 2 << 20


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lower-case letters with one space before and after each run, has a letter) of texts."""
    joined = filled(texts).to_pylist()
    points = np.frombuffer("\n".join([*joined, ""]).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) + 1 for t in joined], np.int64)
    # one entry per code point in use: its letter, or a space
    used = np.flatnonzero(np.bincount(points, minlength=1))
    place = np.full(int(points.max(initial=0)) + 1, SPACE, np.int64)
    for p in used.tolist():
        c = chr(p)
        place[p] = ord(c.lower()[0]) if c.isalpha() else SPACE
    clean = place[points]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.ones(len(clean), bool)
    first[1:] = owner[1:] != owner[:-1]
    clean_has = np.bincount(owner, clean != SPACE, minlength=len(lengths)) > 0
    before = np.concatenate([[SPACE], clean[:-1]])
    kept = (clean != SPACE) | ((before != SPACE) & ~first)
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, kept, minlength=len(lengths)).astype(np.int64))])
    return starts, clean[kept], clean_has


def letter_vectors(letters: np.ndarray, size: int) -> np.ndarray:
    """A row of +1 and -1 for each letter, drawn from its code point."""
    words = np.arange(size // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = mixed(mixed(letters.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(0x9E3779B97F4A7C15) + words)
    ones = np.unpackbits(bits.view(np.uint8).reshape(len(letters), -1), axis=1)
    return (2 * ones[:, :size].astype(np.int8) - 1).astype(np.int8)


def profiles(texts: pa.Array, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(profile of each text as a row, has a letter)."""
    starts, letters, some = letters_of(texts)
    out = np.zeros((len(some), size), np.float32)
    # a space before the first run, so that a word's beginning is seen
    known, code = np.unique(np.concatenate([[SPACE], letters]), return_inverse=True)
    space, code = code[0], code[1:]
    vectors = letter_vectors(known, size)
    kinds = len(known)
    keys, owners = [], []
    for i in np.flatnonzero(some).tolist():
        own = np.concatenate([[space], code[starts[i] : starts[i + 1]]])
        if own[-1] != space:
            own = np.append(own, space)
        if len(own) >= gram:
            key = np.zeros(len(own) - gram + 1, np.int64)
            for j in range(gram):
                key = key * kinds + own[j : len(own) - gram + 1 + j]
            keys.append(key)
            owners.append(i)
    if not keys:
        return out, some
    grams, at = np.unique(np.concatenate(keys), return_inverse=True)
    bound = np.ones((len(grams), size), np.int8)
    rest = grams.copy()
    for j in range(gram):  # the last letter first
        bound *= np.roll(vectors, j, axis=1)[rest % kinds]
        rest //= kinds
    end = 0
    for i, key in zip(owners, keys):
        own, count = np.unique(at[end : end + len(key)], return_counts=True)
        end += len(key)
        out[i] = count.astype(np.float32) @ bound[own].astype(np.float32)
    return out, some


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def prototypes(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The bundled profile of each language of ``docs(text, lang)``; one vector for each language."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", SLICE):
            rows, some = profiles(batch.column("text"), size, gram)
            rows = unit(rows)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in {*langs[some].tolist()}:
                sums[lang] = sums.get(lang, 0) + rows[some & (langs == lang)].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([list(map(float, v)) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    parts = docs.select("text", "lang").mapInArrow(bundle, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round("x", 6)).alias("x"))
    whole = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v"))
    return {r.lang: np.array(r.v) for r in whole.collect()}


def identify(spark: SparkSession, docs: DataFrame, learnt: dict[str, np.ndarray], size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, lang_pred, score) of ``docs(doc_id, text)``; score is the cosine, at least 0."""
    names = sorted(learnt)
    table = unit(np.stack([learnt[n] for n in names])).astype(np.float32) if names else None
    sent = spark.sparkContext.broadcast((names, table))

    def tell(batches):
        names, table = sent.value
        for batch in slices(batches, "text", SLICE):
            found = [UNKNOWN] * batch.num_rows
            score = np.zeros(batch.num_rows)
            if names:
                rows, some = profiles(batch.column("text"), size, gram)
                near = unit(rows) @ table.T
                best = near.argmax(axis=1)
                found = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
                score = np.where(some, np.clip(near[np.arange(len(best)), best], 0.0, 1.0), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tell, "doc_id long, lang_pred string, score double")


def predict(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); documents with crc32(doc_id as text) mod 3 = 1 are held out."""
    fold = remainder(F.col("doc_id"), 3)
    learnt = prototypes(docs.filter((fold != 1) & F.col("lang").isNotNull()))
    told = identify(spark, docs, learnt)
    return told.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
