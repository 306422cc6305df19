"""Quality rules: counts of words, symbols and repeats, and perplexity bands by language.

Modified Kneser-Ney letter models, one for each language and half of its documents, are counted over all documents, and a document's
perplexity per letter or space (case kept) by the model of the half it is not in is compared with a band. Bands are taken from
the data, by language and length class (powers of two words): the median log-perplexity of the documents that pass the base
rules, less ``width`` robust deviations of those below it, and plus as many of those above it (each at least ``least``);
median and deviations of a class are drawn to the language's by as much as ``PRIOR`` documents weigh. Unlike a fixed
share of documents, such a band rejects nothing from a clean corpus: only texts that are far from
their language's usual range, in either direction, go.

Edge cases: a null or empty text or one without words has zero counts and fails the base rule; a null
language is a language of its own; a language without a document that passes the base rules has no band
and rejects none by it; a document whose language has none in the other half gets a fixed perplexity; equal rows lie in the same half,
copies under other doc_ids in either, so a text that many documents repeat counts as usual; repeated rows and null doc_ids are kept. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage
from seriloom.llm import ngram_arrays
from seriloom.llm.batches import filled, hashes_of, mixed, owner_of, sums_between, words_of

REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WIDTH = 5.0
LEAST_HALF_BAND = 0.05
PRIOR = 30  # documents that a language's own spread weighs against a length class's
BINS = 200  # of a unit of log-perplexity
SYMBOLS = "[#*$%&|<>]"


def repeated_words(starts: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found twice or more in the text."""
    n = len(words)
    if n < size:
        return np.zeros(len(starts) - 1, np.int64)
    owner = owner_of(starts).astype(np.uint64)
    run = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[j : n - size + 1 + j]
    inside = owner[: n - size + 1] == owner[size - 1 :]
    place = np.flatnonzero(inside)
    key = mixed(mixed(run[place]) + owner[place])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place[twice], 1)
    np.add.at(edge, place[twice] + size, -1)
    return sums_between((np.cumsum(edge[:-1]) > 0).astype(np.int64), starts)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity), or in place of doc_id the other
    columns of ``docs`` in one struct ``row``, and text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    first = ["row", "text"] if whole else ["doc_id"]

    def measure(batch, events, logs):
        texts = filled(batch.column("text"))
        starts, codes, words = words_of(texts)
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        counts = [
            np.diff(starts),
            sums_between(chars[codes], starts),
            pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False),
            np.array([repeated_lines(t) for t in texts.to_pylist()], np.int64),
            repeated_words(starts, hashes_of(words)[codes], REPEAT_WINDOW),
        ]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in [*first, "lang"]], *[pa.array(c.astype(np.int64)) for c in counts], pa.array(-logs / np.maximum(events, 1))],
            [*first, "lang", *names, "log_perplexity"],
        )

    lang, doc_id = F.col("lang").cast("string"), F.col("doc_id").cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    carried = F.struct(*others).alias("row") if whole else doc_id.alias("doc_id")
    half = ngram_arrays.half_of(doc_id, F.col("text"))
    given = docs.select(carried, lang.alias("lang"), "text", F.coalesce(lang, F.lit("")).alias("model_lang"), half.alias("half"))
    head = f"row {given.schema['row'].dataType.simpleString()}, text string" if whole else "doc_id long"
    schema = f"{head}, lang string, " + ", ".join(f"{c} long" for c in names) + ", log_perplexity double"
    return ngram_arrays.scored(given, measure, schema)


def length_class(n_words: Column) -> Column:
    """Texts of 2**i to 2**(i + 1) - 1 words."""
    return F.floor(F.log2(F.greatest(n_words, F.lit(1)))).cast("int")


def bands(measured: DataFrame, width: float = WIDTH, least: float = LEAST_HALF_BAND) -> DataFrame:
    """(of, size, low, high): the band of log-perplexity of each language and length class. Values are first counted by language, class
    and bin, so a language with most of the documents is no hot key."""
    counts = measured.select(F.coalesce("lang", F.lit("")).alias("of"), length_class(F.col("n_words")).alias("size"), F.round(F.col("log_perplexity") * BINS).alias("bin"))
    counts = cut_lineage(counts.groupBy("of", "size", "bin").count())

    def median(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5), F.col("count")).alias(name), F.sum("count").alias(f"n_{name}"))

    def settled(rows: DataFrame, value: str, name: str) -> DataFrame:
        """Medians of the classes, drawn to the language's by as much as ``PRIOR`` documents weigh."""
        own, all_ = median(rows, ["of", "size"], value, "own"), median(rows, ["of"], value, "all")
        drawn = (F.col("own") * F.col("n_own") + PRIOR * F.col("all")) / (F.col("n_own") + PRIOR)
        return own.join(all_, "of").select("of", "size", drawn.alias(name))

    middle = settled(counts, "bin", "middle")
    far = counts.join(middle, ["of", "size"]).withColumn("above", F.col("bin") - F.col("middle"))
    up = settled(far.filter("above >= 0"), "above", "up")
    down = settled(far.filter("above <= 0").withColumn("below", -F.col("above")), "below", "down")

    def half(spread: str) -> Column:
        return F.greatest(F.lit(least), F.coalesce(spread, F.lit(0.0)) / BINS * 1.4826 * width)

    both = middle.join(up, ["of", "size"], "left").join(down, ["of", "size"], "left")
    centre = F.col("middle") / BINS
    return both.select("of", "size", (centre - half("down")).alias("low"), (centre + half("up")).alias("high"))


def verdicts(spark: SparkSession, docs: DataFrame, width: float, least: float, whole: bool) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    measured = cut_lineage(measures(docs, whole).withColumn("base_failed", failed))
    limits = cut_lineage(bands(measured.filter("NOT base_failed"), width, least))
    same = (F.coalesce("lang", F.lit("")) == F.col("of")) & (length_class(F.col("n_words")) == F.col("size"))
    joined = measured.join(limits, same, "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def judge(spark: SparkSession, docs: DataFrame, width: float = WIDTH, least: float = LEAST_HALF_BAND) -> DataFrame:
    """The measures of every row of ``docs(doc_id, lang, text)`` with base_failed and kept."""
    return verdicts(spark, docs, width, least, False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"
    )


def accepted(spark: SparkSession, docs: DataFrame, width: float = WIDTH, least: float = LEAST_HALF_BAND) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    kept = verdicts(spark, docs, width, least, True).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
