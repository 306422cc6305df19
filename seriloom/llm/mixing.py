"""Mixing sources to target weights by temperature, with DataFrame operations only.

Weights. With p the sources' token shares, weights are p^a, normalised. The entropy of the
weights falls as a rises, and so does the greatest number of times that any source is repeated. ``exponent`` bisects a:
the largest a whose entropy is at least ``entropy`` times the greatest possible one, but no smaller than the
least a that keeps repetition within ``repetition``. One pass over the sources evaluates the ends
of five bisection steps at once, so 30 steps take six passes; only sums come to the driver.

Budget. ``budget`` tokens are dealt out by weight; "cover" is the smallest budget that serves every
document at least once. A source repeats when its part is larger than what it has.

Block permutations. For each epoch a source's documents are dealt by a hash into blocks of about ``block_tokens`` tokens
and lie in hash order inside their block, so each epoch is another permutation. Running sums
over block totals, and over the documents of one block, give each document its place, without a
window over a whole source. Documents that begin before their source's part ends are served; and the
place, as a fraction of the part, says which block of the mixed stream they go to, so every block of the
stream has the target weights.

Edge cases: a null source and an empty one are the same source; a null or empty text has no tokens; a source without tokens has
weight 0 and is served once; a null doc_id takes part like any other; repeated rows are served each (which of equal rows comes
first is open, and makes no difference); an empty table gives an empty schedule. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage

ENTROPY = 0.95
REPETITION = 4.0
BLOCK_TOKENS = 1 << 18
SEED = "mix"
GREATEST = 4.0
WAYS, PASSES = 32, 6
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_tokens(counted: DataFrame) -> DataFrame:
    return counted.groupBy("source").agg(F.sum("tokens").alias("total"))


def exponent(sources: DataFrame, entropy: float | None, repetition: float, budget: str) -> float:
    """The exponent for ``sources(source, total)``; 1.0 if fewer than two sources have tokens."""
    used = sources.filter("total > 0")
    n, whole, least, most = used.agg(F.count("*"), F.sum("total"), F.min("total"), F.max("total")).first()
    if n < 2:
        return 1.0
    share = F.col("total") / F.lit(float(whole))
    p_least, p_most = least / whole, most / whole

    def sums(points: list[float]) -> list[tuple[float, float]]:
        parts = []
        for a in points:
            parts += [F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))]
        row = used.agg(*[x.alias(f"x{i}") for i, x in enumerate(parts)]).first()
        return list(zip(row[::2], row[1::2]))

    def flat(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= entropy * math.log(n)

    def modest(a: float, z: float, s: float) -> bool:
        if budget == "cover":
            return p_least ** (a - 1) / min(p_least ** (a - 1), p_most ** (a - 1)) <= repetition
        return p_least ** (a - 1) / z <= repetition

    def section(holds, rising: bool) -> float:
        """The point where ``holds`` begins (rising) or ends to be true."""
        low, high = 0.0, GREATEST
        for _ in range(PASSES):
            points = [low + (high - low) * i / WAYS for i in range(1, WAYS)]
            true = [holds(a, *x) for a, x in zip(points, sums(points))]
            edges = [low, *points, high]
            k = true.index(True) if rising and True in true else true.index(False) if not rising and False in true else WAYS - 1
            low, high = edges[k], edges[k + 1]
        return high if rising else low

    modest_from = section(modest, True)
    return modest_from if entropy is None else max(section(flat, False), modest_from)


def parts_of(sources: DataFrame, a: float, budget: str) -> DataFrame:
    """(source, total, part): the tokens to serve of each source."""
    whole = sources.agg(F.sum("total")).first()[0] or 0
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(float(max(whole, 1))), F.lit(a))).otherwise(F.lit(0.0))
    weighed = sources.withColumn("w", weight)
    sums = weighed.agg(F.sum("w"), F.min(F.when(F.col("total") > 0, F.col("w") / F.col("total")))).first()
    if budget == "cover":
        # the source with the least weight for each of its tokens is served once
        factor = 1.0 / sums[1] if sums[1] else 0.0
        part = F.greatest(F.floor(F.col("w") * F.lit(factor)), F.col("total"))
    else:
        part = F.floor(F.lit(float(whole)) * F.col("w") / F.lit(sums[0] or 1.0))
    return weighed.select("source", "total", part.cast("long").alias("part"))


def draw(*keys) -> Column:
    """The first eight hex digits of a digest, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long")


def schedule(
    docs: DataFrame,
    key: str = "doc_id",
    entropy: float | None = ENTROPY,
    repetition: float = REPETITION,
    budget: str = "whole",
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> DataFrame:
    """(key, source, epoch, tokens, start, stream_block) of each serving of ``docs(key, source, text)``.

    ``start`` counts the source's tokens before this serving. ``budget`` is "whole" (as many tokens as there are) or "cover".
    """
    if budget not in ("whole", "cover"):
        raise ValueError("budget must be 'whole' or 'cover'")
    counted = docs.select(key, F.coalesce("source", F.lit("")).alias("source"), tokens_of(F.col("text")).alias("tokens"))
    counted = cut_lineage(counted)
    sources = cut_lineage(source_tokens(counted))
    a = exponent(sources, entropy, repetition, budget)
    parts = cut_lineage(parts_of(sources, a, budget))
    streams = parts.agg(F.greatest(F.ceil(F.sum("part") / block_tokens), F.lit(1)).cast("long")).first()[0] or 1

    epochs = F.greatest(F.expr("(part + total - 1) div greatest(total, 1)"), F.when(F.col("total") == 0, 1).otherwise(0))
    parts = parts.withColumn("epochs", epochs).filter("epochs > 0")
    parts = parts.withColumn("blocks", F.greatest(F.ceil(F.col("total") / block_tokens), F.lit(1)).cast("long"))
    served = counted.join(parts, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    served = served.withColumn("block", F.pmod(draw(F.lit(seed), F.col("epoch").cast("string"), name), F.col("blocks")))

    blocks = served.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("block_total"))
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "epoch", "block", F.coalesce(F.sum("block_total").over(before), F.lit(0)).alias("base"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("epoch").cast("string"), name))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(order, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = served.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.join(blocks, ["source", "epoch", "block"])
    placed = placed.withColumn("start", F.col("epoch") * F.col("total") + F.col("base") + F.col("inner"))
    due = (F.col("start") < F.col("part")) | (F.col("total") == 0)
    if budget == "cover":
        due = due | (F.col("epoch") == 0)
    block = F.expr(f"least((cast(start as decimal(20,0)) * {streams}) div greatest(part, 1), {streams - 1})")
    return placed.filter(due).select(key, "source", "epoch", "tokens", "start", block.cast("long").alias("stream_block"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``schedule`` serves it; all columns stay as they are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), "source", "text")
    times = schedule(rows, "key", **options).groupBy("key").agg(F.count("*").alias("times"))
    once = rows.select("row", "key").dropDuplicates(["key"]).join(times, "key")
    return once.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def sql(entropy: float = ENTROPY, repetition: float = REPETITION, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> str:
    """The rows of ``schedule`` with a whole budget, as DuckDB SQL."""
    text = f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents
), sources AS (SELECT source, sum(tokens)::BIGINT AS total FROM counted GROUP BY source
), used AS (
  SELECT total / (sum(total) OVER ())::DOUBLE AS p, count(*) OVER () AS n, min(total) OVER () / (sum(total) OVER ())::DOUBLE AS p0
  FROM sources WHERE total > 0
), points AS (SELECT unnest(range(1, {WAYS})) AS i
), f0 AS (SELECT 0.0::DOUBLE AS low, {GREATEST}::DOUBLE AS high), r0 AS (SELECT 0.0::DOUBLE AS low, {GREATEST}::DOUBLE AS high)"""
    for i in range(PASSES):
        for name, test, pick in (
            ("f", f"ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) >= {entropy} * ln(max(n))", "min(CASE WHEN NOT ok THEN i END)"),
            ("r", f"pow(max(p0), a - 1) / sum(pow(p, a)) <= {repetition}", "min(CASE WHEN ok THEN i END)"),
        ):
            text += f""", {name}t{i} AS (
  SELECT i, {test} AS ok FROM (SELECT i, low + (high - low) * i / {WAYS} AS a FROM {name}{i}, points), used GROUP BY i, a
), {name}{i + 1} AS (
  SELECT low + (high - low) * (k - 1) / {WAYS} AS low, CASE WHEN k = {WAYS} THEN high ELSE low + (high - low) * k / {WAYS} END AS high
  FROM {name}{i}, (SELECT coalesce({pick}, {WAYS}) AS k FROM {name}t{i})
)"""
    return (
        text
        + f""", expo AS (
  SELECT CASE WHEN (SELECT count(*) FROM used) < 2 THEN 1.0 ELSE greatest(f.low, r.high) END AS a FROM f{PASSES} f, r{PASSES} r
), weighed AS (
  SELECT source, total, CASE WHEN total > 0 THEN pow(total / (sum(total) OVER ())::DOUBLE, a) ELSE 0.0 END AS w, sum(total) OVER () AS whole FROM sources, expo
), parts AS (
  SELECT source, total, floor(whole::DOUBLE * w / (sum(w) OVER ()))::BIGINT AS part FROM weighed
), planned AS (
  SELECT *, greatest((part + total - 1) // greatest(total, 1), CASE WHEN total = 0 THEN 1 ELSE 0 END) AS epochs,
    greatest(ceil(total / {block_tokens}), 1)::BIGINT AS blocks, greatest(ceil(sum(part) OVER () / {block_tokens}), 1)::HUGEINT AS streams FROM parts
), served AS (
  SELECT doc_id, tokens, p.*, unnest(range(0, epochs::BIGINT)) AS epoch FROM counted JOIN planned p USING (source) WHERE epochs > 0
), dealt AS (
  SELECT *, ('0x' || substr(md5('{seed}|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % blocks AS block,
    md5('{seed}|order|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM served
), bases AS (
  SELECT source, epoch, block, coalesce(sum(x) OVER (PARTITION BY source, epoch ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT source, epoch, block, sum(tokens) AS x FROM dealt GROUP BY ALL)
), placed AS (
  SELECT d.*, (d.epoch * total + base
    + coalesce(sum(tokens) OVER (PARTITION BY source, epoch, block ORDER BY place, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM dealt d JOIN bases USING (source, epoch, block)
)
SELECT doc_id, source, epoch, tokens, start, least(start::HUGEINT * streams // greatest(part, 1), streams - 1)::BIGINT AS stream_block
FROM placed WHERE start < part OR total = 0
"""
    )
