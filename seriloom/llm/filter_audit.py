"""Audit of filters that interact, by the Hart-Mas-Colell potential of the removal game.

The game. A coalition is a set of filters and its worth is the number of documents that at least one of its
filters fails. The five filters have 32 coalitions, and the worth of each is a sum over the 32 patterns of
failures, so every document is counted once, into (part, pattern), and all else follows from those counts.

The potential. P of the empty coalition is 0, and P(S) = (worth(S) + sum of P(S without i) for i in S) / |S|. A filter's
Shapley value is P(all) - P(all without it). The sum of what it removes over all 120 orders is 120 times that;
potentials are kept times 120, which makes them whole numbers (P is a sum of whole dividends, each over at most 5).

Steps. In an order, the filters up to a step are a coalition: what a step removes is the difference of the worths
after and before it, and what a filter alone fails is worth(all) - worth(all without it).

Copies. Filter E fails a document whose text a smaller doc_id has too. Rows are counted by (text digest, part,
pattern, labels) before the least doc_id of a text is looked up, so a text with a third of all rows is a handful of rows there.

Edge cases: a null text is empty; a null and an empty source are the part ''; repeated rows count each, and neither is a
copy of the other (no smaller doc_id); a null doc_id has no labels, is never a copy, and makes no other row one; of
several labels of a document, the larger counts; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
SYMBOLS = "[#$%&*|]"
WORD = "[^\\x20\\x09-\\x0D]+"
ORDERS = 120
ALL = 31
COPY = 16


def failures(text: Column) -> Column:
    """The pattern of filters A to D that a text fails, as bits 1, 2, 4 and 8."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    failed = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITAL_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, n, good, toxic): documents of each part by the filters that they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failures(text).alias("pattern"),
    )
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.filter("doc_id IS NOT NULL").join(marks.hint("merge"), "doc_id", "left").fillna(0, ["good", "toxic"])

    same = ["digest", "part", "pattern", "good", "toxic"]
    alike = marked.groupBy("doc_id", *same).agg(F.count("*").alias("times"))
    alike = alike.groupBy(*same).agg(F.sum("times").alias("n"), F.min("doc_id").alias("least"), F.min_by("times", "doc_id").alias("at_least"))
    least = alike.groupBy("digest").agg(F.min("least").alias("least_of_all"))
    first = F.when(F.col("least") == F.col("least_of_all"), F.col("at_least")).otherwise(F.lit(0))
    split = alike.join(least, "digest").withColumn("first", first)
    either = F.array(
        F.struct(F.col("pattern").alias("pattern"), F.col("first").alias("n")),
        F.struct((F.col("pattern") + COPY).alias("pattern"), (F.col("n") - F.col("first")).alias("n")),
    )
    named = split.select("part", "good", "toxic", F.explode(either).alias("x")).select("part", "good", "toxic", "x.*")
    nameless = rows.filter("doc_id IS NULL").select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "pattern", F.lit(1).cast("long").alias("n"))
    counted = named.unionByName(nameless).filter("n > 0").groupBy("part", "pattern")
    return counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def worths(counted: DataFrame) -> DataFrame:
    """(part, total, n, good, toxic): arrays with the worth of each of the 32 coalitions in documents, good ones and toxic ones."""

    def of(count: str, coalition: int) -> Column:
        return F.sum(F.when(F.col("pattern").bitwiseAND(coalition) != 0, F.col(count)).otherwise(0)).alias(f"{count}{coalition}")

    sums = counted.groupBy("part").agg(F.sum("n").alias("total"), *[of(c, s) for c in ("n", "good", "toxic") for s in range(ALL + 1)])
    return sums.select("part", "total", *[F.array(*[f"{c}{s}" for s in range(ALL + 1)]).alias(c) for c in ("n", "good", "toxic")])


def with_shapley(games: DataFrame) -> DataFrame:
    """``games`` with the array ``shapley``: each filter's Shapley value times the number of orders."""
    bits = [1 << i for i in range(len(FILTERS))]
    found = games.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, len(bits) + 1):
        level = {}
        for members in combinations(bits, size):
            whole = sum(members)
            below = " + ".join(f"p{whole - i}" for i in members)
            level[f"p{whole}"] = F.expr(f"({ORDERS} * n[{whole}] + {below}) div {size}")
        found = found.withColumns(level)
    values = F.array(*[F.col(f"p{ALL}") - F.col(f"p{ALL - i}") for i in bits])
    return found.select(*games.columns, values.alias("shapley"))


def steps(games: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(FILTERS[k] for k in order), step, i, before, before | 1 << i))
            before |= 1 << i
    names = ("filter_order", "step", "filter", "before", "after")
    spelt = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row)]) for row in rows])
    each = games.select("*", F.explode(spelt).alias("s")).select(*games.columns, "s.*")

    def gain(count: str) -> Column:
        return F.expr(f"{count}[after] - {count}[before]")

    return each.select(
        "part",
        "filter_order",
        "step",
        F.expr("total - n[after]").alias("kept"),
        gain("n").alias("removed"),
        F.expr("n[shiftleft(1, filter)] - (n[after] - n[before])").alias("redundant"),
        F.expr(f"n[{ALL}] - n[{ALL} - shiftleft(1, filter)]").alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        F.expr("shapley[filter]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every step of every order of the five filters does, by part of ``docs(doc_id, source, text)`` and ``labels(doc_id, quality, toxic)``."""
    return steps(with_shapley(worths(patterns(docs, labels))))


def sql() -> str:
    """The rows of ``audit``, by applying every order step by step, as DuckDB SQL."""
    removed_before = " + ".join(f"CASE WHEN step > {k} THEN {1 << 0} << (ascii(filter_order[{k}]) - 65) ELSE 0 END" for k in range(1, 5))
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITAL_PERCENT} * length(text))::INT
    + 8 * regexp_matches(text, '{SYMBOLS}')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM docs LEFT JOIN marks USING (doc_id)
), counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), places AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own FROM orders, range(1, 6) r(step)
), spelt AS (SELECT *, {removed_before} AS earlier FROM places
), done AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted, spelt GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM done
"""
