"""Names, codes, coordinates and the flags derived from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv

GRAM = 3


def known_entities(feed: DataFrame, order: str) -> DataFrame:
    """Distinct (code, name, first_seen); ``order`` is the column that gives the feed order."""
    return feed.groupBy(
        F.col("COUNTRY_CODE").alias("code"), F.col("COUNTRY_AREA_TERRITORY").alias("name")
    ).agg(F.min(order).alias("first_seen"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != ""))


def _grams(text: Column) -> Column:
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))


def _by_rarest(queries: DataFrame, tokens: Column, index: DataFrame) -> DataFrame:
    """Each query with the names that hold its rarest token. ``index`` is (key, code, name, first_seen).

    A token that no name holds ends the search of its query, and a frequent one is only looked up if the query has no rarer.
    """
    frequency = index.groupBy("key").agg(F.count("*").alias("names"))
    asked = queries.select("query", F.explode(tokens).alias("key"))
    known = asked.join(frequency, "key", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    rarest = known.groupBy("query").agg(F.min(F.struct("names", "key")).alias("r")).filter("r.names > 0")
    return rarest.select("query", F.col("r.key").alias("key")).join(index, "key")


def resolve_entity(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query, code, name, rule): exact code, exact name, whole words, then substring.

    All four rules are equi-joins. A whole-word hit holds all words of the query, and a substring hit all its runs of three
    characters, so candidates come from an inverted list of words and one of such runs, looked up by the token of the query that
    the fewest names hold; each candidate is then checked in full. A word that begins a hundred thousand names costs
    nothing unless it is all there is of a query. The best (rule, feed position) per query is a two-phase minimum, not a sort.
    """
    q = queries.select("query").distinct()
    ent = entities.select("code", "name", "first_seen")
    low_q, low_n = F.lower("query"), F.lower("name")

    by_code = q.join(ent, F.upper("query") == F.col("code")).withColumn("rule", F.lit(1))
    by_name = q.join(ent, low_q == low_n).withColumn("rule", F.lit(2))

    # quoting keeps the query literal; (?U) makes word boundaries and case folding Unicode-aware
    whole = F.concat(F.lit(r"(?iU)\b\Q"), F.replace("query", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    words = ent.withColumn("key", F.explode(_words(F.col("name"))))
    by_word = _by_rarest(q, _words(F.col("query")), words).filter(F.regexp_like("name", whole)).withColumn("rule", F.lit(3))
    grams = ent.withColumn("key", F.explode(_grams(F.col("name"))))
    long = q.filter(F.length("query") >= GRAM)
    by_part = _by_rarest(long, _grams(F.col("query")), grams).filter(F.contains(low_n, low_q)).withColumn("rule", F.lit(4))
    columns = ["query", "rule", "first_seen", "code", "name"]
    found = by_code.select(columns)
    for part in (by_name, by_word, by_part):
        found = found.unionByName(part.select(columns))
    best = found.groupBy("query").agg(
        F.min(F.struct("rule", "first_seen", "code", "name")).alias("m")
    )
    return q.join(best, "query", "left").select(
        "query", "m.code", "m.name", F.col("m.rule").alias("rule")
    )


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def code_lookup(
    names: DataFrame, mapping: DataFrame, overrides: dict[str, str] | None = None
) -> DataFrame:
    """(name, code) for folder-style names.

    Overrides beat the mapping table for the same key; the name is tried as it is, then with
    blanks for underscores; the two Congos follow their own rule; unknown names stay NULL.
    """
    fixed = _literal_map(fv.CODE_OVERRIDES if overrides is None else overrides)
    dim = mapping.groupBy(F.lower("name").alias("key")).agg(F.max("code").alias("hit"))
    low = F.lower("name")
    spaced = F.replace(low, F.lit("_"), F.lit(" "))
    congo = F.when(
        F.contains(low, F.lit("congo")),
        F.when(F.contains(low, F.lit("democratic")), "CD").otherwise("CG"),
    )
    tagged = names.withColumns({"_low": low, "_spaced": spaced})
    first = dim.select(F.col("key").alias("_low"), F.col("hit").alias("_a"))
    second = dim.select(F.col("key").alias("_spaced"), F.col("hit").alias("_b"))
    code = F.coalesce(
        F.try_element_at(fixed, F.col("_low")),
        F.col("_a"),
        F.try_element_at(fixed, F.col("_spaced")),
        F.col("_b"),
        congo,
    )
    return (
        tagged.join(first, "_low", "left").join(second, "_spaced", "left").select("name", code.alias("code"))
    )


def alias_map(names: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """Adds ``short_name``; names without an alias keep themselves.

    The alias table has a fixed handful of entries, so it is a literal map, not a join.
    """
    table = _literal_map(fv.SHORT_NAMES if short is None else short)
    return names.withColumn("short_name", F.coalesce(F.try_element_at(table, F.col("name")), F.col("name")))


def coordinates(
    names: DataFrame, boxes: DataFrame, capitals: DataFrame | None = None
) -> DataFrame:
    """(name, lat, lon): middle of the bounding box; capital coordinates win when given."""
    centre = boxes.select(
        F.col("name").alias("_key"),
        ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"),
    )
    out = names.withColumn("_key", F.lower("name")).join(centre, "_key", "left").drop("_key")
    if capitals is None:
        return out
    cap = capitals.select("name", F.col("lat").alias("_clat"), F.col("lon").alias("_clon"))
    return out.join(cap, "name", "left").select(
        "name", F.coalesce("_clat", "lat").alias("lat"), F.coalesce("_clon", "lon").alias("lon")
    )


def hemisphere(latitude: Column) -> Column:
    """+1 north of the tropics, -1 south of them, 0 between them or where unknown."""
    return (
        F.when(latitude > fv.TROPIC_LATITUDE, 1.0).when(latitude < -fv.TROPIC_LATITUDE, -1.0).otherwise(0.0)
    )


def neighbour_edges(spark: SparkSession) -> DataFrame:
    """The fixed neighbour graph as edges(src, dst, rank)."""
    graph = F.create_map(
        *chain.from_iterable(
            (F.lit(src), F.array(*[F.lit(d) for d in dst])) for src, dst in fv.NEIGHBOURS.items()
        )
    )
    return (
        spark.range(1)
        .select(F.explode(graph).alias("src", "list"))
        .select("src", F.posexplode("list").alias("pos", "dst"))
        .select("src", "dst", (F.col("pos") + 1).alias("rank"))
    )
