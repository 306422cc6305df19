"""Reading and guarding the surveillance feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriloom.functions import fixed_values as fv
from seriloom.functions.cells import count_where, to_day, to_number


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _header(spark: SparkSession, path: str) -> list[str]:
    # the reader only samples the head of the data here; no rows reach the driver
    return spark.read.option("header", True).option("comment", "#").csv(path).columns


def missing_columns(columns: list[str], required: list[str] | None = None) -> list[str]:
    """Names that must be there but are not."""
    return sorted(set(required or fv.FEED_COLUMNS) - set(columns))


def read_feed(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Feed CSV with every column as text; '#' lines are comments; missing columns are an error."""
    columns = _header(spark, path)
    absent = missing_columns(columns, required)
    if absent:
        raise ValueError(f"feed lacks the columns {absent}")
    return (
        spark.read.schema(_text_schema(columns))
        .option("header", True)
        .option("comment", "#")
        .csv(path)
    )


def split_malformed(
    spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of a feed. A record is bad when it has more cells than the header.

    The reader cuts records, so a quoted cell may hold line breaks; it is given one column, and every record with other than
    one cell comes back whole as a corrupt one. Short records are kept and padded with NULL, which is what a lenient CSV reader
    does, so cells are counted outside quotes, and the good ones are parsed. Pass ``columns`` for files without a header line.
    Whole files are read by one task each; ``multiline=False`` splits them where no cell holds a line break.
    """
    head = columns is None
    columns = columns or _header(spark, path)
    raw = (
        spark.read.schema("only string, record string")
        .options(header=head, comment="#", multiLine=multiline, columnNameOfCorruptRecord="record", enforceSchema=True)
        .csv(path)
    )
    records = raw.select(F.coalesce("record", "only").alias("value"))
    bare = F.regexp_replace("value", r'"[^"]*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    too_long = F.coalesce(cells > len(columns), F.lit(False))
    options = {"multiLine": str(multiline).lower()}
    parsed = F.from_csv("value", _text_schema(columns).simpleString()[7:-1].replace(":", " "), options)
    good = records.filter(~too_long).select(parsed.alias("r")).select("r.*")
    return good, records.filter(too_long).select(F.col("value").alias("line"))


def malformed_report(good: DataFrame, bad: DataFrame, limit: float = fv.MAX_MALFORMED_SHARE) -> DataFrame:
    """One row: totals, share of broken lines, and whether the feed is still acceptable."""
    flags = good.select(F.lit(0).alias("bad")).unionAll(bad.select(F.lit(1).alias("bad")))
    return flags.agg(
        F.count("*").alias("n_lines"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")
    ).select(
        "n_lines",
        "n_bad",
        F.when(F.col("n_lines") > 0, F.col("n_bad") / F.col("n_lines")).alias("bad_share"),
        F.coalesce(F.col("n_bad") / F.nullif("n_lines", F.lit(0)) <= limit, F.lit(True)).alias("accepted"),
    )


def feed_profile(
    feed: DataFrame, min_rows: int = fv.MIN_FEED_ROWS, required: list[str] | None = None
) -> DataFrame:
    """One row: rows, distinct entities, latest parsable week, verdict of the floor checks."""
    absent = missing_columns(feed.columns, required)
    # a lone distinct count is planned as a map-side deduplication, then a count
    return feed.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("COUNTRY_AREA_TERRITORY").alias("n_entities"),
        F.max(to_day("ISO_WEEKSTARTDATE")).alias("latest_week"),
    ).select(
        "n_rows",
        "n_entities",
        "latest_week",
        F.lit(len(absent)).cast("bigint").alias("n_missing_columns"),
        ((F.col("n_rows") >= min_rows) & F.lit(not absent)).alias("accepted"),
    )


def _digests(feed: DataFrame, columns: list[str], side: str) -> DataFrame:
    h = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\u0000")) for c in columns])
    return feed.select(
        F.lit(side).alias("side"),
        to_day("ISO_WEEKSTARTDATE").alias("day"),
        h.alias("h"),
    )


def refresh_guard(
    new: DataFrame,
    previous: DataFrame | None,
    columns: list[str] | None = None,
    kept_share: float = fv.MIN_KEPT_ROWS_SHARE,
) -> DataFrame:
    """One row with a verdict: unchanged, no_dates, older, shrunk, first_pull or ok.

    Both pulls go through a single aggregate with order-free content digests; nothing is joined.
    """
    cols = columns or fv.FEED_COLUMNS
    rows = _digests(new, cols, "new")
    if previous is not None:
        rows = rows.unionAll(_digests(previous, cols, "old"))

    def on(side: str, c):
        return F.when(F.col("side") == side, c)

    facts = []
    for side in ("new", "old"):
        facts += [
            F.count(on(side, F.lit(1))).alias(f"{side}_rows"),
            F.max(on(side, F.col("day"))).alias(f"{side}_day"),
            F.bit_xor(on(side, F.col("h"))).alias(f"{side}_xor"),
            F.sum(on(side, F.col("h") % 1_000_003)).alias(f"{side}_sum"),
        ]
    same = (
        (F.col("new_rows") == F.col("old_rows"))
        & F.col("new_xor").eqNullSafe(F.col("old_xor"))
        & F.col("new_sum").eqNullSafe(F.col("old_sum"))
    )
    has_old = F.lit(previous is not None)
    verdict = (
        F.when(has_old & same, "unchanged")
        .when(F.col("new_day").isNull(), "no_dates")
        .when(~has_old, "first_pull")
        .when(F.col("new_day") < F.col("old_day"), "older")
        .when(F.col("new_rows") < kept_share * F.col("old_rows"), "shrunk")
        .otherwise("ok")
    )
    return rows.agg(*facts).select(
        F.col("new_rows").alias("n_rows_new"),
        F.when(has_old, F.col("old_rows")).alias("n_rows_previous"),
        F.col("new_day").alias("latest_new"),
        F.col("old_day").alias("latest_previous"),
        verdict.alias("verdict"),
    )


def all_ages(feed: DataFrame, column: str = "AGEGROUP_CODE") -> DataFrame:
    """Rows of the ALL age group, whatever the case."""
    return feed.filter(F.upper(F.col(column)) == "ALL")


def to_observations(feed: DataFrame) -> DataFrame:
    """All-ages feed rows as obs(series_id, code, obs_date, ili, ari); undated rows are left out."""
    return (
        all_ages(feed)
        .select(
            F.col("COUNTRY_AREA_TERRITORY").alias("series_id"),
            F.col("COUNTRY_CODE").alias("code"),
            to_day("ISO_WEEKSTARTDATE").alias("obs_date"),
            to_number("ILI_CASE").alias("ili"),
            to_number("ARI_CASE").alias("ari"),
        )
        .filter(F.col("obs_date").isNotNull())
    )


def summary_by_entity(feed: DataFrame, only_all_ages: bool = False) -> DataFrame:
    """Totals of both indicators per entity with a label of what is reported.

    Every age group is summed, ALL included, as the published summary does; pass
    ``only_all_ages`` for the sum without double counting.
    """
    rows = all_ages(feed) if only_all_ages else feed
    label = F.concat_ws(
        ", ",
        F.when(F.col("total_ili_cases") > 0, F.lit("ILI")),
        F.when(F.col("total_ari_cases") > 0, F.lit("ARI")),
    )
    return (
        rows.groupBy(F.col("COUNTRY_AREA_TERRITORY").alias("country"))
        .agg(
            F.coalesce(F.sum(to_number("ILI_CASE")), F.lit(0.0)).alias("total_ili_cases"),
            F.coalesce(F.sum(to_number("ARI_CASE")), F.lit(0.0)).alias("total_ari_cases"),
        )
        .withColumn("data_types", F.when(label == "", F.lit("None")).otherwise(label))
    )


def numeric_quality(feed: DataFrame) -> DataFrame:
    """Per entity: how many cells are junk in each coerced column."""
    def junk(raw: str, parsed):
        return count_where(F.col(raw).isNotNull() & parsed.isNull())

    return feed.groupBy(F.col("COUNTRY_AREA_TERRITORY").alias("series_id")).agg(
        junk("ISO_WEEKSTARTDATE", to_day("ISO_WEEKSTARTDATE")).alias("junk_dates"),
        junk("ILI_CASE", to_number("ILI_CASE")).alias("junk_ili"),
        junk("ARI_CASE", to_number("ARI_CASE")).alias("junk_ari"),
        F.sum(to_number("ILI_CASE")).alias("sum_ili"),
        F.sum(to_number("ARI_CASE")).alias("sum_ari"),
        F.max(to_day("ISO_WEEKSTARTDATE")).alias("latest_week"),
    )
