"""Series files, forecast files, hub rounds, truth vintages and JSON dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions.cells import to_day, to_number

BUCKETS = 64
ROUND_CELLS = ["luogo", "tipo_valore", "orizzonte", "target", "id_valore", "valore"]


def bucket_of(series_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(series_id), F.lit(buckets)).cast("int")


def read_series(spark: SparkSession, root: str, only: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """series(series_id, obs_date, cases, data_type) written by ``write_series`` as CSV.

    With ``only``, a table with a column series_id, just these series: the join is on the bucket too, so folders that hold
    none of them are pruned when the query runs. ``buckets`` must be the number that was written.
    """
    raw = (
        spark.read.option("header", True)
        .option("comment", "#")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .schema("Time string, Cases string, DataType string, series_id string, bucket int")
        .csv(root)
    )
    if only is not None:
        wanted = only.select("series_id").distinct().withColumn("bucket", bucket_of(F.col("series_id"), buckets))
        raw = raw.join(wanted, ["bucket", "series_id"], "left_semi")
    return raw.select(
        "series_id",
        to_day("Time").alias("obs_date"),
        to_number("Cases").alias("cases"),
        F.col("DataType").try_cast("int").alias("data_type"),
    )


def read_legacy_series(spark: SparkSession, root: str, indicator: str) -> DataFrame:
    """Single-indicator files (Time, <indicator>_Cases) in the shape of ``read_series``."""
    raw = (
        spark.read.option("header", True)
        .option("comment", "#")
        .schema(f"Time string, {indicator}_Cases string, series_id string")
        .csv(root)
    )
    return raw.select(
        "series_id",
        to_day("Time").alias("obs_date"),
        to_number(f"{indicator}_Cases").alias("cases"),
        F.lit(1 if indicator.upper() == "ARI" else 0).alias("data_type"),
    )


def files_by_header(lines: DataFrame, marks: list[str]) -> dict[tuple[str, ...], list[str]]:
    """{cells of a header line: files of ``lines(value, file)`` that have it}. A header is a line with all of ``marks`` among its cells.

    Lines are only filtered, and one row per file reaches the driver, which lists the files anyway.
    """
    heads = lines.filter(is_header(marks)).select("file", header_cells().alias("cells")).distinct()
    found: dict[tuple[str, ...], list[str]] = {}
    for row in heads.toLocalIterator():
        found.setdefault(tuple(row["cells"]), []).append(row["file"])
    return found


def header_cells() -> Column:
    return F.split(F.regexp_replace("value", '["\\s\ufeff]', ""), ",")


def is_header(marks: list[str]) -> Column:
    among = F.size(F.array_except(F.array(*map(F.lit, marks)), header_cells())) == 0
    return F.contains("value", F.lit(marks[0])) & among


def read_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Hub forecasts in ``model=.../round=.../*.csv``; absent rounds simply have no rows.

    Files differ in their columns and in their order (``target`` is optional), so files are grouped by their header line and
    the lines of each group are parsed with its own schema. Folders are listed once, a group opens its own files alone, and no
    line is shuffled. A NULL target means that the file has no such column; a blank cell in a file that has it is the
    empty string. Files without a header line have no rows.
    """
    marks = ["id_valore", "luogo", "valore"]
    lines = spark.read.schema("value string, model string, round string").text(root)
    lines = lines.select("value", "model", "round", F.col("_metadata.file_path").alias("file"))
    out = None
    for cells, files in sorted(files_by_header(lines, marks).items()):
        # cells that are not wanted, or come twice, keep their place under a neutral name
        names = [c if c in ROUND_CELLS and c not in cells[:i] else f"_other{i}" for i, c in enumerate(cells)]
        options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
        parsed = F.from_csv("value", ", ".join(f"{c} string" for c in names), options)
        body = lines.filter(F.col("file").isin(files) & ~is_header(marks) & (F.trim("value") != ""))
        raw = body.select("model", "round", parsed.alias("r")).select("model", "round", "r.*")

        def cell(name: str):
            return F.col(name) if name in names else F.lit(None).cast("string")

        one = raw.select(
            "model",
            "round",
            cell("luogo").alias("luogo"),
            cell("tipo_valore").alias("tipo_valore"),
            cell("orizzonte").try_cast("int").alias("orizzonte"),
            (F.coalesce("target", F.lit("")) if "target" in names else cell("target")).alias("target"),
            to_number(cell("id_valore")).alias("id_valore"),
            to_number(cell("valore")).alias("valore"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        shape = "model string, round string, luogo string, tipo_valore string, orizzonte int, target string, id_valore double, valore double"
        return spark.createDataFrame([], shape)
    return out


def read_vintages(spark: SparkSession, root: str) -> DataFrame:
    """Truth files in ``vintage=YYYY_WW/*.csv`` as (vintage, year, week, value)."""
    raw = (
        spark.read.option("header", True)
        .schema("anno int, settimana int, incidenza string, vintage string")
        .csv(root)
    )
    return raw.select(
        "vintage",
        F.col("anno").alias("year"),
        F.col("settimana").alias("week"),
        to_number("incidenza").alias("value"),
    )


def read_bounding_boxes(spark: SparkSession, path: str) -> DataFrame:
    """JSON map code -> [name, [min_lon, min_lat, max_lon, max_lat]] as a flat dimension."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.from_json("value", "map<string, array<string>>").alias("m"))
    entry = parsed.select(F.explode("m").alias("code", "cell"))
    box = F.from_json(F.col("cell")[1], "array<double>")
    return entry.select(
        "code",
        F.lower(F.col("cell")[0]).alias("name"),
        box[0].alias("min_lon"),
        box[1].alias("min_lat"),
        box[2].alias("max_lon"),
        box[3].alias("max_lat"),
    )


def read_capitals(spark: SparkSession, path: str) -> DataFrame:
    """JSON map name -> [lat, lon]."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.from_json("value", "map<string, array<double>>").alias("m"))
    return parsed.select(F.explode("m").alias("name", "p")).select(
        "name", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon")
    )


def write_series(series: DataFrame, root: str, fmt: str = "csv", buckets: int = BUCKETS) -> None:
    """``buckets`` folders by a hash of the series, however many series there are. Rows are clustered by bucket and AQE splits
    an oversized one over several writers. Names with line breaks need ``fmt="parquet"``."""
    out = series.select(
        F.col("obs_date").alias("Time"),
        F.col("cases").alias("Cases"),
        F.col("data_type").alias("DataType"),
        "series_id",
        bucket_of(F.col("series_id"), buckets).alias("bucket"),
    ).hint("rebalance", "bucket")
    writer = out.write.mode("overwrite").partitionBy("bucket")
    if fmt == "csv":
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, **kept).csv(root)
    else:
        writer.format(fmt).save(root)


def write_documents(documents: DataFrame, root: str) -> None:
    """Nested documents, one JSON object per line."""
    documents.write.mode("overwrite").json(root)


def write_samples(samples: DataFrame, root: str) -> None:
    """Training samples as nested Parquet."""
    samples.write.mode("overwrite").parquet(root)
