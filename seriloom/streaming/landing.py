"""The daily re-pull as a Structured Streaming job over a landing folder.

Each landed CSV file is one full pull. The stream remembers which files it has seen (its
checkpoint), so a restarted driver neither skips nor repeats a pull.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seriloom.functions import fixed_values as fv
from seriloom.functions.storage import finished_folders, fresh_path
from seriloom.plans.refresh import Published, REFUSE, publish, verdict
from seriloom.sources.feed import to_observations


def watch_landing(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    as_of: Callable[[], Column],
    on_published: Callable[[Published], None],
) -> StreamingQuery:
    """Process every new pull once, in order, then stop (available-now trigger).

    An accepted pull is written to ``store`` as the next version (``pull=<batch id>``) before its
    tables are published; a refused one leaves the last good version in place.
    """
    schema = ", ".join(f"{c} string" for c in fv.FEED_COLUMNS)
    pulls = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("comment", "#")
        .option("maxFilesPerTrigger", 1)
        .csv(landing)
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        session = batch.sparkSession
        new = _keep(batch)
        previous = _last_version(session, store, batch_id)
        decision = verdict(new, previous)
        if decision == "unchanged" or decision in REFUSE:
            return
        # same batch id on a retry, so a repeated attempt replaces its own half-written version
        new.write.mode("overwrite").parquet(f"{store}/pull={batch_id:09d}")
        obs = to_observations(new).select("series_id", "obs_date", "ili", "ari")
        on_published(publish(obs, as_of()))

    return (
        pulls.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _keep(batch: DataFrame) -> DataFrame:
    """The pull is read several times: write it once to the shared folder."""
    path = fresh_path(batch.sparkSession, "pull")
    batch.write.parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def _last_version(spark: SparkSession, store: str, before: int) -> DataFrame | None:
    """Newest accepted version older than ``before``, or None. Versions are found by the folders whose write was completed, so
    no earlier pull is read, and the half-written one of a lost attempt does not count."""
    numbers = [int(name.removeprefix("pull=")) for name in finished_folders(spark, store, "pull=*")]
    newest = max((n for n in numbers if n < before), default=None)
    return None if newest is None else spark.read.parquet(f"{store}/pull={newest:09d}")
