"""State as append-only logs: records, versions, deletions and schema versions, read through latest-by-key.

Every append is a new set of Parquet files with a batch number, so readers see whole batches and a failed writer leaves
nothing half done; a table is never rewritten. Schemas grow by ``mergeSchema``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.territory import latest, latest_values


@dataclass(frozen=True)
class Log:
    """A keyed log under ``path``. Rows get ``seq``: batch number, then the writer's own order column."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def append(self, rows: DataFrame, batch: int, order: str | None = None, deleted: bool = False) -> None:
        """Writing a batch again replaces it, so a repeated run does no harm."""
        seq = F.struct(F.lit(batch).cast("long").alias("batch"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("n"))
        rows.withColumn("seq", seq).withColumn("deleted", F.lit(deleted)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").option("basePath", self.path).parquet(self.path).drop("batch")

    def current(self) -> DataFrame:
        """Last row of each key that is not deleted."""
        return latest(self.rows(), list(self.keys), "seq").where(~F.col("deleted")).drop("seq", "deleted")

    def upserted(self) -> DataFrame:
        """Per key the last non-null value of each column."""
        return latest_values(self.rows(), list(self.keys), "seq").drop("seq", "deleted")

    def history(self, limit: int | None = None) -> DataFrame:
        h = self.rows().orderBy(F.desc("seq"))
        return h.limit(limit) if limit else h

    def version(self) -> int:
        """Number of different schemas the log has had, found without reading data."""
        files = {f.rsplit("/", 1)[0] for f in self.rows().inputFiles()}
        return len({self.spark.read.parquet(f).schema.simpleString() for f in files})


def run_with_retry(operation, attempts: int = 3, fallback=None, wait: float = 0.0):  # noqa: ANN001, ANN201
    """operation() with bounded, growing waits; then fallback() if given, else the last error."""
    import time

    for i in range(attempts):
        try:
            return operation()
        except Exception:
            if i + 1 == attempts:
                if fallback is not None:
                    return fallback()
                raise
            time.sleep(wait * 2**i)
    return None


def health(jobs: DataFrame, order: str, status: str = "status", last: int = 100) -> DataFrame:
    """(status, n) over the ``last`` newest jobs."""
    return jobs.orderBy(F.desc(order)).limit(last).groupBy(status).agg(F.count("*").alias("n"))
