"""Column and join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}]"
US_PER_DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 UTC of ISO-8601 text in any offset; text without an offset is UTC; unreadable text is NULL."""
    clean = F.trim(text)
    zoned = F.when(clean.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & clean.rlike(r"\d:\d"), clean).otherwise(F.concat(clean, F.lit("Z")))
    full = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}"), F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    day = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(clean, F.lit("T00:00:00Z")))
    return F.unix_micros(F.coalesce(full, day).try_cast("timestamp"))


def month_of(us: Column) -> Column:
    """UTC month yyyy-MM of an instant in microseconds, whatever the session's zone."""
    days = F.floor(us / F.lit(float(US_PER_DAY))).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def object_key(raw: Column) -> Column:
    """One spelling of a key: lower case, no hyphens, no surrounding blanks; blank keys are NULL."""
    key = F.regexp_replace(F.lower(raw), rf"^(?:{BLANK}|-)+|(?:{BLANK}|-)+$|-", "")
    return F.when(key != "", key)


def plain_status(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), rf"^{BLANK}+|{BLANK}+$", "")


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", spread: Column | None = None, share: float = 1 / 512, fan: int = 32) -> DataFrame:
    """Equi-join in which keys holding more than ``share`` of the left rows are spread over ``fan`` tasks.

    At most 1/share keys can be that frequent, so the list of them is broadcast under a proven bound. Their right
    rows are repeated ``fan`` times, all others once. ``spread`` is a column that tells left rows of one key apart.
    how: left, inner, left_semi or left_anti.
    """
    counted = left.groupBy(*on).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n").alias("t"))
    hot = counted.where(F.col("__n") > total.scalar() * F.lit(share)).select(*on, F.lit(True).alias("__hot"))
    salt = F.pmod(F.xxhash64(spread if spread is not None else F.struct(*left.columns)), F.lit(fan)).cast("int")
    lost = F.lit(False)
    for c in on:  # rows without a key find nothing, but would all be sent to one task
        lost = lost | F.col(c).isNull()
    a = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot") | lost, salt).otherwise(F.lit(0))).drop("__hot")
    b = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def by_group(keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``work`` on the rows of each group in turn. Rows come clustered by their keys; small groups share batches, large results may be given in parts."""

    def codes(column: pa.Array) -> np.ndarray:
        if pa.types.is_string(column.type) or column.null_count:
            return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return column.to_numpy(zero_copy_only=False)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in keys:
                code = codes(b[c])
                new[1:] |= code[1:] != code[:-1]
            first = tuple(b[c][0].as_py() for c in keys)
            new[0] = last is not None and first != last
            at = 0
            for c in np.append(np.flatnonzero(new), b.num_rows):
                if c > at:
                    held.append(b.slice(at, c - at))
                if c < b.num_rows and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                at = c
            last = tuple(b[c][b.num_rows - 1].as_py() for c in keys)
        if held:
            yield from work(pa.Table.from_batches(held))

    return walk
