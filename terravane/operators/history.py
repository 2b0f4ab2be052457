"""History of changing attributes, kept as checkpoints and patches.

The log of an entity is cut into segments of fixed length in time. A segment's store begins with a full version (the
checkpoint) and goes on with patches that hold only the attributes a version changed; after ``chain`` versions another
full one is put in. A store is kept in a folder with one partition a segment: ``write_store`` makes it, ``merge_into_store`` takes in
later and late versions by rewriting only the segments they fall in, ``as_of`` reads the state at an instant from the nearest
checkpoint before it. ``validity`` folds the patches forward from the nearest checkpoint and joins equal states across
segments. All sorting is done per (entity, segment), so an entity with a third of all rows is spread over its segments;
across segments only one small row each is looked at.

Defined cases: rows without key, version number or readable start are left out; of several rows of a version the last
recorded counts (highest id on a tie); of versions that start at one instant the highest counts; NULL attributes are
states like any other; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.common import US_PER_DAY
from terravane.session import cut

SEGMENT_DAYS = 30
CHAIN = 32


def effective_versions(log: DataFrame, key: Column, version: Column, start_us: Column, attributes: dict[str, Column], recorded: tuple[Column, ...], segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """The versions that count: (key, seg, start_us, version, state struct). Both reductions combine map-side or on spread keys."""
    names = list(attributes)
    rows = log.select(
        key.alias("key"), version.cast("long").alias("version"), start_us.alias("start_us"),
        F.struct(*[c.alias(n) for n, c in attributes.items()]).alias("state"), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(recorded)]).alias("recorded"),
    ).where(F.col("key").isNotNull() & F.col("version").isNotNull() & F.col("start_us").isNotNull())
    last = rows.groupBy("key", "version").agg(F.max_by(F.struct("start_us", "state"), "recorded").alias("last"))
    last = last.select("key", "version", F.col("last.start_us").alias("start_us"), F.struct(*[F.col(f"last.state.{n}").alias(n) for n in names]).alias("state"))
    segment = F.floor(F.col("start_us") / F.lit(float(segment_days * US_PER_DAY))).cast("int")
    return (
        last.withColumn("seg", segment).repartition("key", "seg")
        .groupBy("key", "seg", "start_us").agg(F.max_by(F.struct("version", "state"), "version").alias("top"))
        .select("key", "seg", "start_us", F.col("top.version").alias("version"), F.col("top.state").alias("state"))
    )


def encode(versions: DataFrame, chain: int = CHAIN, every: bool = False) -> DataFrame:
    """The store: (key, seg, start_us, version, kind full|patch, patch).

    patch has a field per attribute: NULL if unchanged, else a struct holding the new value, which may be NULL.
    Versions that change nothing are only stored with ``every``, which a store that late versions are merged into needs.
    """
    names = versions.schema["state"].dataType.names
    w = Window.partitionBy("key", "seg").orderBy("start_us")
    seen = versions.withColumn("before", F.lag("state").over(w)).withColumn("nth", F.row_number().over(w))
    full = F.pmod(F.col("nth") - 1, F.lit(chain)) == 0
    patch = F.struct(*[F.when(full | ~F.col(f"state.{n}").eqNullSafe(F.col(f"before.{n}")), F.struct(F.col(f"state.{n}").alias("v"))).alias(n) for n in names])
    stored = seen.select("key", "seg", "start_us", "version", F.when(full, F.lit("full")).otherwise(F.lit("patch")).alias("kind"), patch.alias("patch"))
    changed = F.lit(every)
    for n in names:
        changed = changed | F.col(f"patch.{n}").isNotNull()
    return stored.where(changed)


def fold(store: DataFrame) -> DataFrame:
    """States at every stored version, folded forward from the nearest checkpoint of the segment."""
    names = store.schema["patch"].dataType.names
    w = Window.partitionBy("key", "seg").orderBy("start_us")
    return store.select("key", "seg", "start_us", "version", F.struct(*[F.last(f"patch.{n}", ignorenulls=True).over(w).getField("v").alias(n) for n in names]).alias("state"))


def write_store(versions: DataFrame, path: str, chain: int = CHAIN) -> None:
    """Effective versions as a store in a folder."""
    encode(versions, chain, every=True).write.mode("overwrite").partitionBy("seg").parquet(path)


def merge_into_store(spark: SparkSession, path: str, versions: DataFrame, chain: int = CHAIN) -> None:
    """Takes effective versions into a store; of two at one instant the new one counts. Other segments stay untouched."""
    touched = versions.select("seg").distinct()  # one row a segment, bounded by the time the log spans
    old = fold(spark.read.parquet(path).join(F.broadcast(touched), "seg", "left_semi")).withColumn("new", F.lit(0))
    both = old.unionByName(versions.withColumn("new", F.lit(1)))
    kept = both.groupBy("key", "seg", "start_us").agg(F.max_by(F.struct("version", "state"), "new").alias("top")).select("key", "seg", "start_us", "top.version", "top.state")
    merged = cut(encode(kept, chain, every=True))  # what is read is about to be replaced
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seg").parquet(path)


def as_of(store: DataFrame, instant_us: int, segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """(key, version, state) at an instant: patches folded forward from the last checkpoint before it; entities that began later are left out."""
    names = store.schema["patch"].dataType.names
    before = store.where((F.col("seg") <= int(instant_us // (segment_days * US_PER_DAY))) & (F.col("start_us") <= instant_us))
    checkpoint = before.where("kind = 'full'").groupBy("key").agg(F.max("start_us").alias("from_us"))
    rows = before.join(checkpoint, "key").where("start_us >= from_us")
    told = [F.max_by(f"patch.{n}", F.when(F.col(f"patch.{n}").isNotNull(), F.col("start_us"))).getField("v").alias(n) for n in names]
    return rows.groupBy("key").agg(F.max_by("version", "start_us").alias("version"), *told).select("key", "version", F.struct(*names).alias("state"))


def validity(store: DataFrame) -> DataFrame:
    """(key, version, valid_from_us, valid_to_us, state): one row per longest period of equal state, -1 for no end."""
    w = Window.partitionBy("key", "seg").orderBy("start_us")
    states = fold(store).withColumn("before", F.lag(F.struct("state")).over(w))
    states = states.withColumn("opens", F.col("before").isNull()).where(F.col("opens") | ~F.col("before.state").eqNullSafe(F.col("state")))
    # one row a segment: how it begins and ends, and where its first own change is
    ends = states.groupBy("key", "seg").agg(
        F.min("start_us").alias("first_us"), F.min_by(F.struct("state"), "start_us").alias("first"), F.max_by(F.struct("state"), "start_us").alias("last"),
        F.min(F.when(~F.col("opens"), F.col("start_us"))).alias("inner_us"),
    )
    along = Window.partitionBy("key").orderBy("seg")
    ends = ends.withColumn("new", ~F.lag("last").over(along).eqNullSafe(F.col("first")))
    ends = ends.withColumn("start", F.when(F.col("new"), F.col("first_us")).otherwise(F.col("inner_us")))
    back = Window.partitionBy("key").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "seg", "new", F.last("start", ignorenulls=True).over(back).alias("next_us"))
    starts = states.join(ends, ["key", "seg"]).where(~F.col("opens") | F.col("new"))
    after = F.coalesce(F.lead("start_us").over(w), F.col("next_us"), F.lit(-1).cast("long"))
    return starts.select("key", "version", F.col("start_us").alias("valid_from_us"), after.alias("valid_to_us"), "state")


def by_segment(periods: DataFrame, until_us: Column, segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """(key, seg, from_us, to_us): disjoint periods repeated per segment they touch, so that an instant finds its period by an equi-join on (key, seg).

    periods: (key, from_us, to_us), to_us NULL for no end. An open period is carried on to ``until_us``, the last instant asked for.
    """
    length = F.lit(float(segment_days * US_PER_DAY))
    first = F.floor(F.col("from_us") / length).cast("int")
    last = F.floor(F.least(F.coalesce(F.col("to_us"), until_us), until_us) / length).cast("int")
    return periods.withColumn("seg", F.explode(F.when(last >= first, F.sequence(first, last)))).select("key", "seg", "from_us", "to_us")
