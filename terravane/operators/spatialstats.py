"""Spatial association with permutation significance, on a k-nearest-neighbour list.

A permutation orders all ids by a hash of (number, id) and gives the value of the n-th id in id order to the n-th in hash
order, so it needs no random stream and is the same on any cluster. The hash order is counted in BUCKETS of leading digits
and shifted by the rows of the buckets before, so no task sorts a whole permutation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.operators.ranking import numbered

ALPHA = 0.05
DIGITS = 3
BUCKETS = 16**DIGITS
HELD_POINTS, HELD_EDGES = 4_000_000, 40_000_000  # up to so many, a task holds all values and neighbours and judges whole permutations


def standardized(points: DataFrame, value: str, out: str) -> DataFrame:
    s = points.agg(F.avg(value).alias("m"), (F.stddev_samp(value) + 1e-12).alias("s"))
    return points.withColumn(out, (F.col(value) - s.select("m").scalar()) / s.select("s").scalar())


def permuted(points: DataFrame, columns: list[str], permutations: int) -> DataFrame:
    """(perm, id, columns): ``columns`` moved between ids, once per permutation."""
    home = numbered(points.select("id"), "id", "pos").select(F.col("id").alias("to"), "pos")
    drawn = points.select("id", *columns).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    drawn = drawn.withColumn("__h", F.unhex(F.md5(F.concat(F.col("perm").cast("string"), F.lit(":"), F.col("id").cast("string")))))
    drawn = drawn.withColumn("__b", F.conv(F.substring(F.hex("__h"), 1, DIGITS), 16, 10).cast("int"))
    along = Window.partitionBy("perm").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = drawn.groupBy("perm", "__b").agg(F.count("*").alias("__n")).select("perm", "__b", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"))
    within = Window.partitionBy("perm", "__b").orderBy("__h")
    placed = drawn.withColumn("__in", F.row_number().over(within)).join(before, ["perm", "__b"]).withColumn("pos", F.col("__before") + F.col("__in") - 1)
    return placed.join(home, "pos").select("perm", F.col("to").alias("id"), *columns)


def lag(edges: DataFrame, values: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    v = values.select(*by, F.col("id").alias("j"), F.col(value).alias("__v"))
    return edges.select("i", "j").join(v, "j").groupBy(*by, F.col("i").alias("id")).agg(F.avg("__v").alias(out))


def quadrant(significant: Column, own: Column, around: Column) -> Column:
    return F.when(significant & (own > 0) & (around > 0), "HH").when(significant & (own < 0) & (around < 0), "LL").when(significant & (own > 0) & (around < 0), "HL").when(significant & (own < 0) & (around > 0), "LH").otherwise("NS")


def _beyond_held(z: DataFrame, edges: DataFrame, permutations: int, own_moves: bool) -> DataFrame | None:
    """(id, beyond): how many permutations give a local coefficient at least as far from 0 as the real one, by the permutations of ``permuted``; None for tables that don't fit in a task."""
    if z.count() > HELD_POINTS or edges.count() > HELD_EDGES:
        return None
    spark = z.sparkSession
    held = z.select("id", "z", "y").toArrow().sort_by("id")
    if any(held[c].null_count for c in held.column_names) or not held.num_rows:
        return None
    ids, own, y = (held[c].to_numpy() for c in ("id", "z", "y"))
    sent = spark.sparkContext.broadcast(ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            i, j = (b[c].to_numpy() for c in ("i", "j"))
            at, to = np.searchsorted(known, i), np.searchsorted(known, j)
            good = (known[np.minimum(at, len(known) - 1)] == i) & (known[np.minimum(to, len(known) - 1)] == j)
            yield pa.RecordBatch.from_arrays([pa.array((at[good] << 32) | to[good])], ["e"])

    pairs = np.sort(edges.select("i", "j").mapInArrow(place, "e long").toArrow()["e"].to_numpy())
    if not len(pairs):
        return None
    degree = np.bincount(pairs >> 32, minlength=len(ids))
    rows = np.flatnonzero(degree)
    near, starts = (pairs & 0xFFFFFFFF).astype(np.int32), np.concatenate([[0], np.cumsum(degree[rows])])
    del pairs
    world = spark.sparkContext.broadcast((ids, own, y, rows, near, starts))

    def judged(numbers: Iterator[int]) -> Iterator[np.ndarray]:
        ids, own, y, rows, near, starts = world.value
        degree = np.diff(starts)

        def product(v: np.ndarray, mine: np.ndarray) -> np.ndarray:
            around = np.empty(len(rows))
            for a in range(0, len(rows), 65_536):
                b = min(a + 65_536, len(rows))
                around[a:b] = np.add.reduceat(v[near[starts[a] : starts[b]]], starts[a:b] - starts[a]) / degree[a:b]
            return np.abs(mine[rows] * around)

        real, count, texts = product(y, own), np.zeros(len(rows), np.int32), [str(i).encode() for i in ids.tolist()]
        for number in numbers:
            first, md5 = f"{number}:".encode(), hashlib.md5
            h = np.frombuffer(b"".join([md5(first + t).digest() for t in texts]), ">u8").reshape(-1, 2)
            high = h[:, 0].astype(np.uint64)
            order = np.argsort(high, kind="stable")
            if (high[order[1:]] == high[order[:-1]]).any():
                order = np.lexsort((h[:, 1].astype(np.uint64), high))
            moved = y[order]
            count += product(moved, moved if own_moves else own) >= real
        yield count

    slices = min(permutations, 4 * spark.sparkContext.defaultParallelism)
    total = spark.sparkContext.parallelize(range(1, permutations + 1), slices).mapPartitions(judged).treeReduce(np.add)
    sent.unpersist()
    world.unpersist()
    return spark.createDataFrame(pa.table({"id": ids[rows], "beyond": total.astype(np.int64)}))


def local_moran(points: DataFrame, edges: DataFrame, value: str, permutations: int, with_value: str | None = None) -> DataFrame:
    """(id, z, lag, local_i, p_value, cluster). With ``with_value`` the lag is of that variable and only it is permuted (bivariate); else a permutation moves a point's own value too."""
    other = with_value or value
    z = standardized(points.select("id", F.col(value).alias("a"), F.col(other).alias("b")), "a", "z")
    z = standardized(z, "b", "y").select("id", "z", "y")
    own = z.join(lag(edges, z, "y", [], "lag"), "id").withColumn("local_i", F.col("z") * F.col("lag"))
    beyond = _beyond_held(z, edges, permutations, with_value is None)
    if beyond is None:
        shuffled = permuted(z, ["y"], permutations)
        null = lag(edges, shuffled, "y", ["perm"], "lag_p")
        null = null.join(z.select("id", F.col("z").alias("own")), "id") if with_value else null.join(shuffled.select("perm", "id", F.col("y").alias("own")), ["perm", "id"])
        beyond = null.join(own.select("id", "local_i"), "id").groupBy("id").agg(F.count_if(F.abs(F.col("own") * F.col("lag_p")) >= F.abs("local_i")).alias("beyond"))
    p = (F.col("beyond") + 1) / F.lit(float(permutations + 1))
    out = own.join(beyond, "id").withColumn("p_value", p)
    return out.select("id", "z", "lag", "local_i", "p_value", quadrant(F.col("p_value") <= ALPHA, F.col("z"), F.col("lag")).alias("cluster"))


def global_moran(points: DataFrame, edges: DataFrame, value: str, permutations: int, with_value: str | None = None) -> DataFrame:
    """(coefficient, p_value, n): mean of z times the lag; only the lagged variable is permuted."""
    other = with_value or value
    z = standardized(points.select("id", F.col(value).alias("a"), F.col(other).alias("b")), "a", "z")
    z = standardized(z, "b", "y").select("id", "z", "y")
    real = z.join(lag(edges, z, "y", [], "lag"), "id").agg(F.avg(F.col("z") * F.col("lag")).alias("coefficient"), F.count("*").alias("n"))
    null = lag(edges, permuted(z, ["y"], permutations), "y", ["perm"], "lag").join(z.select("id", "z"), "id").groupBy("perm").agg(F.avg(F.col("z") * F.col("lag")).alias("c"))
    beyond = null.agg(F.count_if(F.abs("c") >= F.abs(real.select("coefficient").scalar())).alias("beyond"))
    return real.select("coefficient", ((beyond.scalar() + 1) / F.lit(float(permutations + 1))).alias("p_value"), "n")


def gi_star(points: DataFrame, edges: DataFrame, value: str, k: int, permutations: int = 0, binary: bool = False) -> DataFrame:
    """(id, z_score[, p_value, cluster]).

    binary=False: a point weighs 1/2 and each of its k neighbours 1/(2k). binary=True: the point and its k-1 nearest weigh 1.
    """
    s = points.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count("*").cast("double").alias("n"))
    m, sd, n = (s.select(c).scalar() for c in ("m", "s", "n"))
    used = edges.where(F.col("rank") <= k - 1) if binary else edges
    w_self, w_sum, w_sq = (1.0, float(k), float(k)) if binary else (0.5, 1.0, 0.25 + 0.25 / k)
    scale = sd * F.sqrt(F.greatest((n * w_sq - w_sum * w_sum) / (n - 1), F.lit(1e-15)))

    def z_of(values: DataFrame, by: list[str]) -> DataFrame:
        v = values.select(*by, F.col("id").alias("j"), F.col(value).alias("__v"))
        near = used.select("i", "j").join(v, "j").groupBy(*by, F.col("i").alias("id")).agg((F.sum("__v") if binary else F.avg("__v") / 2).alias("near"))
        return near.join(values.select(*by, "id", F.col(value).alias("own")), [*by, "id"]).withColumn("z_score", (w_self * F.col("own") + F.col("near") - m * w_sum) / scale).select(*by, "id", "z_score")

    real = z_of(points.select("id", value), [])
    if not permutations:
        return real
    null = z_of(permuted(points.select("id", value), [value], permutations), ["perm"]).withColumnRenamed("z_score", "zp")
    beyond = null.join(real, "id").groupBy("id").agg(F.count_if(F.abs("zp") >= F.abs("z_score")).alias("beyond"))
    hot, cold = ("HOT", "COLD") if binary else ("HOTSPOT", "COLDSPOT")
    out = real.join(beyond, "id").select("id", "z_score", ((F.col("beyond") + 1) / F.lit(float(permutations + 1))).alias("p_value"))
    return out.withColumn("cluster", F.when((F.col("p_value") <= ALPHA) & (F.col("z_score") > 0), hot).when((F.col("p_value") <= ALPHA) & (F.col("z_score") < 0), cold).otherwise("NS"))


def association_matrix(points: DataFrame, edges: DataFrame, variables: list[str], permutations: int) -> DataFrame:
    """(x, y, coefficient, p_value) of every ordered pair; 1 and 0 on the diagonal."""
    out = None
    for x in variables:
        for y in variables:
            if x == y:
                row = points.sparkSession.range(1).select(F.lit(1.0).alias("coefficient"), F.lit(0.0).alias("p_value"))
            else:
                row = global_moran(points, edges, x, permutations, y).select("coefficient", "p_value")
            row = row.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "coefficient", "p_value")
            out = row if out is None else out.unionByName(row)
    return out


def compare_periods(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes by id of two Gi* results, and the counts of their transitions."""
    both = a.select("id", F.col("z_score").alias("z_t0"), F.col("cluster").alias("c0")).join(b.select("id", F.col("z_score").alias("z_t1"), F.col("cluster").alias("c1")), "id")
    changes = both.select("id", "z_t0", "z_t1", (F.col("z_t1") - F.col("z_t0")).alias("delta_z"), F.concat_ws("->", "c0", "c1").alias("transition"))
    return changes, changes.groupBy("transition").agg(F.count("*").alias("n"))
