"""Graphs as two tables: components, shortest paths, centrality, spanning trees and corridors.

Components, paths and spanning trees work on edges of any size by rounds of joins, each round written to reliable storage; hulls are
made of hulls of shares. Centralities are made in shares of the sources, each of which holds the edges of one component.
"""

from __future__ import annotations

import heapq
import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.ranking import ordinal01
from terravane.session import cut

MAX_COMPONENT = 20_000
MAX_POOL, DRAWS = 2_000_000, 100_000


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once, smaller end first, the lightest of repeated ones; loops are left out."""
    e = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if "weight" in edges.columns else e.distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): the smallest id of each connected component.

    Each round offers every node and its root the smallest label among the node's neighbours, and then takes the label's
    own label (pointer jumping), so the number of rounds grows with the logarithm of the diameter. Every round is cut on
    reliable storage. Rounds go on until no label changes; with ``rounds``, labels that still change then are an error.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    for turn in itertools.count(1):
        seen = both.join(labels.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        rooted = seen.join(labels, seen["src"] == labels["id"]).select(F.explode(F.array_distinct(F.array("src", "component"))).alias("id"), "c")
        near = rooted.groupBy("id").agg(F.min("c").alias("c"))
        step = cut(labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("new")))
        hop = step.select(F.col("id").alias("new"), F.col("new").alias("jump"))
        labels = cut(step.join(hop, "new", "left").select("id", F.least("new", F.coalesce("jump", "new")).alias("component")))
        if step.where("old <> new").isEmpty():
            return labels
        if turn == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")


def shortest_paths(edges: DataFrame, source: int, rounds: int | None = None) -> DataFrame:
    """(id, distance): least weight of a path from the source to every node it reaches, by rounds of relaxation of changed nodes.

    Rounds go on until no distance changes, at most one for each node when weights are not negative; a negative weight is an
    error, and so is a changed node after ``rounds`` rounds.
    """
    both = cut(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    if not both.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    spark = edges.sparkSession
    best = spark.createDataFrame([(source, 0.0)], "id long, distance double")
    front = best
    for turn in itertools.count(1):
        offered = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("offer")).groupBy("id").agg(F.min("offer").alias("offer"))
        merged = cut(best.join(offered, "id", "full").select("id", F.least(F.coalesce("distance", "offer"), F.coalesce("offer", "distance")).alias("distance"), (F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).alias("new")))
        best, front = merged.select("id", "distance"), merged.where("new").select("id", "distance")
        if front.isEmpty():
            return best
        if turn == rounds:
            raise RuntimeError(f"distances still change after {rounds} rounds")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, degree_centrality)."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("n")).scalar()
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), (F.coalesce("degree", F.lit(0)) / F.greatest(n - 1, F.lit(1))).alias("degree_centrality"))


def _adjacency(pdf: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    adj: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"]):
        adj.setdefault(int(a), []).append((int(b), float(w)))
        adj.setdefault(int(b), []).append((int(a), float(w)))
    return adj


def _brandes(adj: dict[int, list[tuple[int, float]]], sources: list[int]) -> tuple[dict[int, float], dict[int, float]]:
    """Weighted betweenness (unordered pairs) and sum of distances of the given sources (Brandes 2001)."""
    between, total = dict.fromkeys(adj, 0.0), {}
    for s in sources:
        done: dict[int, float] = {}
        seen = {s: 0.0}
        paths, before, order = {s: 1.0}, {s: []}, []
        heap = [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = d
            order.append(v)
            for u, w in adj[v]:
                if u in done:
                    continue
                nd = d + w
                if u not in seen or nd < seen[u] - 1e-12:
                    seen[u], paths[u], before[u] = nd, paths[v], [v]
                    heapq.heappush(heap, (nd, u))
                elif abs(nd - seen[u]) <= 1e-12:
                    paths[u] += paths[v]
                    before[u].append(v)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for p in before[v]:
                share[p] += paths[p] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v] / 2
        total[s] = sum(done.values())
    return between, total


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return edges.join(labels.select(F.col("id").alias("src"), "component"), "src")


def centrality(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, share: int = 256, fan: int = 64) -> DataFrame:
    """(id, betweenness, closeness) with weights as lengths; closeness is scaled by the share of nodes reached.

    The sources of a component are cut into shares of about ``share`` nodes, ``fan`` of them at most; each share is a task with
    all edges of its component, and the sums of the shares are the whole. Exact for any size: the work grows with nodes times edges.
    """
    labels = cut(labels if labels is not None else components(nodes, edges))
    n = nodes.count()
    parts = labels.groupBy("component").agg(F.least(F.lit(fan), F.ceil(F.count("*") / F.lit(float(share)))).cast("int").alias("parts"))
    sent = cut(_labelled(edges, labels)).join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        adj, at, of = _adjacency(pdf), int(pdf["part"].iloc[0]), int(pdf["parts"].iloc[0])
        between, total = _brandes(adj, [v for k, v in enumerate(sorted(adj)) if k % of == at])
        ids, m = list(adj), len(adj)
        pairs = max((n - 1) * (n - 2) / 2, 1)
        return pd.DataFrame({"id": ids, "betweenness": [between[i] / pairs for i in ids], "closeness": [(m - 1) / total[i] * (m - 1) / (n - 1) if total.get(i, 0.0) > 0 else 0.0 for i in ids]})

    made = sent.groupBy("component", "part").applyInPandas(one, "id long, betweenness double, closeness double")
    made = made.groupBy("id").agg(F.sum("betweenness").alias("betweenness"), F.sum("closeness").alias("closeness"))
    return nodes.select("id").join(made, "id", "left").fillna(0.0, ["betweenness", "closeness"])


def spanning_tree(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, most: int = MAX_COMPONENT) -> DataFrame:
    """(component, src, dst, weight) of the minimum spanning forest, ties by (weight, src, dst).

    Components of at most ``most`` nodes are made in one task each (Kruskal), larger ones by rounds of joins (Boruvka); the order of
    the edges is total, so both give the same tree.
    """
    labels = cut(labels if labels is not None else components(nodes, edges))
    large = cut(labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component"))
    inside = _labelled(edges, labels)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        pdf = pdf.sort_values(["weight", "src", "dst"])
        keep = []
        for a, b in zip(pdf["src"], pdf["dst"]):
            ra, rb = root(int(a)), root(int(b))
            keep.append(ra != rb)
            parent[ra] = rb
        return pdf[keep][["component", "src", "dst", "weight"]]

    schema = "component long, src long, dst long, weight double"
    small = inside.join(large, "component", "left_anti").groupBy("component").applyInPandas(one, schema)
    if large.isEmpty():
        return small
    return small.unionByName(_rounds_of_merging(inside.join(large, "component", "left_semi").select("component", "src", "dst", "weight")))


def _rounds_of_merging(edges: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """Each part takes the least edge that leaves it and the parts it joins become one, until no edge leaves any: at most log2(nodes) rounds.

    part: (id, part) that the nodes are in at first, each its own if not given.
    """
    left = cut(edges.where("src <> dst"))
    if part is None:
        part = cut(left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct().withColumn("part", F.col("id")))
    tree: list[DataFrame] = []
    while True:
        a, b = part.select(F.col("id").alias("src"), F.col("part").alias("pa")), part.select(F.col("id").alias("dst"), F.col("part").alias("pb"))
        left = cut(left.select("component", "src", "dst", "weight").join(a, "src").join(b, "dst").where("pa <> pb"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, tree) if tree else left.select("component", "src", "dst", "weight")
        ends = left.select("*", F.explode(F.array("pa", "pb")).alias("p"))
        taken = cut(ends.groupBy("p").agg(F.min(F.struct("weight", "src", "dst", "component", "pa", "pb")).alias("e")).select("e.*").distinct())
        tree.append(taken.select("component", "src", "dst", "weight"))
        parts = part.select(F.col("part").alias("id")).distinct()
        joined = components(parts, taken.select(F.col("pa").alias("src"), F.col("pb").alias("dst")))
        part = cut(part.join(joined.select(F.col("id").alias("part"), F.col("component").alias("now")), "part").select("id", F.col("now").alias("part")))


def corridors(nodes: DataFrame, edges: DataFrame, density: DataFrame, least: int = 3, weights: tuple[float, float, float, float] = (0.30, 0.35, 0.20, 0.15), permutations: int = 99) -> DataFrame:
    """``corridors_of`` the components and the spanning forest of a list of edges."""
    labels = components(nodes, edges)
    links = _labelled(edges, labels).groupBy("component").agg(F.count("*").alias("links"))
    return corridors_of(nodes, labels, links, spanning_tree(nodes, edges, labels), density, least, weights, permutations)


def corridors_of(nodes: DataFrame, labels: DataFrame, links: DataFrame, forest: DataFrame, density: DataFrame, least: int = 3, weights: tuple[float, float, float, float] = (0.30, 0.35, 0.20, 0.15), permutations: int = 99) -> DataFrame:
    """Support of each component as a corridor, best first: mean density, connectivity, evenness of its tree, dated nodes. nodes may hold a date ``day``.

    p_value is one-sided: how often as many densities, drawn from all nodes with replacement, give at least this support. A
    draw is the hash of its number, component and place, so it is the same on any cluster. Up to MAX_POOL densities go to every task.
    """
    density = cut(density.select("id", "density"))
    members = nodes.join(labels, "id").join(density.select("id", F.col("density").alias("dn")), "id", "left")
    day = F.col("day") if "day" in nodes.columns else F.lit(None).cast("date")
    per = members.groupBy("component").agg(F.count("*").alias("nodes"), F.avg("dn").alias("density"), F.count(day).alias("dated"), F.datediff(F.max(day), F.min(day)).alias("span"))
    tree = forest.groupBy("component").agg(F.avg("weight").alias("m"), F.stddev_pop("weight").alias("s"), F.count("*").alias("t"))
    all_ = per.join(links, "component").join(tree, "component").where(F.col("nodes") >= least)
    connect = F.col("links") / F.greatest(F.col("nodes") * (F.col("nodes") - 1) / 2, F.lit(1))
    even = F.when(F.col("t") > 1, 1 / (1 + F.col("s") / (F.col("m") + 1e-9))).otherwise(F.lit(1.0))
    temporal = F.when(F.col("dated") < 2, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.col("dated") / (F.greatest(F.col("span"), F.lit(1)) + 1) * 30))
    out = all_.select("component", "nodes", "density", connect.alias("connectivity"), even.alias("continuity"), temporal.alias("temporal_support"))
    a, b, c, e = (w / sum(weights) for w in weights)
    out = cut(out.withColumn("confidence", a * F.col("density") + b * F.col("connectivity") + c * F.col("continuity") + e * F.col("temporal_support")))
    known = density.where(F.col("density").isNotNull())
    n = known.count()
    pool = ordinal01(known, "density", "id", "pos").select(F.round(F.col("pos") * max(n - 1, 0)).cast("long").alias("pos"), F.col("density").alias("drawn"))
    pool = F.broadcast(pool) if n <= MAX_POOL else pool
    each = out.select("component", F.col("density").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"), "nodes")
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("nodes"), F.lit(DRAWS).cast("long")))  # in blocks, so that no task makes all draws of a large component
    draws = each.withColumn("first", first).repartition(8 * out.sparkSession.sparkContext.defaultParallelism, "component", "perm", "first")
    draws = draws.withColumn("place", F.explode(F.sequence("first", F.least("nodes", F.col("first") + (DRAWS - 1)))))
    drawn = draws.withColumn("pos", F.pmod(F.xxhash64("perm", "component", "place"), F.lit(max(n, 1)))).join(pool, "pos").groupBy("component", "perm").agg(F.avg("drawn").alias("null"), F.first("own").alias("own"))
    beyond = drawn.groupBy("component").agg(F.count_if(a * F.col("null") >= a * F.col("own") - 1e-12).alias("beyond"))
    return out.join(beyond, "component", "left").withColumn("p_value", (F.coalesce("beyond", F.lit(0)) + 1) / F.lit(float(permutations + 1))).drop("beyond").orderBy(F.desc("confidence"), "component")


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise (monotone chain)."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) <= 2:
        return np.array(pts)

    def chain(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def hulls(nodes: DataFrame, labels: DataFrame, least: int = 3, fan: int = 32) -> DataFrame:
    """(component, nodes, share, confidence, wkt) of components of at least ``least`` points; confidence is min(.99, .5 + .5 share).

    The hull of a component is that of the hulls of ``fan`` shares of it, so no task holds all points of a large one.
    """
    n = nodes.count()
    sized = nodes.join(labels, "id")
    counts = sized.groupBy("component").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= least)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(pdf[["lon", "lat"]].to_numpy())
        return pd.DataFrame({"component": pdf["component"].iloc[0], "lon": ring[:, 0], "lat": ring[:, 1]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(pdf[["lon", "lat"]].to_numpy())
        text = ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*ring, ring[0]])
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "wkt": [f"POLYGON (({text}))" if len(ring) >= 3 else f"LINESTRING ({text})"]})

    points = sized.join(counts.select("component"), "component", "left_semi").select("component", "lon", "lat", F.pmod(F.xxhash64("id"), F.lit(fan)).alias("part"))
    shares = points.groupBy("component", "part").applyInPandas(corners, "component long, lon double, lat double")
    rings = shares.groupBy("component").applyInPandas(one, "component long, wkt string")
    share = F.col("nodes") / F.lit(float(max(n, 1)))
    return counts.join(rings, "component").select("component", "nodes", share.alias("share"), F.least(F.lit(0.99), 0.5 + 0.5 * share).alias("confidence"), "wkt")


def ranked_corridors(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Undirected edges once, heaviest first."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    ordered = e.orderBy(F.desc("weight"), "src", "dst")
    return ordered.limit(limit) if limit else ordered


def proximity_weight(distance: float) -> float:
    return 1 / (1 + distance) if distance >= 0 else math.nan
