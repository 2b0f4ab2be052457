"""References to records that do not exist, with a fixpoint cascade down the foreign-key graph.

Direct orphans are found per parent table for all its children at once: the reference is ``missing`` (no row has the
key), ``late`` (recorded before the key first was) or ``deleted`` (the key was deleted at the row's own time). The
cascade then goes down the graph level by level: rows whose parent row is itself an orphan are inherited orphans, found
by semi-joins of the children with the orphaned keys; rows reached once leave the search, so cycles end.

Defined cases: a NULL or blank key is no reference; rows without a readable time have a NULL period and cannot refer to a
deleted key; repeated rows are one; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.common import month_of, skew_join
from terravane.operators.history import SEGMENT_DAYS, by_segment
from terravane.session import cut

US = float(86_400_000_000)


@dataclass(frozen=True)
class Node:
    """A table of the graph. rows: (row_key long, at_us long, rec timestamp, pk string, ref string); pk is the key others use, ref the key it uses."""

    name: str
    rows: DataFrame
    parent: str | None = None


@dataclass(frozen=True)
class Parent:
    """What is known of a referred table's keys. keys: (key, rec) of all rows; deletions: disjoint (key, from_us, to_us), to_us NULL for no end."""

    keys: DataFrame
    deletions: DataFrame | None = None
    segment_days: int = SEGMENT_DAYS


@dataclass
class Graph:
    nodes: dict[str, Node]
    parents: dict[str, Parent]
    cyclic: bool = field(init=False)

    def __post_init__(self) -> None:
        up = {n.name: n.parent for n in self.nodes.values()}
        self.cyclic = any(self._returns(up, n) for n in up)

    @staticmethod
    def _returns(up: dict[str, str | None], start: str) -> bool:
        at, steps = up.get(start), 0
        while at is not None and steps <= len(up):
            if at == start:
                return True
            at, steps = up.get(at), steps + 1
        return False


def _tagged(node: Node) -> DataFrame:
    r = node.rows
    return r.select(F.lit(node.name).alias("table_name"), "row_key", "at_us", "rec", r["pk"].cast("string").alias("pk"), r["ref"].cast("string").alias("key"))


def classify(children: DataFrame, parent: Parent) -> DataFrame:
    """The children with ``reason``, NULL where the reference holds."""
    first = parent.keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("rec").alias("first_rec"), F.lit(True).alias("known"))
    rows = children.where(F.col("key").isNotNull())
    found = skew_join(rows, first, ["key"], "left", F.struct("row_key", "rec"))
    reason: Column = F.when(F.col("known").isNull(), "missing").when(F.col("rec") < F.col("first_rec"), "late")
    if parent.deletions is not None:
        length = F.lit(parent.segment_days * US)
        until = F.lit(children.agg(F.max("at_us").alias("m")).scalar())
        gone = by_segment(parent.deletions, until, parent.segment_days).select("key", "seg", "from_us", "to_us")
        found = found.withColumn("seg", F.floor(F.col("at_us") / length).cast("int"))
        hit = (F.col("at_us") >= F.col("from_us")) & (F.col("to_us").isNull() | (F.col("at_us") < F.col("to_us")))
        found = found.join(gone, ["key", "seg"], "left").drop("seg")
        reason = F.coalesce(reason, F.when(hit, "deleted"))
    return found.withColumn("reason", reason).select("table_name", "row_key", "at_us", "pk", "key", "reason").distinct()


def _once(judged: DataFrame) -> DataFrame:
    """One row per referring row, with its reason if it has one."""
    return judged.groupBy("table_name", "row_key", "at_us", "pk", "key").agg(F.max("reason").alias("reason"))


def find(graph: Graph, max_levels: int | None = None) -> DataFrame:
    """(table_name, period, row_key, reason, kind direct|inherited, level, via): level 0 is direct, via the table referred to."""
    via = {n.name: n.parent for n in graph.nodes.values()}
    judged: dict[str, DataFrame] = {}
    for p, known in graph.parents.items():
        kids = [_tagged(n) for n in graph.nodes.values() if n.parent == p]
        if kids:
            judged[p] = classify(reduce(DataFrame.unionByName, kids), known)
    direct = [d.where(F.col("reason").isNotNull()).withColumn("level", F.lit(0)).withColumn("via", F.lit(p)) for p, d in judged.items()]
    held = {p: _once(d).where(F.col("reason").isNull()) for p, d in judged.items() if p in graph.nodes}  # not reached so far, by parent
    out, level, frontier = list(direct), 0, direct
    levels = max_levels or (None if graph.cyclic else len(graph.nodes))
    while frontier and (levels is None or level < levels):
        level += 1
        reached = reduce(DataFrame.unionByName, frontier)
        new = []
        for p in held:
            if not graph.cyclic and not _can_reach(via, p, level):
                continue
            bad = reached.where((F.col("table_name") == p) & F.col("pk").isNotNull()).select(F.col("pk").alias("key")).distinct()
            new.append(skew_join(held[p], bad, ["key"], "left_semi", F.col("row_key")).withColumn("reason", F.lit("inherited")).withColumn("level", F.lit(level)).withColumn("via", F.lit(p)))
            held[p] = held[p].join(bad, ["key"], "left_anti")
        if graph.cyclic and new:
            held = {p: cut(d) for p, d in held.items()}
            new = [d for d in map(cut, new) if not d.isEmpty()]
        out, frontier = out + new, new
    found = reduce(DataFrame.unionByName, out)
    return found.select("table_name", month_of(F.col("at_us")).alias("period"), "row_key", "reason", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind"), "level", "via").distinct()


def _can_reach(up: dict[str, str | None], table: str, level: int) -> bool:
    """Whether rows of ``table`` can be orphans of level-1 at all: it must have that many tables above it."""
    n, at = 0, up.get(table)
    while at is not None and n < level:
        n, at = n + 1, up.get(at)
    return n >= level


def counts(found: DataFrame) -> DataFrame:
    """Orphans per table and period, by reason and kind."""
    return found.groupBy("table_name", "period", "reason", "kind").agg(F.count("*").alias("n_rows"))
