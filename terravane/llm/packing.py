"""Filling containers of fixed capacity with documents, by bin completion over the histogram of sizes.

A document of more than the capacity is cut into full pieces, which fill containers of their own, and a rest. What
remains to be packed is described by the number of items of each size, at most ``capacity`` numbers however many documents
there are; only these come to the driver. There a branch and bound search works container by container: around the largest
item left, the fillings no other one dominates are enumerated (one is dominated if an item or two of it could be exchanged
for a larger one left out that still fits), those of little waste first; each is taken as often as the counts allow, later once, and
the search goes on with the rest and comes back. A branch is left when its waste passes what a better packing may waste, or
when its containers and the Martello-Toth bound of the rest reach the best packing known. Best-fit decreasing and the first
descent are the first incumbents. The search ends when a packing meets the bound, when all is searched, or after ``nodes``
steps; the nodes spent and whether the packing is proven to be a best one come with it.

The plan, a list of (filling, times), holds at most a few entries per size. Items then find their container by
their running number among the items of their size, which is counted in blocks, so that a size shared by a third of all
documents is spread over many tasks.

Defined cases: texts of 0 tokens (NULL, empty) take no room and are left out; a piece is (doc, piece number, first token,
number of tokens); ties are broken by document id; repeated ids are separate items; capacities must be positive.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODES = 400_000
FILLINGS, STEPS = 12, 300
BLOCKS = 256
MAX_SIZES = 1_000_000

Plan = list[tuple[tuple[int, ...], int]]


@dataclass(frozen=True)
class Packing:
    """plan: (filling, times); bound: containers any packing needs; nodes: steps of the search; proven: no packing has fewer containers."""

    plan: Plan
    bound: int
    nodes: int
    proven: bool

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.plan)


def least_containers(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bound of Martello and Toth: items of more than half do not meet, and what fits beside them is limited. sizes in rising order."""
    if not counts.any():
        return 0
    number, room = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * sizes))
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    a = np.append(0, sizes[:half])
    first, beside = np.searchsorted(sizes, a, side="left"), np.searchsorted(sizes, capacity - a, side="right")
    alone = number[-1] - number[half]
    spare = (number[beside] - number[half]) * capacity - (room[beside] - room[half])
    over = -((spare - (room[half] - room[np.minimum(first, half)])) // capacity)
    return int(max(-(-room[-1] // capacity), alone + max(0, int(over.max()))))


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Each item, largest first, into the fullest container it fits in."""
    spaces: list[int] = []  # in rising order
    boxes: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(fill: tuple[int, ...], times: int) -> None:
        space = capacity - sum(fill)
        if space not in boxes:
            spaces.insert(bisect_left(spaces, space), space)
            boxes[space] = []
        boxes[space].append((fill, times))

    for s in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        n = histogram[s]
        while n:
            k = bisect_left(spaces, s)
            if k == len(spaces):
                each = capacity // s
                if n >= each:
                    put((s,) * each, n // each)
                if n % each:
                    put((s,) * (n % each), 1)
                break
            space = spaces[k]
            fill, times = boxes[space].pop()
            if not boxes[space]:
                del boxes[space]
                spaces.pop(k)
            each = space // s
            whole = min(times, n // each)
            if whole:
                put(fill + (s,) * each, whole)
                n -= whole * each
            if times > whole and 0 < n < each:
                put(fill + (s,) * n, 1)
                n, whole = 0, whole + 1
            if times > whole:
                put(fill, times - whole)
    return [(f, t) for held in boxes.values() for f, t in held]


class Completion:
    """The search; sizes fall, counts are what is left of each."""

    def __init__(self, histogram: dict[int, int], capacity: int, nodes: int) -> None:
        self.sizes = sorted((s for s, n in histogram.items() if n > 0), reverse=True)
        self.counts = [histogram[s] for s in self.sizes]
        self.capacity, self.budget, self.nodes, self.whole = capacity, nodes, 0, True
        self.rising = np.array(self.sizes[::-1], np.int64)
        self.room = sum(s * n for s, n in zip(self.sizes, self.counts))
        self.best = best_fit_decreasing(histogram, capacity)
        self.least = sum(n for _, n in self.best)
        self.bound = self.rest_bound()

    def rest_bound(self) -> int:
        return least_containers(self.rising, np.array(self.counts[::-1], np.int64), self.capacity)

    def dominated(self, fill: list[int], used: dict[int, int], waste: int) -> bool:
        """Whether one or two items (places in ``sizes``) could be exchanged for a larger one left out that still fits."""
        kinds = list(used)
        wholes = [self.sizes[k] for k in kinds] + [self.sizes[k] + self.sizes[m] for i, k in enumerate(kinds) for m in kinds[i if used[k] > 1 else i + 1 :]]
        for j, x in enumerate(wholes):
            low, high = x + (j < len(kinds)), x + waste
            k = len(self.sizes) - 1 - int(np.searchsorted(self.rising, low, side="left"))
            while k >= 0 and self.sizes[k] <= high:
                if self.counts[k] > used.get(k, 0):
                    return True
                k -= 1
        return False

    def fillings(self, top: int, allowance: int) -> list[tuple[int, list[int]]]:
        """(waste, places of the sizes beside ``top``) of the undominated fillings around one item of it, least waste first."""
        live = [k for k in range(top, len(self.sizes)) if self.counts[k] > 0]
        held = [self.sizes[k] for k in live]
        tail = np.append(np.cumsum([self.sizes[k] * self.counts[k] for k in reversed(live)])[::-1], 0).tolist() if live else [0]
        rising = held[::-1]
        found: list[tuple[int, list[int]]] = []
        stack: list[tuple[int, int, int, tuple[int, ...]]] = [(0, self.capacity - self.sizes[top], self.capacity + 1, ())]
        steps = 0
        while stack:
            if len(found) >= FILLINGS or steps >= STEPS:
                self.whole = False
                break
            at, space, skipped, chosen = stack.pop()
            steps += 1
            at = max(at, len(rising) - int(np.searchsorted(rising, space, side="right")))
            if at == len(live):
                used: dict[int, int] = {}
                for k in chosen:
                    used[k] = used.get(k, 0) + 1
                if space < skipped and space <= allowance and not (chosen and self.dominated(list(chosen), used, space)):
                    found.append((space, list(chosen)))
                continue
            k, s = live[at], held[at]
            most = min(self.counts[k], space // s)
            for n in range(0, most + 1):  # the largest number is taken from the stack first
                left = space - n * s
                if left - tail[at + 1] <= allowance:
                    stack.append((at + 1, left, min(skipped, s) if n < self.counts[k] else skipped, (*chosen, *(k,) * n)))
        self.nodes += steps
        return sorted(found, key=lambda x: x[0])

    def options(self, allowance: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """(places of sizes, times) to go on with: fillings of the least waste found with little search, then all others, then each once."""
        top = next(k for k, n in enumerate(self.counts) if n)
        given: dict[tuple[int, ...], int] = {}
        limit, last = 0, False
        while not last:
            last = limit >= allowance or bool(given)
            self.counts[top] -= 1
            found = self.fillings(top, allowance if last else limit)
            self.counts[top] += 1
            for waste, beside in found:
                fill = (top, *beside)
                if fill in given:
                    continue
                used: dict[int, int] = {}
                for k in fill:
                    used[k] = used.get(k, 0) + 1
                given[fill] = min(self.counts[k] // n for k, n in used.items())
                yield fill, given[fill]
                if len(fill) <= 2 and waste == 0:  # nothing can be better than one item that fills the rest
                    return
            limit = 2 * limit + 1
        if len(given) > 1:
            yield from [(fill, 1) for fill, times in given.items() if times > 1]

    def take(self, fill: tuple[int, ...], times: int) -> None:
        for k in fill:
            self.counts[k] -= times

    def run(self) -> Packing:
        path: list[tuple[tuple[int, ...], int]] = []
        used = wasted = 0
        frames: list[Iterator] = []
        if self.least > self.bound:
            frames.append(self.options(self.capacity * (self.least - 1) - self.room))
        while frames and self.least > self.bound and self.nodes < self.budget:
            step = next(frames[-1], None)
            if step is None:
                frames.pop()
                if path:
                    fill, times = path.pop()
                    self.take(fill, -times)
                    used -= times
                    wasted -= times * (self.capacity - sum(self.sizes[k] for k in fill))
                continue
            fill, times = step
            self.take(fill, times)
            path.append(step)
            used += times
            wasted += times * (self.capacity - sum(self.sizes[k] for k in fill))
            self.nodes += 1
            spare = self.capacity * (self.least - 1) - self.room - wasted  # what a better packing may still waste
            if not any(self.counts):
                if used < self.least:
                    self.least, self.best = used, [(tuple(self.sizes[k] for k in f), n) for f, n in path]
                frames.append(iter(()))
            elif spare < 0 or used + self.rest_bound() >= self.least:
                frames.append(iter(()))
            else:
                frames.append(self.options(spare))
        searched = not frames and self.whole
        return Packing(self.best, self.bound, self.nodes, self.least == self.bound or searched)


def complete(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> Packing:
    """A packing of every item of the histogram (size -> number)."""
    if any(n > 0 and (s <= 0 or s > capacity) for s, n in histogram.items()):
        raise ValueError("sizes must be in 1..capacity")
    return Completion(histogram, capacity, nodes).run()


def slots(filled: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per size the rows (first running number, items per container, first container, position in it), in order of running numbers."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for fill, times in filled:
        place = 0
        for s in sorted(set(fill), reverse=True):
            n = fill.count(s)
            out.setdefault(s, []).append((taken.get(s, 0), n, first, place))
            taken[s] = taken.get(s, 0) + n * times
            place += n
        first += times
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pack(sized: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", nodes: int = NODES) -> DataFrame:
    """(target_id, container_id, position, doc, piece, first_token, n_tokens), each item once per target.

    sized should be materialised: it is read once for the histograms, which are collected (at most capacity rows per target,
    MAX_SIZES in all), and once for the result. targets: (target_id, capacity_tokens), a small table of its own.
    """
    return arrange(sized, targets, key, size, nodes)[0]


def arrange(sized: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", nodes: int = NODES) -> tuple[DataFrame, dict[int, Packing]]:
    """The rows of ``pack`` and the packing of the rests of each target."""
    listed = targets.where("target_id is not null and capacity_tokens > 0").select("target_id", "capacity_tokens").distinct().limit(1_001).collect()
    if len(listed) > 1_000 or sum(r["capacity_tokens"] for r in listed) > MAX_SIZES:
        raise ValueError("targets are meant to be few and their capacities small")
    caps = sorted((r["target_id"], r["capacity_tokens"]) for r in listed)
    items = sized.where(F.col(size) > 0).select(F.col(key).alias("doc"), F.col(size).cast("long").alias("size"))
    wide = items.withColumn("target", F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("target_id"), F.lit(c).cast("long").alias("cap")) for t, c in caps]).cast("array<struct<target_id:bigint,cap:bigint>>")))
    rest = wide.select("target.target_id", "target.cap", "doc", "size", (F.col("size") % F.col("target.cap")).alias("rest"), F.floor(F.col("size") / F.col("target.cap")).alias("full"))
    counted = rest.groupBy("target_id", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()
    layout, containers, done, before = {}, {}, {}, {}
    for t, c in caps:
        mine = sorted((r["rest"], r["n"], r["full"]) for r in counted if r["target_id"] == t)
        done[t] = complete({s: n for s, n, _ in mine if s > 0}, c, nodes)
        layout[t] = slots(done[t].plan)
        containers[t] = done[t].containers
        # full pieces are numbered over all sizes, after the containers of the rests
        ends = np.append(0, np.cumsum([f for _, _, f in mine])).tolist()
        before[t] = {s: containers[t] + e for (s, _, _), e in zip(mine, ends)}

    # running numbers: within blocks of a size, then plus the blocks before
    blk = F.pmod(F.xxhash64("doc"), F.lit(BLOCKS)).cast("int")
    parts = rest.withColumn("blk", blk)
    totals = parts.groupBy("target_id", "rest", "blk").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    up = Window.partitionBy("target_id", "rest").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("target_id", "rest", "blk", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(b) for c, b in (("n", "before"), ("f", "full_before"))])
    within = Window.partitionBy("target_id", "rest", "blk").orderBy("doc", "size")
    numbered = parts.select("*", (F.row_number().over(within) - 1).alias("nth"), (F.sum("full").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("full_nth"))
    numbered = numbered.join(starts, ["target_id", "rest", "blk"]).select("target_id", "cap", "doc", "size", "rest", "full", (F.col("before") + F.col("nth")).alias("nth"), (F.col("full_before") + F.col("full_nth")).alias("full_nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            target, size_, nth = b["target_id"].to_numpy(), b["rest"].to_numpy(), b["nth"].to_numpy()
            box, pos, whole = (np.full(len(target), -1, np.int64) for _ in range(3))
            order = np.lexsort((size_, target))
            t, s = target[order], size_[order]
            edge = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])))
            for lo, hi in zip(edge, np.append(edge[1:], len(order))):
                whole[order[lo:hi]] = before[int(t[lo])][int(s[lo])]
                if s[lo] == 0:
                    continue
                at, table = order[lo:hi], layout[int(t[lo])][int(s[lo])]
                row = table[np.searchsorted(table[:, 0], nth[at], side="right") - 1]
                off = nth[at] - row[:, 0]
                box[at] = row[:, 2] + off // row[:, 1]
                pos[at] = row[:, 3] + off % row[:, 1]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in ("target_id", "cap", "doc", "rest", "full")], pa.array(whole + b["full_nth"].to_numpy()), pa.array(box), pa.array(pos)], ["target_id", "cap", "doc", "rest", "full", "full_at", "box", "pos"])

    kind = sized.schema[key].dataType.simpleString()
    placed = numbered.mapInArrow(place, f"target_id long, cap long, doc {kind}, rest long, full long, full_at long, box long, pos long")
    tail = placed.where("rest > 0").select("target_id", F.col("box").alias("container_id"), F.col("pos").alias("position"), "doc", F.col("full").alias("piece"), (F.col("full") * F.col("cap")).alias("first_token"), F.col("rest").alias("n_tokens"))
    pieces = placed.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    pieces = pieces.select("target_id", (F.col("full_at") + F.col("piece")).alias("container_id"), F.lit(0).cast("long").alias("position"), "doc", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.col("cap").alias("n_tokens"))
    return tail.unionByName(pieces).withColumnRenamed("doc", key), done


def usage(packed: DataFrame, targets: DataFrame, done: dict[int, Packing]) -> DataFrame:
    """Per target: containers, tokens, the least number of containers any packing needs, the share of room left unused, and what the search says."""
    per_box = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("p"))
    boxes = per_box.groupBy("target_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.sum("p").alias("n_pieces"))
    told = packed.sparkSession.createDataFrame([(t, p.containers - p.bound, p.nodes, p.proven) for t, p in done.items()], "target_id long, over long, search_nodes long, proven_least boolean")
    both = boxes.join(targets.select("target_id", "capacity_tokens"), "target_id").join(F.broadcast(told), "target_id")
    room = F.col("n_containers") * F.col("capacity_tokens")
    return both.select("target_id", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", (F.col("n_containers") - F.col("over")).alias("least_containers"), (1 - F.col("n_tokens") / room).alias("unused_share"), "search_nodes", "proven_least")


def checks(packed: DataFrame, sized: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Per target whether each token is packed once, pieces of a document follow each other, no container holds more than its capacity, and only documents above the capacity are split."""
    told = targets.select("target_id", "capacity_tokens")
    boxes = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(told, "target_id")
    boxes = boxes.groupBy("target_id").agg(F.bool_and(F.col("n") <= F.col("capacity_tokens")).alias("within_capacity"))
    docs = packed.groupBy("target_id", key).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("p"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"), F.count_distinct("first_token").alias("starts"))
    full = sized.where(F.col(size) > 0).select(F.col(key), F.col(size).alias("size"), F.explode(F.array(*[F.lit(r["target_id"]) for r in told.collect()]).cast("array<bigint>")).alias("target_id"))
    met = full.join(docs, ["target_id", key], "full").join(told, "target_id")
    once = F.coalesce((F.col("n") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("starts") == F.col("p")), F.lit(False))
    whole = F.coalesce((F.col("p") == 1) | (F.col("size") > F.col("capacity_tokens")), F.lit(False))
    per = met.groupBy("target_id", "capacity_tokens").agg(F.bool_and(once).alias("each_token_once"), F.bool_and(whole).alias("split_only_above_capacity"))
    return per.join(boxes, "target_id")
