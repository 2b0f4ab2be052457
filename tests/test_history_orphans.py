from __future__ import annotations

import random

from pyspark.sql import functions as F

from terravane.common import instant_us, month_of, object_key, plain_status, skew_join
from terravane.operators import history, orphans

DAY = 86_400_000_000
LOG = "id long, object_key string, version int, name string, status string, start long, rec long"


def periods(spark, rows, **kw):
    df = spark.createDataFrame(rows, LOG)
    v = history.effective_versions(df, object_key(F.col("object_key")), F.col("version"), F.col("start"), {"name": F.col("name"), "status": plain_status(F.col("status"))}, (F.col("rec"), F.col("id")), **{k: x for k, x in kw.items() if k == "segment_days"})
    out = history.validity(history.encode(v, **{k: x for k, x in kw.items() if k == "chain"}))
    return sorted((r["key"], r["version"], r["valid_from_us"], r["valid_to_us"]) for r in out.collect())


def brute(rows):
    last = {}
    for i, k, v, n, s, t, rec in rows:
        key = (k or "").lower().replace("-", "").strip()
        if not key or v is None or t is None:
            continue
        if (key, v) not in last or (rec, i) > last[(key, v)][0]:
            last[(key, v)] = ((rec, i), t, n, s.strip().lower() if s is not None else None)
    at = {}
    for (key, v), (_, t, n, s) in last.items():
        if (key, t) not in at or v > at[(key, t)][0]:
            at[(key, t)] = (v, n, s)
    out, by = [], {}
    for (key, t), x in at.items():
        by.setdefault(key, []).append((t, *x))
    for key, xs in by.items():
        xs.sort()
        starts = [x for i, x in enumerate(xs) if i == 0 or x[2:] != xs[i - 1][2:]]
        out += [(key, x[1], x[0], starts[i + 1][0] if i + 1 < len(starts) else -1) for i, x in enumerate(starts)]
    return sorted(out)


def test_history_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        k = rnd.choice(["aa-1", "AA1", " bb", "cc", "dd", None, " "])
        rows.append((i, k, rnd.choice([None, *range(1, 40)]), rnd.choice(["x", "y", None]), rnd.choice(["Active", " active", "deleted", None]), rnd.choice([None, *[d * DAY // 2 for d in range(120)]]), rnd.randint(0, 9)))
    want = brute(rows)
    assert periods(spark, rows) == want
    assert periods(spark, rows, segment_days=3, chain=2) == want


def test_history_empty_and_unchanged(spark):
    assert periods(spark, []) == []
    assert periods(spark, [(1, "a", 1, None, None, 5, 1), (2, "a", 2, None, None, 9 * DAY * 40, 1), (2, "a", 2, None, None, 9 * DAY * 40, 1)]) == [("a", 1, 5, -1)]


def test_instants(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01 05:30:00+05:30", "2023-12-31T19:00:00.000000-05:00", "n/a", "", None, "2024-01-01T00:00:00", "2024-01-01"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant_us(F.col("t"))).collect()]
    base = 1_704_067_200_000_000
    assert got == [base, base, base, None, None, None, base, base]
    assert spark.range(1).select(month_of(F.lit(base - 1)), month_of(F.lit(base))).first()[:] == ("2023-12", "2024-01")


def graph(spark, cyclic=False):
    schema = "row_key long, at_us long, rec long, pk string, ref string"
    top = spark.createDataFrame([("p1", 10), ("p2", 50), ("p2", 40), ("p3", 1)], "key string, rec long")
    gone = spark.createDataFrame([("p3", 100, 200)], "key string, from_us long, to_us long")
    mid = spark.createDataFrame([(1, 5, 20, "m1", "p1"), (2, 5, 20, "m2", "px"), (3, 5, 30, "m3", "p2"), (4, 150, 30, "m4", "p3"), (5, 250, 30, "m5", "p3"), (6, None, 30, "m6", "p3"), (7, 5, 30, "m7", None), (2, 5, 20, "m2", "px")], schema)
    low = spark.createDataFrame([(10, 5, 99, "l1", "m1"), (11, 5, 99, "l2", "m2"), (12, 5, 99, "l3", "m4"), (13, 5, 99, "l4", "zz"), (14, None, None, "l5", "m3")], schema)
    keys = mid.select(F.col("pk").alias("key"), "rec")
    return orphans.Graph({"mid": orphans.Node("mid", mid, "top"), "low": orphans.Node("low", low, "mid")}, {"top": orphans.Parent(top, gone), "mid": orphans.Parent(keys)})


def test_orphans_direct_and_inherited(spark):
    got = {(r["table_name"], r["row_key"]): (r["reason"], r["kind"], r["level"]) for r in orphans.find(graph(spark)).collect()}
    assert got == {("mid", 2): ("missing", "direct", 0), ("mid", 3): ("late", "direct", 0), ("mid", 4): ("deleted", "direct", 0), ("low", 13): ("missing", "direct", 0), ("low", 11): ("inherited", "inherited", 1), ("low", 12): ("inherited", "inherited", 1), ("low", 14): ("inherited", "inherited", 1)}


def test_orphans_of_a_table_that_refers_to_itself(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a", None), (2, 1, 2, "b", "a"), (3, 1, 3, "c", "gone"), (4, 1, 4, "d", "c"), (5, 1, 5, "e", "d"), (6, 1, 6, "f", "f")], "row_key long, at_us long, rec long, pk string, ref string")
    g = orphans.Graph({"t": orphans.Node("t", rows, "t")}, {"t": orphans.Parent(rows.select(F.col("pk").alias("key"), "rec"))})
    assert g.cyclic
    assert sorted((r["row_key"], r["level"]) for r in orphans.find(g).collect()) == [(3, 0), (4, 1), (5, 2)]


def test_orphans_empty(spark):
    g = graph(spark)
    g.nodes = {k: orphans.Node(n.name, n.rows.limit(0), n.parent) for k, n in g.nodes.items()}
    assert orphans.find(g).count() == 0


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i % 7) for i in range(300)] + [(999, None)], "i long, k long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k long, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(map(str, skew_join(left, right, ["k"], how, F.col("i"), share=0.1, fan=4).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect())), how


def test_store_takes_in_late_versions(spark, tmp_path):
    import random

    rnd, day = random.Random(3), 86_400_000_000
    rows = [(f"k{k}", v, 1 + rnd.randrange(200 * day), rnd.choice("abc"), rnd.choice(["x", None])) for k in range(12) for v in range(1, 40)]
    make = lambda part: history.effective_versions(
        spark.createDataFrame(part, "key string, version long, at long, name string, status string"), F.col("key"), F.col("version"), F.col("at"), {"name": F.col("name"), "status": F.col("status")}, (F.col("version"),)
    )
    parts, path = [rows[i::3] for i in range(3)], str(tmp_path / "store")
    history.write_store(make(parts[0]), path, chain=4)
    for part in parts[1:]:
        history.merge_into_store(spark, path, make(part), chain=4)
    store = spark.read.parquet(path)
    plain = lambda df: sorted((r["key"], r["valid_from_us"], r["valid_to_us"], *r["state"]) for r in df.collect())
    assert plain(history.validity(store)) == plain(history.validity(history.encode(make(rows))))
    for instant in (5 * day, 77 * day, 500 * day):
        want = {}
        for k, _, at, name, status in sorted(rows, key=lambda r: (r[2], r[1])):
            if at <= instant:
                want[k] = (name, status)
        assert {r["key"]: tuple(r["state"]) for r in history.as_of(store, instant).collect()} == want
