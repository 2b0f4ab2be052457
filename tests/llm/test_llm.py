from __future__ import annotations

import itertools
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terravane.llm import packing, quality, queries, tokens
from terravane.llm import quantiles as Q

PATH = tokens.vocabulary_path()


def whole(text: str, **kw) -> list[int]:
    ends, parts, at = tokens.chunk_cuts(text, **kw), [], 0
    for e in ends:
        parts.append(tokens.encode_chunk(text[at:e], PATH))
        at = e
    return tokens.repair(parts, PATH).tolist()


def test_repair_agrees_with_encoding_at_once():
    rnd, enc = random.Random(7), tokens.encoder(PATH)
    alphabet = "ab 'lldstvrem \n\t  19é中。!?- 　🙂'"
    for _ in range(3_000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 150)))
        assert whole(t, bits=rnd.choice([1, 2, 3]), least=rnd.choice([1, 2, 5]), most=rnd.choice([3, 8, 30])) == enc.encode_ordinary(t)
    for t in ("x" * 9_000, " " * 5_000, "<|endoftext|> hi", "word " * 20_000, "\n" * 300 + "a"):
        assert whole(t) == enc.encode_ordinary(t)


def test_equal_passages_give_equal_chunks():
    rnd = random.Random(1)
    passage = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 999)) for _ in range(800))
    cut = lambda t: {t[a:b] for a, b in itertools.pairwise([0, *tokens.chunk_cuts(t)])}
    shared = cut("intro one. " + passage) & cut("another, longer beginning! " + passage)
    assert sum(map(len, shared)) > 0.8 * len(passage)


def test_ids_of_rows(spark):
    enc = tokens.encoder(PATH)
    long = "The corridor moved again. " * 4_000
    rows = [(1, "hello world", 1), (1, "hello world", 1), (1, "other text", 2), (2, None, 3), (3, "", 4), (4, long, 5), (5, long + "end", 6), (None, "no id", 7), (6, "   \n", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in tokens.ids_of(df).collect()), key=str)
    assert got == sorted(((k, enc.encode_ordinary(t) if t else []) for k, t, _ in rows), key=str)
    assert tokens.ids_of(df.limit(0)).count() == 0
    shared = "A passage that stands in every text of this table, long enough to be a chunk of its own; " * 8
    many = spark.createDataFrame([(i, shared + f"end {i % 50}") for i in range(200)], "doc_id long, text string")
    assert all(list(r["ids"]) == enc.encode_ordinary(shared + f"end {r['doc_id'] % 50}") for r in tokens.ids_of(many).collect())
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.sizes_of(df.where("doc_id > 1")).collect()}
    assert n[2] == n[3] == 0 and n[4] == len(enc.encode_ordinary(long))


def optimum(items: list[int], cap: int) -> int:
    best = [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k + items[i] <= cap:
                b = bins.copy()
                b[b.index(k)] += items[i]
                go(i + 1, b)
        go(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def unpacked(plan: packing.Plan, cap: int) -> dict[int, int]:
    back: dict[int, int] = {}
    for f, n in plan:
        assert sum(f) <= cap and n > 0
        for s in f:
            back[s] = back.get(s, 0) + n
    return back


def test_completion_packs_all_items_in_the_least_containers():
    rnd = random.Random(3)
    proven = 0
    for _ in range(300):
        cap = rnd.randint(10, 40)
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 10))]
        hist = {s: items.count(s) for s in items}
        p = packing.complete(hist, cap)
        assert unpacked(p.plan, cap) == hist
        best = optimum(items, cap)
        assert p.bound <= best <= p.containers
        assert p.containers == best or not p.proven
        proven += p.proven
    assert proven > 290
    with pytest.raises(ValueError):
        packing.complete({50: 1}, 10)
    assert packing.complete({}, 10).plan == []


def test_completion_is_below_best_fit_where_the_bound_leaves_room():
    g = np.random.default_rng(1)
    better = 0
    for cap, n, lo, hi in ((1000, 60, 150, 500), (100, 500, 15, 60), (100, 200, 26, 49), (2048, 1000, 500, 1100)):
        hist: dict[int, int] = {}
        for s in g.integers(lo, hi + 1, n).tolist():
            hist[s] = hist.get(s, 0) + 1
        greedy = packing.best_fit_decreasing(hist, cap)
        assert unpacked(greedy, cap) == hist
        p = packing.complete(hist, cap, nodes=60_000)
        assert unpacked(p.plan, cap) == hist
        assert p.bound <= p.containers <= sum(n for _, n in greedy)
        better += p.containers < sum(n for _, n in greedy)
    assert better >= 3


def test_pack_rows(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([3, 7, 7, 7, 12, 40, 64, 65, 200, 0]) for _ in range(400)] + [None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n_tokens long")
    targets = spark.createDataFrame([(1, 64), (2, 256), (None, 5), (3, None)], "target_id long, capacity_tokens long")
    rows = packing.pack(df, targets).collect()
    for t, cap in ((1, 64), (2, 256)):
        mine = [r for r in rows if r["target_id"] == t]
        fill, doc = {}, {}
        for r in mine:
            fill.setdefault(r["container_id"], []).append(r)
            doc.setdefault(r["doc_id"], []).append(r)
        assert all(sum(x["n_tokens"] for x in b) <= cap and len({x["position"] for x in b}) == len(b) for b in fill.values())
        assert {d: sum(x["n_tokens"] for x in p) for d, p in doc.items()} == {i: s for i, s in enumerate(sizes) if s}
        assert all(len(p) == 1 for d, p in doc.items() if sizes[d] <= cap)
        assert len(fill) <= -(-sum(s for s in sizes if s) // cap) * 1.1 + 1
    packed, done = packing.arrange(df, targets)
    u = packing.usage(packed, targets, done).collect()
    assert all(0 <= r["unused_share"] < 0.1 and r["n_containers"] >= r["least_containers"] for r in u)
    for r in packing.checks(packed, df, targets.where("target_id in (1, 2)")).collect():
        assert r["each_token_once"] and r["split_only_above_capacity"] and r["within_capacity"]
    lost = packing.checks(packed.where("doc_id <> 3"), df, targets.where("target_id in (1, 2)")).collect()
    assert not any(r["each_token_once"] for r in lost)
    assert packing.pack(df.limit(0), targets).count() == 0


def rank_gap(x: np.ndarray, v: float, q: float) -> float:
    return max(0.0, np.searchsorted(x, v, "left") / len(x) - q, q - np.searchsorted(x, v, "right") / len(x))


def test_sketches_keep_their_bound_after_merging():
    g = np.random.default_rng(2)
    for values in (g.lognormal(0, 2, 60_000), np.sort(g.normal(size=60_000)), np.round(g.exponential(2, 60_000)), np.full(5_000, 3.0)):
        for upper in (True, False):
            parts = [Q.Sketch(upper=upper) for _ in range(23)]
            for p, v in zip(parts, np.array_split(values, 23)):
                p.update(v)
            while len(parts) > 1:
                a = parts.pop(0)
                a.merge(Q.Sketch.of(dict(zip(("upper", "n", "low", "high", "states", "sections", "sizes", "items"), parts.pop(0).row())), Q.K))
                parts.append(a)
            s, x = parts[0], np.sort(values)
            assert s.n == len(values) and s.weighted()[1].sum() == len(values)
            for q in (0.001, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 0.9999):
                assert rank_gap(x, s.quantiles([q])[0], q) <= s.rank_error(q)
            assert s.quantiles([0.0, 1.0]).tolist() == [x[0], x[-1]]


def test_both_tails_and_coins():
    x = np.sort(np.random.default_rng(5).lognormal(0, 2, 200_000))
    s = Q.Sketch(upper=False)
    s.update(np.random.default_rng(6).permutation(x))
    assert s.rank_error(0.01) < 0.001 and rank_gap(x, s.quantiles([0.01])[0], 0.01) <= s.rank_error(0.01)
    coins = {tuple(Q.Sketch(seed=seed)._coin(0) for seed in range(64)), tuple([0] * 64), tuple([1] * 64)}
    assert len(coins) == 3


def test_quantiles_of_groups(spark):
    g = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", "d1" if i % 2 else "d2", float(v)) for i, v in enumerate(g.normal(size=6_000))]
    rows += [("a", "d1", None), ("a", "d1", float("nan")), ("b", "d1", float("inf")), (None, "d1", 4.0), ("empty", "d9", None)]
    df = spark.createDataFrame(rows, "src string, day string, m double").repartition(5)
    vals = Q.long_values(df, ["m"], [F.col("src"), F.col("day")])
    daily = Q.merge(Q.build(vals, ["src", "day"], "v"), ["src", "day"])
    out = Q.percentiles(Q.merge(daily, ["src"]), ["src"], [0.01, 0.5, 0.99]).collect()
    for k in ("a", "b"):
        x = np.sort([v for s, _, v in rows if s == k and v is not None and np.isfinite(v)])
        for r in (r for r in out if r["src"] == k):
            assert r["n"] == len(x) and rank_gap(x, r["value"], r["q"]) <= r["rank_error"]
    assert {r["src"] for r in out} == {"a", "b", None}
    told = Q.percentiles(Q.merge(daily, ["src"]), ["src"], [0.01, 0.5, 0.99])
    seen = Q.within(vals, told, ["src"]).where("src is not null").collect()
    assert len(seen) == 6 and all(r["within"] for r in seen)
    assert not any(r["within"] for r in Q.within(vals, told.withColumn("value", F.col("value") + 1), ["src"]).where("src is not null").collect())
    both = Q.build(vals, ["src", "day"], "v", ways=[["src"], ["day"]])
    assert {r["way"] for r in both.collect()} == {0, 1}
    assert Q.percentiles(Q.merge(Q.build(vals.limit(0), ["src"], "v"), ["src"]), ["src"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        Q.percentiles(daily, ["src"], [1.5])


PROSE = "We went to the river and there was no smoke, but the fire had been seen before. It is not what we had said."
TEXTS = {
    "prose": PROSE, "ru": "Мы проверили слой около реки, и там осталось только несколько точек. Это было вчера.", "zh": "我们检查了附近的图层，只剩下720个点。昨天我们去了那里，已经看不到烟了。下雨以后边界变了，所以我们又重新画了一遍。还有很多。",
    "quoted": "> " + PROSE + "\n> " + PROSE + "\n\nI agree with all of that.", "markup": f"<p>{PROSE}</p><br/>", "unseen": PROSE.replace(" ", "\u200b ") + "\ufeff", "short": "a,b,c,1,2", "empty": "", "blank": " \n\t ", "null": None,
    "table": "| 07/07 | 9478 | 650 |\n" * 20, "list": "- old ridge, 9\n- odd export\n- steady hotspot\n- noisy plot\n" * 4, "urls": "https://a.example/x/1\n" * 10, "noise": "$\\!|<<$]@_[^@$@}~]>|}%>}>_/]=~<%$*_|_^[!/}@^" * 4, "base64": "xndQHEpFDpW8l2xz91SuObJSbsoywC0K39spIwWI68lkiz8x7gzwA19dXfiivuMb" * 3,
    "mixed": "Same here, thank you for looking into it.\n\n" + "9567,8610,12/09,46.2\n" * 20, "long": (PROSE + " ") * 5_000,
}
COMMON = ["we", "to", "the", "and", "there", "was", "no", "but", "had", "been", "before", "it", "is", "not", "what", "i", "with", "all", "of", "that", "for", None, "we"]


def test_quality_rules(spark):
    df = spark.createDataFrame([(k, v, 1) for k, v in TEXTS.items()], "doc_id string, text string, key int")
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.assess(df, words).collect()}
    assert {k for k, r in got.items() if "no_prose" in r["reasons"]} == {"table", "list", "urls", "noise", "base64", "mixed"}
    assert all(list(got[k]["reasons"])[0] == "empty" and got[k]["n_words"] == 0 and got[k]["prose_share"] is None for k in ("empty", "blank", "null"))
    assert got["prose"]["n_words"] == len(PROSE.split()) and got["prose"]["n_lines"] == 1 and got["prose"]["punctuated_lines"] == 1.0
    assert got["list"]["bullet_lines"] == 1.0 and "bullets" in got["list"]["reasons"]
    assert quality.assess(df, words.limit(0)).count() == len(TEXTS)
    assert quality.assess(df.limit(0), words).count() == 0


def test_measure_on_empty_batch():
    assert len(quality.measure(pa.array([], pa.string()), pa.array([], pa.large_string()))["n_chars"]) == 0


PROSE_OF = {
'pl':"Wczoraj poszliśmy nad rzekę, ale dymu już nie było widać. Mój sąsiad mówi, że w tym roku prawie nie padało. Granica jest teraz inna.",
'tr':"Dün akşam nehrin kenarına gittik ama duman artık görünmüyordu. Komşum bu yıl neredeyse hiç yağmur yağmadığını söylüyor. Sınır şimdi değişti.",
'vi':"Hôm qua chúng tôi đã đi đến bờ sông và không còn thấy khói nữa. Hàng xóm của tôi nói rằng năm nay hầu như không có mưa.",
'sv':"Igår gick vi ner till ån, men röken syntes inte längre. Min granne säger att det nästan inte har regnat i år. Gränsen är ändrad nu.",
'fi':"Eilen kävimme joen rannalla, mutta savua ei enää näkynyt. Naapurini sanoo, että tänä vuonna ei ole juuri satanut. Raja on nyt muuttunut.",
'fiw':"Eilen kävimme joen rannalla, mutta savua\nei enää näkynyt. Naapurini sanoo, että tänä\nvuonna ei ole juuri satanut. Raja on nyt\nmuuttunut.",
'en':"Smoke drifted across every ridge while tired crews watched silently. Nobody expected rain before Sunday evening. Engines waited beside narrow roads.",
'cs':"Včera jsme šli k řece, ale kouř už nebyl vidět. Soused říká, že letos skoro nepršelo. Čtvrtá vrstva je prázdná.",
'el':"Χθες πήγαμε στο ποτάμι, αλλά ο καπνός δεν φαινόταν πια. Ο γείτονας λέει ότι φέτος σχεδόν δεν έβρεξε.",
'ru':"Вчера мы поднялись на холм у реки, и дыма уже не было видно. После дождя граница участка сдвинулась, и мы начали всё заново.",
'ar':"ذهبنا أمس إلى النهر ولم يعد الدخان مرئيا. يقول جاري إن المطر لم يهطل تقريبا هذا العام. تغيرت الحدود الآن.",
'hi':"कल हम नदी के किनारे गए थे, लेकिन धुआँ अब दिखाई नहीं दे रहा था। मेरे पड़ोसी का कहना है कि इस साल बारिश लगभग नहीं हुई।",
'zh':"我们检查了附近的图层，只剩下720个点。昨天我们去了那里，已经看不到烟了。下雨以后边界变了，所以我们又重新画了一遍。",
'ja':"昨日私たちは川へ行きましたが、煙はもう見えませんでした。隣人によると、今年はほとんど雨が降っていないそうです。",
'ko':"어제 우리는 강가에 갔지만 연기는 더 이상 보이지 않았다. 이웃은 올해 비가 거의 오지 않았다고 말한다. 경계가 바뀌었다.",
'he':"אתמול הלכנו לנהר אבל העשן כבר לא נראה. השכן שלי אומר שכמעט לא ירד גשם השנה. הגבול השתנה עכשיו.",
'th':"เมื่อวานเราไปที่แม่น้ำแต่ไม่เห็นควันแล้ว เพื่อนบ้านบอกว่าปีนี้ฝนแทบไม่ตกเลย",
}
JUNK = {
'salad':"the of and to in the of and a the of and to in the of and a to the of in and",
'rulist':"- старая карта\n- новый слой\n- широкая долина\n- сухой сезон\n- северный холм\n- малая граница",
'rucomma':"карта, слой, долина, сезон, старый холм, граница, новая река, участок, точка, правило, журнал",
'rurandom':"вжщкзт прстквгх йцкнгшщз фвпрлджэ ячсмтьбю щзхъфвп кнгшщ смтьбюйц лджэфвп",
'zhlist':"地图\n图层\n山谷\n旱季\n北方的山\n边界\n河流\n数据\n表格\n规则\n日志\n天气\n灰烬\n烟柱\n观测站",
'arlist':"خريطة، طبقة، واد، موسم، تل، حدود، نهر، قطعة، نقطة، قاعدة، سجل",
'entable':"name | lon | lat\nBelfen | north | south\nKarol | east | west\nUlmir | north | east",
'enlist':"wide smoke column\nnorthern watchlist\nold map sheet\nplain job log\nempty field team\nsmall alert rule\n",
'rand':"dmbdaf ;hatpecpysedpbzxpvtgms wccma cyabxxefyyse wldcvf sfhmzhfck mdrgnk ;pcjgjjcbcfctl;rl lvtg eaxvrpz mcfsk",
'rand2':"dmbdaf hatpecpyse wccma cyabxxef wldcvf sfhmzh mdrgnk pcjgjjcb lvtg eaxvrpz mcfsk. qwzxtr plkmjn vbtgyh.",
}


def test_prose_is_told_in_any_language():
    common = pa.array(["the", "of"], pa.large_string())
    for texts, want in ((PROSE_OF, False), (JUNK, True)):
        failed = quality.rules(quality.measure(pa.array(list(texts.values())), common))
        assert {k: bool(x) for k, x in zip(texts, failed["no_prose"])} == dict.fromkeys(texts, want)


@pytest.mark.parametrize("name", ["p2_checks", "p7_checks", "p8_line_statistics"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    plain = lambda df: sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in row) for row in df[sorted(df.columns)].astype(object).values.tolist()), key=str)
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
