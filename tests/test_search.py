"""Search over whole corpora, distances, numbered sections, pools and samples, against plain versions."""

import math
import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import graph, lexical, linking, metrics, ranking, sections, stats


def okapi(docs, question, own):
    words = {i: [w for w in map(str.lower, (t or "").replace(",", " ").split())] for i, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    least = 0.25 * sum(raw.values()) / len(raw)
    score = {}
    for i, ws in words.items():
        tf, s = Counter(ws), 0.0
        for w in question:
            s += (raw[w] if raw.get(w, 0) >= 0 else least) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) if w in tf else 0
        if i != own and set(question) & set(ws):
            score[i] = round(s, 6)
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("shard", [7, 65_536])
def test_bm25(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, ", ".join(["every"] + r.choices(words, weights=range(1, 41), k=r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, " ,"), (63, "W39")]
    df = spark.createDataFrame([*docs, (None, "w1")], "id long, text string").repartition(3)
    index = lexical.build_index(df, f"{tmp_path}/index")
    asked = {3: ["w39", "every", "w1", "nowhere"], 4: ["w38", "w38", "w5"], 99: ["w0"]}
    rows = [(q, w, n) for q, ws in asked.items() for w, n in Counter(ws).items()]
    found = lexical.search(lexical.open_index(spark, f"{tmp_path}/index"), spark.createDataFrame(rows, "qid long, term string, tf long"), k=9).collect()
    for q, ws in asked.items():
        got = sorted(((x.rank, x.id, x.score) for x in found if x.qid == q))
        want = okapi(docs, ws, q)[:9]
        assert [(i, s) for _, i, s in got] == [(i, pytest.approx(s, abs=2e-6)) for i, s in want] and [x[0] for x in got] == list(range(1, len(want) + 1))
    lists = index.postings.groupBy("term").agg(F.max(F.size("list")).alias("longest"), F.count("*").alias("n"))
    longest = {x.term: (x.longest, x.n) for x in lists.collect()}
    assert longest["every"] == ((7, 9) if shard == 7 else (60, 1))
    told = lexical.telling_terms(index, spark.createDataFrame([(1, "w39 w0, w0"), (2, None)], "qid long, text string"), most=1).collect()
    assert [(x.qid, x.term, x.tf) for x in told] == [(1, "w0", 2)] or not any("w0" in (t or "") for _, t in docs)


def test_an_empty_index(spark, tmp_path):
    index = lexical.build_index(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/index")
    assert index.lexicon.count() == 0 and lexical.search(index, spark.createDataFrame([(1, "a", 1)], "qid long, term string, tf long")).count() == 0


def test_places_by_counting(spark, monkeypatch):
    """Blocks and slices of a few rows, many ties, and elements that are questions too."""
    monkeypatch.setattr(ranking, "BLOCK", 3)
    monkeypatch.setattr(ranking, "SLICE", 40)
    r = random.Random(2)
    items = [(i, [float(r.randint(-2, 2)) for _ in range(3)], r.choice("abc")) for i in range(200)]
    questions = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in [*range(0, 200, 25), 500]]
    wanted = [(q, i, float(np.dot(v, items[i][1])), items[i][2]) for q, v in questions for i in r.sample(range(200), 9) if i != q]
    out = ranking.counted_ranks(spark.createDataFrame(wanted, "qid long, id long, score double, kind string"),
                                spark.createDataFrame(questions, "qid long, q array<float>"),
                                spark.createDataFrame(items, "id long, v array<float>, kind string").repartition(4)).collect()
    assert len(out) == len(wanted)
    of = dict(questions)
    for x in out:
        order = sorted((i for i, _, _ in items if i != x.qid), key=lambda i: (-np.dot(of[x.qid], items[i][1]), i))
        assert x["rank"] == order.index(x.id) + 1
        assert x.kind_rank == [i for i in order if items[i][2] == x.kind].index(x.id) + 1


def test_hop_distances(spark):
    r = random.Random(3)
    kinds = ("figure", "table", "section_header", "caption")
    nodes = [(d, f"n{i}", r.choice([*kinds, "text", "text", "text", None])) for d in range(4) for i in range(40)]
    nodes += [(9, f"n{i}", "figure" if i == 0 else "text") for i in range(40)]
    edges = [(d, f"n{r.randrange(40)}", f"n{r.randrange(44)}") for d in range(4) for _ in range(38)] + [(9, f"n{i}", f"n{i + 1}") for i in range(39)] + [(9, "n3", "n3")]
    out = graph.hop_distances(spark.createDataFrame(nodes, "doc_id long, id string, type string"), spark.createDataFrame(edges, "doc_id long, src string, dst string"))
    got = {(x.doc_id, x.id): tuple(x[k] for k in kinds) for x in out.collect()}
    have, near = {(d, i) for d, i, _ in nodes}, {}
    for d, a, b in edges:
        if (d, a) in have and (d, b) in have:
            near.setdefault((d, a), []).append((d, b))
            near.setdefault((d, b), []).append((d, a))
    want = {n: [None] * 4 for n in have}
    for at, k in enumerate(kinds):
        todo = deque([((d, i), 0) for d, i, t in nodes if t == k])
        while todo:
            n, far = todo.popleft()
            if want[n][at] is None:
                want[n][at] = far
                todo += [(m, far + 1) for m in near.get(n, [])]
    assert got == {n: tuple(x) for n, x in want.items()} and got[(9, "n39")] == (39, None, None, None)


def test_numbered_paths(spark):
    r = random.Random(4)
    lines = ["2 Some Title", "3.1 Other Parts", "3.1.2 Deep One", "Conclusion", "related work:", "text", "text", "7 nothing", "Results", "4 Ab"]
    rows = [(d, i, r.choice(lines)) for d in range(30) for i in range(25)]
    d = spark.createDataFrame(rows, "doc_id long, ord long, t string")
    out = sections.numbered_paths(d, text.numeric_header(F.col("t")), text.keyword_header(F.col("t"))).collect()
    got = {(x.doc_id, x.ord): list(x.path) for x in out}
    numbers = {"2 Some Title": [2], "3.1 Other Parts": [3, 1], "3.1.2 Deep One": [3, 1, 2]}
    for doc in range(30):
        now, place = [], 0
        for _, i, t in [x for x in rows if x[0] == doc]:
            if t in numbers or t in ("Conclusion", "related work:", "Results"):
                now, place = numbers[t] if t in numbers else [(now or [0])[0] + 1], 0
                assert got[(doc, i)] == now
            else:
                place += 1
                assert got[(doc, i)] == [*now, place]


def test_training_pool(spark):
    nodes = [(d, d * 100 + i, "section_header" if i % 5 == 0 else "text") for d in range(6) for i in range(20)] + [(7, 700, "section_header")]
    anchors = [(0, 1, 2), (1, 101, 105), (2, 201, None), (7, 700, None)]
    near = [(1, i) for i in range(3, 12)] + [(1, 1), (101, 102), (101, 100)]
    make = lambda n: linking.training_pool(spark.createDataFrame(anchors, "doc_id long, anchor long, target long"),
                                           spark.createDataFrame(n, "doc_id long, id long, type string"), spark.createDataFrame(near, "anchor long, id long"))
    got = {}
    for x in make(nodes).collect():
        got.setdefault(x.anchor, []).append((x.place, x.kind, x.id))
    header = {i for _, i, t in nodes if t == "section_header"}
    of = {i: d for d, i, _ in nodes}
    for anchor, pool in got.items():
        pool.sort()
        assert [p for p, _, _ in pool] == list(range(1, len(pool) + 1)) and not {i for _, _, i in pool} & {anchor, *header}
        assert all((of[i] == of[anchor]) == (k != "cross") for _, k, i in pool) and sum(k == "cross" for _, k, _ in pool) == 4
    kinds = {a: Counter(k for _, k, _ in p) for a, p in got.items()}
    assert kinds == {1: {"positive": 4, "same": 4, "cross": 4}, 101: {"positive": 1, "same": 7, "cross": 4}, 201: {"same": 8, "cross": 4}, 700: {"cross": 4}}
    assert got[1][0][2] == 2 and not {i for _, k, i in got[1] if k == "same"} & set(range(1, 12))
    alone = [x.kind for x in make([n for n in nodes if n[0] == 0]).filter("anchor = 1").collect()]
    assert Counter(alone) == {"positive": 4, "same": 16 - 11 + 1} or "cross" not in alone
    assert sorted(make(nodes).collect()) == sorted(make(nodes[::-1]).collect())


def test_average_precision_and_samples(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 11)] + [(2, 5, 1)], "qid long, id long, rank int")
    gt = spark.createDataFrame([(1, [1, 3, 3, 99]), (2, []), (3, [5])], "qid long, gt array<bigint>")
    got = {x.qid: (x.n_gt, round(x.ap, 6)) for x in metrics.average_precision(ranked, gt).collect()}
    assert got == {1: (3, round((1 + 2 / 3) / 3, 6)), 2: (0, 0.0), 3: (1, 0.0)}
    d = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert stats.sample(d, 17, 5, "id").count() == 17 and stats.sample(d.limit(4), 17, 5, "id").count() == 4
    assert sorted(stats.sample(d, 17, 5, "id").collect()) == sorted(stats.sample(d.repartition(7), 17, 5, "id").collect())
    each = stats.sample_each(d, ["g"], 11, 5, "id").groupBy("g").agg(F.count("*").alias("n"), F.max("place").alias("m")).collect()
    assert {(x.n, x.m) for x in each} == {(11, 11)}


def test_search_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    """Questions that every document answers: of each shard only the best go on, and the results are those of all pairs."""
    monkeypatch.setattr(lexical, "QUESTIONS", 3)
    docs = [(i * 40_000, "common " * (1 + i % 5) + f"w{i % 7} w{i % 3}") for i in range(60)]
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "index"))
    asked = spark.createDataFrame([(q, t, 1) for q in range(0, 400_000, 40_000) for t in ("common", f"w{q // 40_000 % 7}")], "qid long, term string, tf long")
    told = []
    best = lexical.best_of_shards

    def counted(k, own):
        inner = best(k, own)
        told.append(list(inner.__code__.co_freevars))
        return inner

    monkeypatch.setattr(lexical, "best_of_shards", counted)
    got = {(r.qid, r.rank): (r.id, r.score) for r in lexical.search(index, asked, k=4).collect()}
    idf, mean = {r.term: r.idf for r in index.lexicon.collect()}, index.totals.first().mean_size
    want = {}
    for q in range(0, 400_000, 40_000):
        rows = []
        for i, words in docs:
            terms, total = words.split(), 0.0
            for t in {"common", f"w{q // 40_000 % 7}"}:
                tf = terms.count(t)
                total += idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms) / mean))
            if i != q:
                rows.append((-round(total, 6), i))
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(rows)[:4])}
    assert got == want and told


def test_terms_are_counted_where_their_document_is(spark, tmp_path, monkeypatch):
    """Nothing is shuffled to count a document's terms, and blocks of any size make the same lists."""
    odd = ["a_b C-c c", "İstanbul ΟΔΟΣ Kelvin", "\x0btab\x1cx\x0b\x0cx", "end", "end", "", None, "ß　ẞ, 日本。日本", "'--'", "\x7fdel~del", "end next"]
    docs = spark.createDataFrame([(i * 50_000 - 90_000, t) for i, t in enumerate(odd)] + [(None, "lost")], "id long, text string").repartition(3)
    words = docs.filter("id IS NOT NULL").select("id", F.regexp_extract_all(F.lower("text"), F.lit(lexical.TERM), F.lit(0)).alias("w")).collect()
    want = sorted((r.id, w, n, len(r.w)) for r in words for w, n in Counter(r.w or []).items())
    found = lexical.counted(docs)
    assert sorted(map(tuple, found.collect())) == want
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    lists = []
    for size in (1, 30, 1 << 20):
        monkeypatch.setattr(lexical, "LISTED", size)
        index = lexical.build_index(docs, f"{tmp_path}/{size}")
        lists.append(sorted((r.term, r.shard, [tuple(x) for x in r.list], r.df, r.cf) for r in index.postings.collect()))
    assert lists[0] == lists[1] == lists[2]
    assert sorted((i, t, n, z) for t, _, x, _, _ in lists[0] for i, n, z in x) == want
    assert all(x == sorted(x) and {i // lexical.SHARD for i, _, _ in x} == {s} and (d, c) == (len(x), sum(n for _, n, _ in x)) for _, s, x, d, c in lists[0])
