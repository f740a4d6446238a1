"""The operators that work in Python too, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import arrays, common, embeddings, jaccard, langid, packing, substrings
from lodegraph.llm.common import components, salted_rank

SCHEMA = "doc_id long, text string"


def made(seed=3, n=60):
    """Documents with shared passages, near copies, copies, repeats and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choices(vocabulary, k=k) for k in (13, 14, 30, 60)]
    docs = []
    for i in range(n):
        w = r.choices(vocabulary, k=r.randint(1, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, len(p) - 5)
            w[(at := r.randint(0, len(w))) : at] = p[a : a + r.randint(5, 60)]
        if docs and r.random() < 0.4:
            w = (r.choice(docs)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "spam " * 900),
             (n + 6, "spam " * 901 + "x"), (n + 7, "a b c d e"), (n + 8, "é\x85 b\xa0c d e f")]
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="module", params=[3, 4])
def docs(request):
    return made(request.param)


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, SCHEMA).repartition(parts).withColumns(
        {"n_words": F.lit("clash"), "length": F.lit("clash"), "extra": F.lit(1)})


def test_words_and_kept_words():
    for text in ("", " ", "a", " a  b\n", "é \x0b\x0cz\x85y", "x " * 5):
        data, w = text.encode(), brute.words(text)
        assert len(arrays.word_hashes(data)) == len(w)
        for gone in (np.zeros(len(w), bool), np.ones(len(w), bool), np.arange(len(w)) % 2 == 0):
            assert arrays.keep_words(data, gone) == " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000)).encode()
    whole = arrays.word_hashes(text)
    monkeypatch.setattr(arrays, "BLOCK", 50)
    assert (arrays.word_hashes(text) == whole).all()


def test_substrings(spark, docs):
    out = substrings.dedup_substrings(frame(spark, docs)).collect()
    want = brute.repeats(docs)
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.n_removed, brute.sha(r.kept_text)) == want[r.doc_id]
        assert sum(s.end - s.start for s in r.repeats) == r.n_removed and all(s.end - s.start >= 13 for s in r.repeats)


def test_substrings_many_windows_of_one_anchor(spark):
    """Over 60,000 distinct windows around one phrase, the anchor of all of them, and few that repeat."""
    r = random.Random(7)
    phrase = min((" ".join(r.choices("abcdefgh", k=5)) for _ in range(5000)),
                 key=lambda p: arrays.windows(arrays.word_hashes(p.encode()), 5)[0])
    docs = [(i, f"{' '.join(f'u{r.randrange(10**9)}' for _ in range(8))} {phrase} {' '.join(f'v{r.randrange(10**9)}' for _ in range(8))}")
            for i in range(7000)]
    docs += [(10_000 + i, f"x{i} " + " ".join(docs[7 * i][1].split()[k : k + 15]) + f" y{i}") for i, k in enumerate([0, 3, 6, 2] * 20)]
    got = {x.doc_id: (x.n_words, x.n_removed, brute.sha(x.kept_text)) for x in substrings.dedup_substrings(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute.repeats(docs) and sum(n > 0 for _, n, _ in got.values()) == 80


def test_substring_streams_in_any_batches(spark, monkeypatch):
    """Seeds and windows that go on from batch to batch."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"z{r.randrange(5)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(substrings, "CHUNK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = substrings.dedup_substrings(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.doc_id: (x.n_words, x.n_removed, brute.sha(x.kept_text)) for x in out} == brute.repeats(docs)


def test_substrings_long_text(spark, monkeypatch):
    long = " ".join(f"n{i % 9000}" for i in range(300_000))
    docs = [(1, "start " + long), (2, long), (3, " ".join(f"n{i}" for i in range(100, 120)))]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.dedup_substrings(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: (300_001, 0), 2: (300_000, 300_000), 3: (20, 20)}


def test_substrings_odd_ids(spark):
    t = " ".join(map(str, range(20)))
    out = substrings.dedup_substrings(spark.createDataFrame([(None, t), (5, t), (5, t), (9, t + " end")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("5", 0), ("5", 0), ("9", 20), ("None", 0)]
    assert substrings.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substrings_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = substrings.op3_substring_dedup(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(substrings.ORACLE).fetchall())


def test_jaccard(spark, docs):
    out = jaccard.jaccard_groups(frame(spark, docs)).collect()
    want = brute.jaccard_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(docs)


def test_jaccard_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 25)
    out = jaccard.jaccard_groups(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute.jaccard_components(docs)


def test_jaccard_templated_pages(spark, monkeypatch):
    """Pages of passages out of a pool, of which no two link: hardly any are candidates, and none are with long lists."""
    r = random.Random(8)
    pool = [" ".join(f"p{k}w{r.randrange(10**6)}" for _ in range(50)) for k in range(150)]
    docs = [(i, "\n".join(r.sample(pool, 10))) for i in range(600)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(0, 40, 4)]
    seen, told = [], jaccard.candidates_of

    def watched(*args):
        seen.append(components(told(*args)).groupBy("root").count().agg(F.max("count"), F.sum("count")).first())
        return told(*args)

    monkeypatch.setattr(jaccard, "candidates_of", watched)
    want = brute.jaccard_components(docs)
    for most in (64, 4):
        monkeypatch.setattr(jaccard, "LIST", most)
        out = jaccard.jaccard_groups(spark.createDataFrame(docs, SCHEMA)).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == want
    assert sum(i != c for i, (_, c) in want.items()) == 10
    print("largest candidate group, classes in groups:", [tuple(x) for x in seen])
    assert seen[0][0] <= 60


def test_jaccard_frequent_tokens_across_batches(monkeypatch):
    import pyarrow as pa

    rows = [(1, 1), (1, 1), (1, 2), (2, 5), (3, 1), (3, 2), (3, 3), (3, 4), (3, 4), (3, 6), (4, 1)]
    for many, df in ((1 << 20, 5), (3, 3)):
        monkeypatch.setattr(jaccard, "MANY", many)
        for size in (1, 2, 3, 20):
            batches = [pa.RecordBatch.from_pylist([{"token": t, "c1": c} for t, c in rows[i : i + size]],
                       schema=pa.schema([("token", pa.int64()), ("c1", pa.int64())])) for i in range(0, len(rows), size)]
            got = {(x["token"], x["c1"]): x["df"] for b in jaccard.shared(iter(batches)) for x in b.to_pylist()}
            assert {k for k in got} == {(1, 1), (1, 2), *((3, c) for c in (1, 2, 3, 4, 6))}
            assert got[1, 1] == 2 and (size == 20 or got[3, 1] == df)


def test_jaccard_odd_rows(spark):
    t = "a b c d e f g h"
    out = jaccard.jaccard_groups(spark.createDataFrame([(None, t), (3, t), (3, t), (7, t.upper()), (8, None)], SCHEMA)).collect()
    assert {str(r.doc_id): r.component_id for r in out} == {"3": 3, "7": 3, "8": 8, "None": None}
    assert jaccard.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = jaccard.dedup_near(spark.createDataFrame([(1, t), (2, t), (3, "z")], SCHEMA))
    assert kept.columns == ["doc_id", "text"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)]
    got = {x.id: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs for x in p if p[0] != p[1]}
    want = brute.roots({x for p in pairs for x in p}, pairs)
    assert got == {i: want[i] for i in ids}


def test_salted_rank(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    got = defaultdict(list)
    for x in salted_rank(df, ["g"], ["id"], F.pmod("id", F.lit(7)), "r").collect():
        got[x.g].append(x.r)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def plain_language(docs, size=300):
    """{doc_id: (language, score)} by counting n-grams as strings, learned from rows that are not held out."""
    def grams(text):
        out = []
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = f" {w} "
            out += [w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
        return Counter(g for g in out if g.strip())

    def top(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], langid.packed(x[0])))][:size]

    sums = defaultdict(Counter)
    for i, text, lang in docs:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            sums[lang].update(grams(text))
    ranks = {lang: {g: r for r, g in enumerate(top(c))} for lang, c in sums.items() if c}
    out = {}
    for i, text, _ in docs:
        own = top(grams(text or ""))
        far = {lang: sum(abs(r[g] - k) if g in r else size for k, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(far, key=lambda x: (far[x], x)) if own and far else None
        out[i] = (best, 1 - far[best] / (size * len(own))) if best is not None else ("und", 0.0)
    return out


def test_language_id_against_plain_profiles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in rows] + [(10**6, "ΑΣ Ελληνικά κείμενα ΑΣ", "el"), (10**6 + 1, "漢字 仮名 漢字", "ja"), (10**6 + 3, "\U0001d400\U0001d401 x", "mx"),
                                       (10**6 + 4, "İstanbul ß", None), (10**6 + 5, None, "en"), (10**6 + 6, "12 !", "en"), (10**6 + 7, "a", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.learned(df)).collect()}
    want = plain_language(rows)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_language_id_odd_texts(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "the and of " * 200_000), (6, "\U0001f600"), (7, "the"), (7, "the")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    profiles = {"en": langid.top_grams(*langid.gram_counts("the and of"), 300).tolist(), "xx": [1, 2, 3]}
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, profiles).collect()}
    assert [got[i] for i in (1, 2, 3, 6)] == ["und"] * 4 and got[5] == got[7] == "en"
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), profiles).count() == 0
    text = "ab cd éxyz zz" * 300
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(langid.gram_counts(text), whole, strict=True))


def test_language_profiles_come_in_parts(spark, monkeypatch):
    docs = [(i, f"abc{chr(97 + i % 26)} xyz " * 5, "l1" if i % 2 else "l2") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)
    whole = langid.fit_profiles(df)
    monkeypatch.setattr(langid, "HELD", 10)
    assert langid.fit_profiles(df) == whole and set(whole) == {"l1", "l2"}


def test_packing(spark, docs):
    parts = packing.pack_documents(frame(spark, docs), capacity=64, keep_ids=True).collect()
    of, ids = defaultdict(list), defaultdict(list)
    for p in parts:
        of[p.sequence_id].append(p)
        ids[p.doc_id].append(p)
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    for s in of.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:i]) for i in range(len(s))]
        assert sum(p.length for p in s) <= 64
    t = packing._tokenizer(packing.TOKENIZER)
    for i, text in docs:
        own = sorted(ids[i], key=lambda p: p.piece)
        assert [x for p in own for x in p.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert [p.start for p in own] == [64 * k for k in range(len(own))] and all(p.length == 64 for p in own[:-1])
    assert len(of) <= -(-sum(p.length for p in parts) // 64) + 2
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["It's 3.5, isn't it? A...b !!, x. y, z", "ÀÉ ß ẞ İstanbul ΑΣ. x", "<|endoftext|> a", "x.", "...", "é a.  b. "])
def test_token_ids_of_words(text):
    want = packing._tokenizer(packing.TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.token_ids(text, packing.TOKENIZER), "<u4").tolist() == want


def test_bin_plan():
    r = random.Random(2)
    for _ in range(20):
        h = {r.randint(1, 100): r.randint(1, 40) for _ in range(r.randint(1, 30))}
        plan = packing.bin_plan(h, 100)
        used = defaultdict(int)
        for lengths, times in plan:
            assert sum(lengths) <= 100 and times > 0
            for n in lengths:
                used[n] += times
        assert used == h
    assert packing.fullest(10, {7: 1, 6: 1, 4: 1}, [7, 6, 4]) == {6: 1, 4: 1}


def vectors(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, dim))
    v = centres[rng.integers(0, len(centres), n)] + 0.12 * rng.standard_normal((n, dim))
    return [(i, x.astype(float).tolist(), int(i % 2)) for i, x in enumerate(v)]


def plain_links(rows, least=0.93):
    deg, pairs = defaultdict(int), []
    good = [(i, np.array(v), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                pairs.append((i, j))
                deg[i] += 1
                deg[j] += 1
    return deg, pairs, brute.roots([r[0] for r in rows], pairs)


@pytest.mark.parametrize("block", [512, 5])
def test_embeddings(spark, block):
    rows = vectors() + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1),
                        (1004, [], 1), (1005, [1.0] * 16, None), (1006, [float("inf")] + [0.0] * 15, 1), (1007, [1.0, 1.0], 1)]
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    out = {r.vec_id: r for r in embeddings.link_vectors(df, tables=40, block=block).collect()}
    deg, pairs, root = plain_links(rows)
    assert len(out) == len(rows)
    found = sum(r.n_links for r in out.values()) / 2
    assert 0.97 * len(pairs) <= found <= len(pairs)
    assert all(out[i].n_links <= deg[i] for i in root)
    assert sum(out[i].component_id == root[i] for i in root) >= 0.95 * len(root)
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in range(1000, 1008))
    assert all(out[2000 + i].component_id == out[3].component_id and out[2000 + i].n_links >= 4 for i in range(4))


def test_embeddings_empty(spark):
    assert embeddings.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_embedding_recall(spark, sf):
    """Links of the operator against all pairs of each label: a whole table, and a copy of each vector turned away from it
    so far that their cosine is between 0.93 and 1, most of them close to the bound."""
    rng, rows = np.random.default_rng(5), []
    for i, v, label in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect():
        x = np.array([np.nan if c is None else c for c in v or [np.nan]], float)
        rows.append((i, v, label))
        if np.isfinite(x).all() and x.any():
            x /= np.linalg.norm(x)
            y = rng.standard_normal(len(x))
            y -= (y @ x) * x
            c = 0.9301 + 0.07 * rng.random() ** 3
            rows.append((10**9 + i, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), label))
    by = defaultdict(list)
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v or [np.nan]], float)
        if label is not None and np.isfinite(x).all() and x.any():
            by[label, len(x)].append(x / np.linalg.norm(x))
    pairs = sum(int((np.triu(np.array(m) @ np.array(m).T, 1) >= 0.93).sum()) for m in by.values())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embeddings.link_vectors(df).agg(F.sum("n_links")).first()[0] / 2
    print(f"recall of op6 on {sf}: {found:.0f} of {pairs}")
    assert pairs >= 400 and 0.9 * pairs <= found <= pairs


def test_embeddings_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(4, a, 1), (4, a, 1), (None, a, 1), (7, b, 1), (8, a, 2)]
    out = embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out)
    assert got == [("4", 2, 4, True), ("4", 2, 4, True), ("7", 0, 7, True), ("8", 0, 8, True), ("None", 2, None, False)]


@pytest.mark.parametrize(("query", "sql"), [(jaccard.op10_jaccard_join, jaccard.ORACLE), (embeddings.op6_embedding_dedup, embeddings.ORACLE)])
def test_groups_sql(spark, query, sql):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    assert sorted(map(tuple, query(spark, sf).select(*[c[0] for c in cur.description]).collect())) == sorted(cur.fetchall())


def test_dedup_near_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(3, a), (5, a + " end"), (5, b), (5, b), (6, c), (6, c + " end"), (7, None), (None, c), (None, c), (9, "z")]
    out = jaccard.dedup_near(spark.createDataFrame(docs, SCHEMA).repartition(3))
    got = [tuple(r) for r in out.collect()]
    six = [t for i, t in got if i == 6]
    assert len(six) == 1 and six[0] in (c, c + " end")
    assert sorted((r for r in got if r[0] != 6), key=repr) == sorted([(3, a), (5, b), (7, None), (None, c), (None, c), (9, "z")], key=repr)


def fullest_by_trial(left, counts):
    """The greatest sum of pieces that ``left`` can hold, of all combinations."""
    best = {0}
    for n, c in counts.items():
        best = {b + k * n for b in best for k in range(c + 1) if b + k * n <= left}
    return max(best)


def fewest_bins(pieces, capacity):
    """The least number of bins, by trying every place of every piece."""
    best = len(pieces)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(pieces):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= pieces[i] and room[k] not in room[:k]:
                put(i + 1, [*room[:k], room[k] - pieces[i], *room[k + 1 :]])
        put(i + 1, [*room, capacity - pieces[i]])

    put(0, [])
    return best


def test_every_planned_bin_is_the_fullest():
    """Each bin, in turn, holds the longest piece that is left and the fullest combination for the rest."""
    r = random.Random(11)
    for _ in range(60):
        capacity = r.choice([10, 17, 40])
        left = Counter(r.randint(1, capacity) for _ in range(r.randint(1, 25)))
        for lengths, times in packing.bin_plan(dict(left), capacity):
            for _ in range(times):
                longest = max(left)
                rest = left - Counter([longest])
                assert lengths[0] == longest and sum(lengths) == longest + fullest_by_trial(capacity - longest, rest)
                assert not Counter(lengths) - left
                left -= Counter(lengths)
        assert not left


def test_planned_bins_against_the_fewest():
    r = random.Random(12)
    more = 0
    for _ in range(60):
        pieces = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        planned, fewest = sum(t for _, t in packing.bin_plan(dict(Counter(pieces)), 20)), fewest_bins(pieces, 20)
        assert fewest <= planned <= fewest + 1
        more += planned - fewest
    assert more <= 3


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "one two three"), (None, "one two three"), (4, "one two three"), (4, "one two three"), (4, None), (5, ""), (6, "four " * 90)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), capacity=16).collect()
    pieces = Counter(r.doc_id for r in out if r.piece == 0)
    assert pieces == {None: 2, 4: 3, 5: 1, 6: 1}
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 16


@pytest.mark.parametrize("size", [1000, 300_000])
def test_recall_of_parameters_chosen_by_size(spark, size):
    """Each vector has a partner at a cosine of 0.93 or a little more, the hardest pairs there are."""
    projections, tables = embeddings.chosen(size)
    assert size * tables * embeddings.one_cell(0.0) ** projections <= embeddings.STRANGERS
    r = np.random.default_rng(size)
    v = r.standard_normal((500, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = r.standard_normal(v.shape)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = r.uniform(0.931, 0.945, (500, 1))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([v, c * v + np.sqrt(1 - c * c) * w]))]
    out = embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), projections=projections, tables=tables)
    found = out.agg(F.sum("n_links")).first()[0] / 2
    assert 0.9 * 500 <= found <= 500
    assert embeddings.chosen(10 * size)[0] > embeddings.chosen(size)[0] or size == 1000


def test_anti_join(spark, monkeypatch):
    """With a table of bits that is far too small, and one that is large enough."""
    df = spark.range(500).select(F.when(F.col("id") % 50 != 3, F.col("id")).alias("k"), F.col("id").alias("x"), F.lit("clash").alias("aj_word"))
    gone = spark.range(0, 500, 7).select(F.col("id").alias("k"))
    want = {x for x in range(500) if x % 50 == 3 or x % 7}
    for bits in (64, 1 << 10, common.SIEVE):
        monkeypatch.setattr(common, "SIEVE", bits)
        out = common.anti_join(df, gone, "k")
        rows = out.collect()
        assert out.columns == df.columns and sorted(r.x for r in rows) == sorted(want) and {r.aj_word for r in rows} == {"clash"}
        assert common.anti_join(df, gone.limit(0), "k").count() == 500


def test_words_that_lower_to_marks_keep_what_stands_behind_them():
    """İ lowers to i and a mark, which the vocabulary takes together with marks behind it; Latin letters skip the steps around its model."""
    tokenizer = packing._tokenizer(packing.TOKENIZER)
    words = ["ŉİ,", "abİ.", "cİ'İ'", *(f"a{chr(c)}b," for c in range(0xA1, 0x250)), "αβγ,", "Ünïcode", "漢字"]
    for text in (*words, " ".join(words), " ".join(words).replace("İ", "")):
        packing._known.clear()
        whole = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.token_ids(text, packing.TOKENIZER) == whole, text
