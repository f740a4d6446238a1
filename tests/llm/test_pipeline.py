"""Each stage of the pipeline against a plain version of what it decides."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from lodegraph.llm import packing  # noqa: E402
from lodegraph.llm.common import documents, stored, stored_so_far  # noqa: E402


def test_stages(spark, small):
    docs = documents(spark, small)
    made = []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, small))
        made.append((before.collect(), docs.collect()))
        if len(made) < 5:
            assert docs.columns == before.columns
    (a, b), (_, c), (_, d), (_, e), (_, f) = made
    assert {r.doc_id for r in a if r.text and sum(x.isalpha() for x in r.text) > 200} <= {r.doc_id for r in b}
    root = brute.jaccard_components([(r.doc_id, r.text) for r in b])
    assert sorted(r.doc_id for r in c) == sorted(i for i, (_, top) in root.items() if i == top)
    texts = {r.doc_id: r.text for r in c}
    for r in d:
        found = [x.split(":") for x in brute.secrets(texts[r.doc_id])]
        assert all(texts[r.doc_id][int(s) : int(t)] not in r.text for _, s, t in found)
        assert found or "[secret]" in r.text or r.text == texts[r.doc_id]
    taken = Counter(r.doc_id for r in e)
    assert set(taken) <= set(texts) and max(taken.values()) <= 2
    pieces = Counter((r.doc_id, r.piece) for r in f)
    assert {i: n for (i, p), n in pieces.items() if p == 0} == dict(taken)
    size = defaultdict(int)
    for r in f:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= packing.CAPACITY
    assert len(size) <= 1.05 * sum(size.values()) / packing.CAPACITY + 1


def test_run_is_the_stages(spark, small):
    got, again = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, again.collect())) and got.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prepared(spark, small, rows):
    """The documents of the smallest table, which there is a language to learn from, and some rows more."""
    return documents(spark, small).select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("at", range(5))
def test_stages_take_empty_tables(spark, small, at):
    _, stage = corpus_pipeline.STAGES[at]
    docs = documents(spark, small).limit(0)
    out = stage(spark, docs, small)
    assert out.count() == 0 and (at == 4 or out.columns == docs.columns)


def test_stages_take_nulls_repeats_and_clashes(spark, small):
    """Null and repeated ids, null, empty and very long texts, null languages and sources, and columns named like an operator's own."""
    first = documents(spark, small).filter("length(text) > 500").orderBy("doc_id").first()
    t = first.text
    secret = t + " password: hunter22secret"
    rows = [(None, t, None, None, len(t)), (None, t, None, "x", len(t)), (9001, t, "zz", None, len(t)), (9001, t, "zz", None, len(t)), (9002, None, "zz", "x", 0), (9003, "", None, "x", 0),
            (9004, secret, None, "x", 0), (9005, (t + " ") * 400, None, None, None), (9006, "7 8 9", None, None, 5)]
    names = ["lang_pred", "score", "n_shingles", "component_id", "secret_spans", "taken", "size", "target", "piece", "length"]
    docs = prepared(spark, small, rows).withColumns({n: F.lit("clash") for n in names})
    kept = corpus_pipeline.language_id(spark, docs, small)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids[None] == 2 and ids[9001] == 2 and ids[9005] == 1 and not ids.keys() & {9002, 9003, 9006}
    assert {r.lang for r in kept.filter("doc_id = 9001").collect()} == {"zz"} and kept.filter("lang IS NULL").count() == 0
    near = corpus_pipeline.near_duplicates(spark, docs, small)
    ids = Counter(r.doc_id for r in near.collect())
    assert near.columns == docs.columns and ids[None] == 2 and max(n for i, n in ids.items() if i is not None) == 1
    assert {9002, 9003, 9006} <= ids.keys() and 9001 not in ids and 9004 not in ids
    clean = corpus_pipeline.secret_scan(spark, docs, small)
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.count() == docs.count() and "hunter22secret" not in got[9004].text and got[9004].n_chars == len(got[9004].text) and got[9002].text is None
    mixed = corpus_pipeline.mixture(spark, docs, small)
    ids = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert mixed.columns == docs.columns and max(n for (i, s), n in ids.items() if i not in (None, 9001)) <= 2
    out = Counter(r.doc_id for r in corpus_pipeline.packed(spark, docs, small).filter("piece = 0").collect())
    assert out == Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_run_leaves_one_table(spark, small):
    before = stored_so_far(spark)
    out = corpus_pipeline.run(spark, small)
    assert stored_so_far(spark) == before + 1 and out.count() > 0
