"""Queries that take in all rows of their tables, by brute force."""

from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import linking
from lodegraph.plans import documents, graphs, registry
from lodegraph.plans.base import source


def plain_captions(figures, captions, least=0.3):
    """{(doc_id, file): (id, similarity)} of lists of (doc_id, file, text, label) and (doc_id, id, ord, text, label)."""
    of, out = defaultdict(list), {}
    for doc, i, at, t, label in captions:
        of[doc].append((at, i, t, label))
    for doc, file, t, label in figures:
        scores = []
        for at, i, other, named in of[doc]:
            same = float(label is not None and label == named)
            alike = SequenceMatcher(None, t[:200], other[:200]).ratio() if t and other else None
            scores.append((-(same if alike is None else 0.3 * same + 0.7 * alike), at, i))
        if scores and -min(scores)[0] >= least:
            out[doc, file] = (min(scores)[2], -min(scores)[0])
    return out


def test_fuzzy_captions_of_all_places(spark, small):
    d = documents.elements(spark, small).select(
        "doc_id", "type", "id", "ord", text.normal_caption(F.col("caption")).alias("t"), text.inline_label(F.col("caption")).alias("l")).collect()
    first = sorted({r.doc_id for r in d})[:3]
    want = plain_captions([(r.doc_id, r.id, r.t, r.l) for r in d if r.type == "figure" and r.doc_id in first],
                          [(r.doc_id, r.id, r.ord, r.t, r.l) for r in d if r.type == "caption"])
    got = {(r.doc_id, r.file): (r.id, r.similarity) for r in registry.queries()["caption_fuzzy_match"](spark, small).collect() if r.doc_id in first}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_fuzzy_captions_in_blocks(spark):
    words = ["a plot of x", "a table of y", "", None, "curves of z and x", "plot of y"]
    figures = [(k % 2, f"f{k}", words[k % 6], f"Figure {k % 4}" if k % 3 else None) for k in range(24)]
    captions = [(k % 3, f"c{k}", k, words[k * 5 % 6], f"Figure {k % 5}" if k % 2 else None) for k in range(60)]
    f = spark.createDataFrame(figures, "doc_id int, file string, text string, label string")
    c = spark.createDataFrame(captions, "doc_id int, id string, ord int, text string, label string")
    for block in (1, 7, 512):
        got = {(r.doc_id, r.file): (r.id, round(r.similarity, 12)) for r in linking.fuzzy_captions(f, c, block=block).collect()}
        assert got == {k: (i, round(s, 12)) for k, (i, s) in plain_captions(figures, captions).items()} and got


def test_graph_files_hold_all_documents(spark, small, monkeypatch):
    """The round trip writes the graphs of all documents and gives them all back."""
    want = {}
    for r in documents.elements(spark, small).select(F.col("doc_id").cast("string").alias("doc_id"), "id").collect():
        want.setdefault(r.doc_id, []).append(r.id)
    written, write = [], graphs.files.write_graphs
    monkeypatch.setattr(graphs.files, "write_graphs", lambda n, e, path: (written.append(n.select("doc_id").distinct().count()), write(n, e, path)))
    out = registry.queries()["graph_file_round_trip"](spark, small).collect()
    assert {r.doc_id: (r.n_nodes, r.first, r.last) for r in out} == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    assert written == [len(want)]


def test_searches_ask_all_queries(spark):
    sf = "/root/testdata/sf0.01"
    ids = [r.id for r in source(spark, sf, "vec").select("id").collect()]
    asked = {i for i in ids if i % 50 == 0}
    top = registry.queries()["cosine_topk_global"](spark, sf).collect()
    assert {r.qid for r in top} == asked and len(top) == 20 * len(asked)
    assert {r.qid for r in registry.queries()["cosine_topk"](spark, sf).collect()} == asked
    assert {r.anchor for r in registry.queries()["hard_pool"](spark, sf).collect()} == asked
