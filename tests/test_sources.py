import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import build
from lodegraph.session import shared_folder
from lodegraph.sources import files, text


def test_graph_file(spark, tmp_path):
    g = {"a": {"doc_id": "a", "nodes": [{"id": "x", "type": "text"}, {"id": "y", "type": "figure", "page": 2}],
               "edges": [{"src": "x", "dst": "y", "type": "refer_to"}, {"src": "y", "dst": "x", "type": "caption_of", "confidence": 0.7, "bidirectional": True}]}}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    nodes, edges = files.graphs(spark, str(tmp_path / "g.json"))
    assert [(r.id, r.type, r.page, r.schema_version) for r in nodes.orderBy("ord").collect()] == [("x", "text", None, "v1"), ("y", "figure", 2, "v1")]
    assert [(r.src, r.confidence, r.bidirectional) for r in edges.orderBy("ord").collect()] == [("x", 1.0, False), ("y", 0.7, True)]
    out = str(tmp_path / "out")
    files.write_graphs(nodes, edges, out)
    n, e = files.graph_lines(spark, out)
    assert n.count() == 2 and {r.confidence for r in e.collect()} == {1.0, 0.7}


def test_element_lines(spark, tmp_path):
    lines = ['{"id": "1", "doc_id": "a", "type": "text", "text": "t"}', "{broken", "", '{"id": "2", "doc_id": "b"}', '\0{"id": "3", "doc_id": "a"}']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "e.jsonl")
    only = spark.createDataFrame([("a",)], "doc_id string")
    assert [r.id for r in files.elements(spark, path, only=only).orderBy("id").collect()][:1] == ["1"]
    assert tuple(files.malformed(spark, path).first()) == (5, 1, 1)


def test_queries(spark, tmp_path):
    rows = [("p", [("q0", "a", "f1"), ("q1", "b", None), ("q2", "c", "f2")])]
    d = spark.createDataFrame(rows, "doc_id string, qa array<struct<question:string,answer:string,reference:string>>")
    assert [(r.qid, r.gt) for r in files.figure_queries(d).orderBy("qid").collect()] == [("p_q0", ["f1"]), ("p_q2", ["f2"])]
    lines = [{"qid": "1", "doc_id": "a", "gt_element_ids": ["x", "y"], "evidence_pages": 3}, {"qid": "2", "doc_id": "b", "gt_element_ids": "z", "gt_pages": [1, 2]}, {"qid": "3"}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r.qid: (r.gt, r.gt_pages) for r in files.grounded_queries(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got == {"1": (["x", "y"], [3]), "2": (["z"], [1, 2]), "3": ([], None)}


def test_results_tokens_and_layout(spark, tmp_path):
    d = spark.createDataFrame([("h", {"ds": {"v": {"mrr": 0.5, "n_queries": 3.0}}})], "row_id string, results map<string,map<string,map<string,double>>>")
    long = files.long_results(d)
    assert [tuple(r) for r in long.collect()] == [("h", "ds", "v", "mrr", 0.5)]
    files.write_results(long, str(tmp_path / "csv"))
    assert files.results(spark, str(tmp_path / "csv")).first().value == 0.5
    t = spark.createDataFrame([("a", "x", 0, [1.0], True), ("b", "y", 0, [2.0], True)], "doc_id string, id string, tok_ord int, vec array<float>, valid boolean")
    files.write_tokens(t, str(tmp_path / "tok"))
    assert files.tokens(spark, str(tmp_path / "tok")).filter("doc_id = 'b'").first().vec == [2.0]
    lay = spark.createDataFrame([("a", bytearray(b"hi")), ("b", bytearray(b"no"))], "doc_name string, image_binary binary")
    lay.write.parquet(str(tmp_path / "lay"))
    got = files.layout(spark, str(tmp_path / "lay"), spark.createDataFrame([("a",)], "doc_name string")).collect()
    assert [(r.doc_name, r.image_b64) for r in got] == [("a", "aGk=")]


def test_text_elements(spark):
    d = spark.createDataFrame([(1, "a\n\n \n\n b \n\nc")], "k int, text string")
    assert [(r.place, r.text) for r in text.paragraphs(d, "k").orderBy("place").collect()] == [(0, "a"), (2, "b"), (3, "c")]
    h = spark.createDataFrame([(1, "<h1>T</h1><p>x<b>y<p>z<li>w")], "k int, html string")
    assert [(r.type, r.text) for r in text.html_elements(h, "k").orderBy("place").collect()] == [("section_header", "T"), ("text", "x"), ("text", "z"), ("text", "w")]
    pages = spark.createDataFrame([("a", 1, [("", "o", "v"), ("t", "o", "v"), ("", "", "v")])], "doc_id string, page int, elements array<struct<text:string,ocr_text:string,vlm_text:string>>")
    assert [r.text for r in files.page_elements(pages).orderBy("place").collect()] == ["o", "t", "v"]


@pytest.fixture(scope="module")
def built(spark):
    rows = [("a", "t0", "text", "Opening words that lead in", 0, 0), ("a", "h1", "text", "1 Introduction", 0, 1), ("a", "t1", "text", "As Figure 1 shows, things are so", 0, 2),
            ("a", "f1", "image", "", 0, 3), ("a", "c1", "caption", "Figure 1: a thing", 0, 4), ("a", "h2", "section_header", "2 Method", 1, 5),
            ("a", "t2", "text", "In [3] Figure 1 is of another paper", 1, 6), ("a", "t3", "text", "More on Table 9 here", 1, 7)]
    d = spark.createDataFrame(rows, "doc_id string, id string, type string, text string, page int, ord int")
    return build.build_graph(d, least_section=1)


def test_build_graph(built):
    nodes, edges = built
    kinds = {r.id: (r.type, r.section_role) for r in nodes.collect()}
    assert kinds["a__sec001"] == ("section_header", "intro") and kinds["a__sec002"] == ("section_header", "method") and kinds["a__sec000"][0] == "section_header"
    assert kinds["f1"][0] == "figure" and kinds["h1"] == ("text", "intro")
    e = {(r.src, r.dst, r.type) for r in edges.collect()}
    assert ("c1", "f1", "caption_of") in e and ("t1", "f1", "refer_to") in e and ("t2", "f1", "refer_to") not in e
    assert ("a__sec000", "a__sec001", "section_next") in e and ("a__sec002", "t3", "contains") in e and ("h1", "t1", "reading_next") in e


def test_retrieve(spark, built):
    nodes, edges = built
    tok = lambda x: [[float(x), 1.0]]
    elements = nodes.select("doc_id", "id", "ord").withColumn("tokens", F.array(F.array(F.col("ord") / 10.0, F.lit(1.0))))
    queries = spark.createDataFrame([(1, "a", tok(1))], "qid int, doc_id string, tokens array<array<double>>")
    for method in ("none", "ppr"):
        got = build.retrieve_top_k(queries, elements, nodes, edges, 3, method).collect()
        assert sorted(r["rank"] for r in got) == [1, 2, 3] and not any("sec" in r["id"] for r in got)


def test_shared_folder_is_told_off_local_masters():
    def session(master, told):
        at = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: at[0] if at else None, setCheckpointDir=at.append)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: told))

    assert shared_folder(session("local[4]", None))
    assert shared_folder(session("spark://host:7077", "/shared")) == "/shared"
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master, None))
