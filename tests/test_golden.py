"""Small examples worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import boxes, text, vectors
from lodegraph.operators import graph, linking, losses, metrics, ranking, sections, stats
from lodegraph.schema import ELEMENT_TYPES, SECTION_ROLES

NODES = [("d", "q", "text", "method"), ("d", "f", "figure", "method"), ("d", "c", "caption", "method")]
EDGES = [("d", "q", "f", "refer_to", 1.0, False), ("d", "f", "c", "caption_of", 1.0, True)]
SCORES = [(1, "d", "q", 1.0, 0), (1, "d", "f", 0.5, 1), (1, "d", "c", 0.3, 2)]


@pytest.fixture(scope="module")
def three(spark):
    nodes = spark.createDataFrame(NODES, "doc_id string, id string, type string, section_role string")
    edges = spark.createDataFrame(EDGES, "doc_id string, src string, dst string, type string, confidence double, bidirectional boolean")
    scores = spark.createDataFrame(SCORES, "qid int, doc_id string, id string, score double, ord int")
    return nodes, edges, scores


def told(d, value="refined"):
    return {r["id"]: r[value] for r in d.collect()}


@pytest.mark.parametrize("mode", graph.WEIGHT_MODES)
def test_matrix(three, mode):
    nodes, edges, scores = three
    p = graph.transition(scores, graph.weighted_edges(edges, nodes, mode))
    assert {(r.src, r.dst): r.p for r in p.collect()} == {("q", "f"): 1.0, ("f", "c"): 1.0, ("c", "f"): 1.0}


def test_propagation(three):
    nodes, edges, scores = three
    p = graph.transition(scores, graph.weighted_edges(edges, nodes))
    near = lambda got, want: got == pytest.approx(dict(zip("qfc", want, strict=True)))
    assert near(told(graph.diffuse(scores, p, 0.3, 1)), (0.70, 0.74, 0.36))
    assert near(told(graph.diffuse(scores, p, 0.3, 2)), (0.49, 0.836, 0.474))
    assert near(told(graph.page_rank(scores, p, 0.3, 1)), (0.30, 1.06, 0.44))
    assert near(told(graph.page_rank_until(scores, p, 0.3, 1)), (0.30, 1.06, 0.44))
    assert near(told(graph.diffuse(scores, p, 0.0, 2)), (1.0, 0.5, 0.3))
    assert near(told(graph.propagate(scores, None, "none")), (1.0, 0.5, 0.3))
    long = told(graph.page_rank(scores, p, 0.3, 4))
    assert told(graph.page_rank_until(scores, p, 0.3, 4, tol=0.0)) == pytest.approx(long)
    with pytest.raises(ValueError):
        graph.propagate(scores, p, "other")


def test_isolated_decays(spark):
    one = spark.createDataFrame([(1, "d", "x", 0.3, 0)], "qid int, doc_id string, id string, score double, ord int")
    none = spark.createDataFrame([], "qid int, src string, dst string, p double")
    assert told(graph.diffuse(one, none, 0.3, 2)) == pytest.approx({"x": 0.147})
    assert told(graph.page_rank_until(one, none, 0.3, 1)) == pytest.approx({"x": 0.09})


def test_relevance(spark, three):
    nodes, edges, _ = three
    anchor = spark.createDataFrame([("d", "q")], "doc_id string, id string")
    got = told(graph.relevance(anchor, graph.weighted_edges(edges, nodes)), "relevance")
    assert got == pytest.approx({"q": 1.0, "f": 0.88, "c": 0.44})
    only = graph.weighted_edges(edges.filter("type = 'caption_of'"), nodes)
    assert told(graph.relevance(anchor, only), "relevance") == {"q": 1.0}
    back = nodes.withColumn("section_role", F.lit("appendix"))
    assert told(graph.relevance(anchor, graph.weighted_edges(edges, back)), "relevance")["f"] == pytest.approx(1.144)


def test_max_sim(spark):
    d = spark.range(1).select(F.expr("array(array(1D, 0D), array(0D, 1D))").alias("q"), F.expr("array(array(1D, 0D), array(0.6D, 0.8D))").alias("e"))
    s = lambda *ok: d.select(vectors.max_sim(F.col("q"), F.col("e"), e_valid=F.array(*map(F.lit, ok)))).first()[0]
    assert s(True, True) == pytest.approx(1.8) and s(True, False) == pytest.approx(1.0) and s(False, False) == -20000
    pool = d.select(vectors.mean_pool(F.col("e"), F.array(F.lit(True), F.lit(False)), 2)).first()[0]
    assert pool == [1.0, 0.0]
    gate = d.select(vectors.gated_sum([(F.col("q")[0], F.lit(0.0)), (F.col("q")[1], F.lit(0.0))])).first()[0]
    assert gate == [0.5, 0.5]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcdef")], "qid int, id string, rank int")
    truth = spark.createDataFrame([(1, ["b", "f", "b"]), (2, [])], "qid int, gt array<string>")
    one, two = metrics.retrieval(ranked, truth).orderBy("qid").collect()
    assert (one.mrr, one.recall1, one.recall5, one.hit5, one.perfect5, one.recall10, one.perfect10) == (0.5, 0, 0.5, 1, 0, 1, 1)
    assert (two.mrr, two.recall10, two.hit10, two.perfect10) == (0, 0, 0, 1)
    graded = spark.createDataFrame([(1, 1, 2), (1, 2, 0), (1, 3, 1)], "qid int, rank int, rel int")
    assert metrics.ndcg(graded, ["qid"], 3).first().ndcg == pytest.approx(0.963940, abs=1e-6)
    pages = spark.range(1).select(metrics.cross_page_hit(F.expr("array(1, 2, 1)"), F.expr("array(2, 1)")).alias("a"), metrics.cross_page_hit(F.expr("array(1, 1)"), F.expr("array(1)")).alias("b"), metrics.cross_page_hit(F.expr("array(1, 2)"), F.expr("array(1)")).alias("c")).first()
    assert tuple(pages) == (1.0, None, 0.0)


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.9, 0, "text"), (1, "b", 0.1, 1, "text"), (1, "c", 0.2, 2, "visual")], "qid int, id string, score double, ord int, modality string")
    assert told(ranking.reciprocal_rank(d, ["qid"]), "rrf") == pytest.approx({"a": 1 / 61, "b": 1 / 62, "c": 1 / 61})
    tied = d.withColumn("score", F.lit(1.0))
    assert [r.id for r in ranking.rank(tied, ["qid"]).orderBy("rank").collect()] == ["a", "b", "c"]


def test_losses(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0), (1, 1.0, 0.5), (1, 0.0, 0.0), (2, 1.0, 0.0)], "anchor int, s double, rel double")
    assert [r.loss for r in losses.grcl(d).collect()] == pytest.approx([0.740939], abs=1e-6)
    assert [r.loss for r in losses.info_nce(d).collect()] == pytest.approx([0.907606], abs=1e-6)
    assert losses.coverage(d, k=5).count() == 0
    assert losses.coverage(d, k=1, eta=1.0).first().loss == pytest.approx((math.log1p(math.exp(-2)) + math.log1p(math.exp(-1))) / 2)
    same = losses.consistency(d.withColumn("dropped", F.col("s"))).collect()
    assert all(abs(r.loss) < 1e-12 for r in same)


def test_boxes(spark):
    b = lambda *x: boxes.box(*map(F.lit, x))
    r = spark.range(1).select(
        boxes.iou(b(0, 0, 2, 2), b(1, 1, 3, 3)).alias("i"), boxes.contained(b(0, 0, 2, 2), b(1, 1, 3, 3)).alias("c"),
        boxes.vertical_gap(b(0, 0, 1, 1), b(0, 3, 1, 4)).alias("g"), boxes.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z"),
        boxes.flipped(b(1, 2, 3, 4), F.lit(10)).alias("f"), boxes.relative(b(1, 2, 3, 4), F.lit(2.0), F.lit(4.0)).alias("r")).first()
    assert (r.i, r.c, r.g, r.z) == (pytest.approx(1 / 7), 0.25, 2, 0)
    assert tuple(r.f) == (1, 6, 3, 8) and tuple(r.r) == (0.5, 0.5, 1.5, 1.0)


def values(spark, f, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in d.orderBy("i").select(f(F.col("t"))).collect()]


def test_labels(spark):
    assert values(spark, text.anchored_label, "Fig. 3: x", "see Table 2 in Eq. 5", "Figures 3", "Alg 2.1 y", None) == ["figure 3", None, None, "algorithm 2.1", None]
    assert values(spark, text.inline_label, "Fig. 3: x", "see Table 2.", "notable 3", "Figure 3a") == ["figure3", "table2", None, None]
    assert values(spark, text.inline_references, "see Table 2 in Eq. 5", "none") == [["table 2", "equation 5"], []]
    assert values(spark, text.caption_label, "Figure 3: x", "Figure 3 x") == ["figure3", None]
    assert values(spark, lambda c: text.file_label(c, F.lit("Table 9")), "1804.04410v2-Figure1-1.png", "x.png") == ["figure 1", "table 9"]


def test_headings(spark):
    assert values(spark, text.normal_heading, "Sec. 3.4 In-context Learning", "3.1 Object detection", "A. Graph Reduction", "1 I N TRO DUCT ION", "", None) == [
        "in-context learning", "object detection", "graph reduction", "introduction", "", ""]
    assert values(spark, text.role, "3.1 Related Work", "Experiments and Models", "zzz", None) == ["related_work", "method", "other", "other"]
    assert values(spark, text.header_level, "1.2.3 x", "IV. x", "C. x", "B. x", "x") == [3, 1, 1, 2, 1]
    assert values(spark, text.numeric_header, "1.2 Title", "1.2 title", "1", "x\n1 Y") == [[1, 2], None, None, None]
    assert values(spark, text.is_heading, "2 Methods", "ab", "Modelling", "The end", None) == [True, False, True, False, False]


def test_latex_and_captions(spark):
    assert values(spark, text.plain_latex, r"\textbf{\emph{Big}} \cite{x} \alpha Word-2") == ["big word 2"]
    assert values(spark, text.normal_caption, r"Figure 1: A {B}\cite{k} \emph{c}") == ["a b c"]
    assert values(spark, text.section_titles, r"\section{A} \subsection{B} \section*{C}") == [["A", "C"]]
    assert values(spark, lambda c: text.locate(c, F.lit("needle"), 4, 2), "a need", "a ne", "none here") == [2, 2, 2]
    assert values(spark, text.paragraph_number, "d__p012", "d__x") == [12, None]
    assert values(spark, text.halved, "ab_ab", "ab_ba") == ["ab", "ab_ba"] and values(spark, text.without_version, "1.2v3") == ["1.2"]
    assert values(spark, text.layout_type, "title", "footnote", "formula") == ["section_header", None, "equation"]
    assert values(spark, text.element_type, "image", "blob") == ["figure", "text"]


def test_citations(spark):
    r = values(spark, text.references_with_context, "as in [12] Figure 3 and later in the text Table 4")[0]
    assert [x.label for x in r] == ["figure 3", "table 4"] and r[0].before == "in [12] "
    assert spark.range(1).select(text.cited(F.lit(r[0].before)), text.cited(F.lit(r[1].before))).first()[:] == (True, False)


def run_sections(spark, sizes, least=8):
    rows = [(1, i, s) for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))]
    d = sections.merged(spark.createDataFrame(rows, "doc_id int, ord int, section int"), least)
    return {r.section: r.kept_section for r in d.collect()}


def test_sections(spark):
    assert run_sections(spark, [3, 9, 2, 8, 1]) == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3}
    assert run_sections(spark, [2, 2, 9]) == {0: 0, 1: 0, 2: 2}
    heads = spark.createDataFrame([(1, i, x) for i, x in enumerate((1, 2, 2, 1))], "doc_id int, ord int, level int")
    path = lambda compat: [r.path for r in sections.paths(heads, compat=compat).orderBy("ord").collect()]
    assert path(False) == [[1], [1, 1], [1, 2], [2]] and path(True) == [[1], [1, 1], [1, 1], [1]]


def test_caption_proximity(spark):
    def near(kinds):
        d = spark.createDataFrame([(1, i, f"e{i}", k) for i, k in enumerate(kinds)], "doc_id int, ord int, id string, type string")
        return [(r.caption, r.visual, r.gap) for r in linking.nearby_visual(d).collect()]

    assert near(["caption", "text", "text", "figure", "text", "figure"]) == [("e0", "e3", 3)]
    assert near(["caption", "text", "text", "text", "figure"]) == []


def test_token_f1(spark):
    r = spark.range(1).select(metrics.token_f1(F.lit("the cat the"), F.lit("The cat.")), metrics.exact_match(F.lit("A, b"), F.lit("a B!")),
                              metrics.token_f1(F.lit(""), F.lit("x")), metrics.verdict(F.lit(" Yes, it is"))).first()
    assert r[0] == pytest.approx(0.8) and r[1:] == (1.0, 0.0, 1.0)


def test_bootstrap(spark):
    same = spark.range(200).select(F.col("id"), F.lit(0.5).alias("diff"))
    r = stats.bootstrap(same, "id", 200).first()
    assert (r.n, r.mean, r.lo, r.hi, r.p) == (200, 0.5, 0.5, 0.5, 0.0)
    mixed = spark.range(400).select(F.col("id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("diff"))
    r = stats.bootstrap(mixed, "id", 400).first()
    assert -0.2 < r.lo < -0.05 and 0.05 < r.hi < 0.2 and r.p > 0.5


def test_greedy_assignment(spark):
    e = spark.createDataFrame([(1, "a", "figure", "one two three", 0), (1, "b", "figure", "one two three", 1), (2, "c", "figure", "x", 0)], "doc_id int, id string, type string, text string, ord int")
    f = spark.createDataFrame([(1, "f1", "figure", "one two three", 0), (1, "f2", "figure", "one two thre", 1), (3, "f3", "table", "x", 0)], "doc_id int, file string, type string, text string, ord int")
    got = {r.id: r.file for r in linking.assign_greedily(e, f).collect()}
    assert got == {"a": "f1", "b": "f2"}


def plain_features(nodes, edges):
    """{id: (type, role, depth, place)} of one graph, edge by edge: nodes are (id, type, role, path), edges (src, dst, type)."""
    known, inside, place, inherited, out = {n[0]: n for n in nodes}, {}, {}, {}, {}

    def number(i):
        tail = i.split("__p")[-1] if "__p" in i else ""
        return int(tail) if tail.isdigit() else None

    for src, dst, kind in edges:
        if kind == "contains" and src in known and dst in known:
            if known[src][1] == "section_header":
                inside.setdefault(src, []).append(dst)
            elif known[dst][1] == "section_header":
                inside.setdefault(dst, []).append(src)
    for section, children in inside.items():
        for i, child in enumerate(sorted(children, key=lambda c: (number(c) is None, number(c) or 0))):
            place[child] = i / len(children)
            inherited.setdefault(child, known[section][2] or "other")
    for i, kind, role, path in nodes:
        role = role or inherited.get(i) or "other"
        out[i] = (ELEMENT_TYPES.index(kind if kind in ELEMENT_TYPES else "text"), SECTION_ROLES.index(role if role in SECTION_ROLES else "other"),
                  float(len(path)) if path else 1.0, place.get(i, 0.0))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_node_features(spark, seed):
    """F8: numbers come from ids; kind, role, depth and place of every node, also of those that no section or several have."""
    r, nodes, edges = random.Random(seed), [], []
    for d in "ab":
        ids = [f"{d}__p{i:03d}" for i in range(12)] + [f"{d}__p00{i}__e{i}" for i in range(4)] + [f"{d}__fig{i}" for i in range(6)] + [f"{d}__sec{i}" for i in range(4)] + [f"{d}__px"]
        r.shuffle(ids)
        nodes += [(d, i, "section_header" if "sec" in i else r.choice(["text", "figure", "odd", None]), r.choice([None, "", "method", "strange", "result"]), r.choice([None, [], [1], [2, 1, 3]])) for i in ids]
        pairs = [(s, i) for s in (f"{d}__sec{k}" for k in range(4)) for i in r.sample(ids, 8)]
        pairs = [p[:: r.choice([1, -1])] for p in pairs if p[0] != p[1]] + [(ids[0], ids[1]), (f"{d}__sec0", "not there")]
        r.shuffle(pairs)
        edges += [(d, k, *p, r.choice(["contains"] * 5 + ["refer_to"])) for k, p in enumerate(pairs)]
    n = spark.createDataFrame(nodes, "doc_id string, id string, type string, section_role string, section_path array<int>")
    e = spark.createDataFrame(edges, "doc_id string, ord int, src string, dst string, type string")
    got = {(x.doc_id, x.id): (x.type_id, x.role_id, x.depth, x.intra_pos) for x in sections.node_features(n, e).collect()}
    want = {(d, i): v for d in "ab" for i, v in plain_features([x[1:] for x in nodes if x[0] == d], [x[2:] for x in edges if x[0] == d]).items()}
    assert got == want and len({v[3] for v in want.values()}) > 5
