"""Builders and readers against plain versions."""

import json
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import build, latex, linking, papers, sections
from lodegraph.sources import datasets, reports

CAPTION = re.compile(r"(?i)^\s*(figure|fig\.?|table|tab\.?)\s*([0-9]+(?:\.[0-9]+)?)[:.]\s*")
ANYWHERE = re.compile(r"(?i)\b(figure|fig\.?|table|tab\.?)\s*([0-9]+(?:\.[0-9]+)?)\b")


def label(pattern, words):
    m = pattern.search(words or "")
    return m and ("figure" if m[1].lower().startswith("fig") else "table") + m[2]


def plain_links(rows, limit, own, shaped, renew, judge):
    """caption_of and references of one document's (id, page, kind, text, y0, y1), in order."""
    out, known = [], {}
    visuals = [r for r in rows if r[2] == "visual"]
    for v in visuals:
        if (name := label(own, v[3])) and name not in known:
            known[name] = v
    for c in (r for r in rows if shaped(r)):
        name = label(CAPTION if judge else ANYWHERE, c[3])
        if name in known and known[name][1] == c[1]:
            out.append((c[0], known[name][0], "caption_of", 1.0))
            continue
        gaps = [(max(v[4] - c[5], c[4] - v[5], 0), i, v) for i, v in enumerate(visuals) if v[1] == c[1]]
        if gaps and min(gaps)[0] < limit:
            v = min(gaps)[2]
            out.append((c[0], v[0], "caption_of", 0.7))
            if name and (renew or name not in known):
                known[name] = v
    for r in rows:
        for m in ANYWHERE.finditer(r[3]) if r[2] == "text" else ():
            name = ("figure" if m[1].lower().startswith("fig") else "table") + m[2]
            if name in known and known[name][0] != r[0]:
                begin = max(0, m.start() - 50)
                around = r[3][begin : m.end() + 50]
                early = judge and m.start() - begin < 20 and re.search(r"(?i)\[[\d, ]+\]|\bet\s+al\b", around)
                out.append((r[0], known[name][0], "references", 0.5 if early else 0.9))
    return sorted(out)


def made(seed):
    r, rows = random.Random(seed), []
    for doc in "ab":
        for i in range(90):
            kind = r.choice(["text", "text", "text", "figure", "table", "caption"])
            words = r.choice(["Figure 1: a plot", "Table 2. Rows", "see Fig. 3 and Table 2 [4]", "Fig 1 by Some et al", "nothing here", "", "as Figure 2 shows [1], and Table 1", "Tab. 3: x",
                              "12345678 Figure 1 [3]", "seventeen letters Table 2 [1, 2]", "nineteen characters Fig. 2 [5]", "twenty characters so Fig. 2 [5]", "x" * 60 + " Figure 3 [4]"])
            y = r.randint(0, 700)
            rows.append((doc, f"{doc}{i}", i, i // 9, kind, words, float(y), float(y + r.randint(5, 80))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_page_graph(spark, seed):
    rows = [(*x[:4], "text" if x[4] == "caption" else x[4], *x[5:]) for x in made(seed)]
    df = spark.createDataFrame(rows, "doc_id string, id string, ord int, page int, type string, text string, y0 double, y1 double")
    got = defaultdict(list)
    for e in papers.page_graph(df).filter("type IN ('caption_of', 'references')").collect():
        got[e.doc_id].append((e.src, e.dst, e.type, e.confidence))
    for doc in "ab":
        own = [(x[1], x[3], "text" if x[4] == "text" else "visual", x[5], x[6], x[7]) for x in rows if x[0] == doc]
        want = plain_links(own, 0.05 * max(x[5] for x in own), ANYWHERE, lambda r: r[2] == "text" and CAPTION.match(r[3]), False, True)
        assert sorted(got[doc]) == want and len(want) > 20


@pytest.mark.parametrize("seed", [3, 4])
def test_extracted_graph(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id string, id string, ord int, page int, type string, text string, y0 double, y1 double")
    got = defaultdict(list)
    for e in papers.extracted_graph(df).collect():
        got[e.doc_id].append((e.src, e.dst, e.type, e.confidence))
    for doc in "ab":
        own = [(x[1], x[3], {"figure": "visual", "table": "visual"}.get(x[4], x[4]), x[5], x[6], x[7]) for x in rows if x[0] == doc]
        assert sorted(got[doc]) == plain_links(own, 100, ANYWHERE, lambda r: r[2] == "caption", True, False)


def test_visuals_are_named_by_their_first_free_label(spark):
    """By the text, else what was read off the picture, else what a model says; labels that an earlier visual has are taken."""
    rows = [("d", "v1", 0, "Figure 1", None, None), ("d", "v2", 1, "Figure 1", "Table 2", None), ("d", "v3", 2, None, "Figure 1", "see fig. 3"), ("d", "v4", 3, "Table 2", None, "Figure 1")]
    df = spark.createDataFrame([(*x[:3], 0, "image", *x[3:], 1000.0 + 100 * x[2], 1010.0 + 100 * x[2]) for x in rows] + [("d", "t", 9, 1, "text", "", "Figure 3 and table 2", None, 5.0, 6.0)],
                               "doc_id string, id string, ord int, page int, type string, text string, ocr_text string, vlm_text string, y0 double, y1 double")
    got = {(e.src, e.dst, e.confidence) for e in papers.page_graph(df).filter("type = 'references'").collect()}
    assert got == {("t", "v3", 0.9), ("t", "v2", 0.9)}


def test_references_with_context(spark):
    r = random.Random(8)
    pattern = re.compile(r"(?i)(?<![^\W])(figure|fig\.?|table|tab\.?|equation|eq\.?)\s*(\d+(?:\.\d+)?)")
    texts = ["".join(r.choice(["Fig. 1", "eq 2", "Table 3.1", " ", "word ", "[3] ", "long " * 30, "é日 "]) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None, "fig 1 " * 700]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.references_with_context(F.col("t")).alias("r"))
    for row in d.collect():
        t = texts[row.i]
        want = [(m.start(), t[max(0, m.start() - 8) : m.start()], t[max(0, m.start() - 50) : m.end() + 50]) for m in pattern.finditer(t or "")]
        assert [(x.start, x.before, x.around) for x in row.r or []] == want


def test_choose_in_turn(spark):
    r = random.Random(5)
    rows = [(d, f"w{w}", w, i, f"x{x}") for d in range(8) for w in range(12) for i, x in enumerate(r.sample(range(10), r.randint(0, 6)))]
    got = {(x.doc_id, x.who): x.what for x in linking.choose_in_turn(spark.createDataFrame(rows, "doc_id int, who string, turn int, wish int, what string")).collect()}
    want, taken = {}, set()
    for d, who, _, _, what in sorted(rows, key=lambda x: (x[0], x[2], x[3])):
        if (d, who) not in want and (d, what) not in taken:
            want[(d, who)] = what
            taken.add((d, what))
    assert got == want


def test_greedy_assignment_and_fuzzy_captions_against_plain(spark):
    r = random.Random(6)
    words = lambda: " ".join(r.choices(["one", "two", "three", "plot", "of", "rows", "data"], k=r.randint(0, 7)))
    es = [(d, f"e{i}", r.choice(["figure", "table"]), words(), i) for d in range(4) for i in range(15)]
    fs = [(d, f"f{i}", r.choice(["figure", "table"]), words(), i) for d in range(4) for i in range(12)]
    same = lambda a, b: SequenceMatcher(None, a[:200], b[:200]).ratio()
    want = {}
    for d in range(4):
        free = [f for f in fs if f[0] == d]
        for e in [e for e in es if e[0] == d]:
            best = max(((same(e[3], f[3]), -f[4], f) for f in free if f[2] == e[2] and e[3] and f[3]), default=None)
            if best and best[0] >= 0.6:
                want[(d, e[1])] = best[2][1]
                free.remove(best[2])
    e, f = (spark.createDataFrame(x, f"doc_id int, {n} string, type string, text string, ord int") for x, n in ((es, "id"), (fs, "file")))
    assert {(x.doc_id, x.id): x.file for x in linking.assign_greedily(e, f).collect()} == want and len(want) > 10
    got = {(x.doc_id, x.file): (x.id, round(x.similarity, 9)) for x in linking.fuzzy_captions(f.withColumn("label", F.col("type")), e.withColumn("label", F.col("type"))).collect()}
    for d, file, kind, t, _ in fs:
        score = max(((0.3 * (kind == x[2]) + 0.7 * same(t, x[3]) if t and x[3] else float(kind == x[2]), -x[4], x[1]) for x in es if x[0] == d))
        assert got.get((d, file)) == ((score[2], round(score[0], 9)) if score[0] >= 0.3 else None)


def test_connected_against_plain(spark):
    r = random.Random(6)
    pairs = [(f"n{r.randrange(80):02d}", f"n{r.randrange(80):02d}") for _ in range(60)] + [(f"z{i:03d}", f"z{i + 1:03d}") for i in range(150)]
    ids = sorted({x for p in pairs for x in p} | {"alone"})
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([("d", i) for i in ids], "doc_id string, id string")
    out = papers.connected(nodes, spark.createDataFrame([("d", *p) for p in pairs], "doc_id string, src string, dst string"))
    assert {x.id: x.component for x in out.collect()} == root


def plain_conversion(elements, links, reclassify):
    """Sections, names, types and edges of one document, element by element."""
    head = re.compile(r"(?i)^\s*(?:(?:[1-9]\d?\.?)+\s+[A-Z]|(?:section|sec\.?|appendix|app\.?)\s+[A-Z\d]|(?:" + "|".join(w for _, ws in text.ROLES_LAYOUT for w in ws) + "))")
    looks = lambda t: 3 <= len(t.strip()) <= 120 and bool(head.match(t.strip()))
    raw = {e[0]: "section_header" if reclassify and e[1] == "text" and looks(e[2] or "") else e[1] for e in elements}
    words = {e[0]: e[2] or "" for e in elements}
    order = sorted(raw, key=lambda i: tuple(map(int, re.findall(r"\d+", i.split("__", 1)[1]))))
    groups, names = [], []
    if "section_header" in raw.values():
        for i in order:
            if raw[i] == "section_header" or not groups:
                groups.append([])
                names.append((words[i] or None) if raw[i] == "section_header" else "Front Matter")
            groups[-1].append(i)
    else:
        near = defaultdict(set)
        for s, d, kind, _ in links:
            if kind == "same_section":
                near[s].add(d)
                near[d].add(s)
        seen = set()
        for i in order:
            if i not in seen:
                todo, group = [i], []
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        group.append(x)
                        todo += near[x]
                groups.append(group)
                names.append(None)
    kept = []
    for group, name in zip(groups, names, strict=True):
        if kept and len(group) < 8:
            kept[-1][0].extend(group)
        else:
            kept.append((list(group), name))
    labels, of = [], {}
    for n, (group, name) in enumerate(kept):
        group.sort(key=order.index)
        found = name or next((words[i].strip() for i in group[:10] if raw[i] == "section_header" or looks(words[i])), None)
        labels.append(found[:80] if found else f"section_{n:03d}")
        of |= {i: n for i in group}
    edges = [(f"d__sec{n:03d}", i, "contains", 1.0) for i, n in of.items()]
    edges += [(f"d__sec{n:03d}", f"d__sec{n + 1:03d}", "section_next", 1.0) for n in range(len(kept) - 1)]
    edges += [(a, b, "reading_next", 1.0) for a, b in zip(order, order[1:]) if of[a] == of[b]]
    old = [x for x in links if x[0] in raw and x[1] in raw]
    captions = [(s, d, "caption_of", 0.7 if c is None else c) for s, d, kind, c in old if kind == "caption_of"]
    free = [i for i in raw if raw[i] in ("figure", "table") and i not in {d for _, d, _, _ in captions}]
    for c in [i for i in raw if raw[i] == "caption" and i not in {s for s, _, _, _ in captions}]:
        gap = [(abs(order.index(c) - order.index(v)), k, v) for k, v in enumerate(free)]
        if gap and min(gap)[0] <= 3:
            captions.append((c, min(gap)[2], "caption_of", 0.7))
    pattern = re.compile(r"(?i)^\s*(figure|fig\.?|table|tab\.?)\s*(\d+)")
    name_of = lambda t: (m := pattern.match(t)) and ("figure " if m[1].lower().startswith("fig") else "table ") + m[2]
    visual = {}
    for c in [i for i in raw if raw[i] == "caption" and name_of(words[i])]:
        if mates := [d for s, d, _, _ in captions if s == c and raw[d] in ("figure", "table", "equation")]:
            visual[name_of(words[c])] = mates[0]
    for v in [i for i in raw if raw[i] in ("figure", "table", "equation") and name_of(words[i])]:
        visual.setdefault(name_of(words[v]), v)
    refers = [(s, d, "refer_to", 0.9 if c is None else c) for s, d, kind, c in old if kind == "references"]
    have = {(s, d) for s, d, _, _ in refers}
    for t in [i for i in raw if raw[i] == "text" and len(words[i]) >= 10]:
        met = set()
        for m in re.finditer(r"(?i)(?<!\w)(figure|fig\.?|table|tab\.?)\s*(\d+)", words[t]):
            name = ("figure " if m[1].lower().startswith("fig") else "table ") + m[2]
            if name not in met and not met.add(name) and name in visual and not re.search(r"\[\d+\]", words[t][max(0, m.start() - 8) : m.start()]) and (t, visual[name]) not in have:
                have.add((t, visual[name]))
                refers.append((t, visual[name], "refer_to", 0.9))
    sources = {s for s, _, kind, _ in links if kind == "caption_of"}
    kinds = {i: "caption" if i in sources and k in ("text", "section_header") else {"section_header": "text", "image": "figure"}.get(k, k) for i, k in raw.items()}
    return kinds, labels, sorted(edges + captions + refers)


@pytest.mark.parametrize("seed", range(4))
def test_convert_graph(spark, seed):
    r = random.Random(seed)
    texts = ["1 Introduction", "Related work", "see Figure 1 and [3] Table 2", "as Table 2 [1] shows, and Figure 1 too; Figure 2", "short", "plain words without any sense in them", "", None]
    rows = []
    for i in range(90):
        kind = r.choice(["text"] * 5 + ["figure", "table", "caption", "image", "equation"] + (["section_header"] if seed == 1 else []))
        rows.append((f"d__p{i // 12:03d}__e{i:04d}", kind, r.choice(texts if seed < 3 else texts[2:]) if kind == "text" else "2 Method" if kind == "section_header" else f"{r.choice(['Figure', 'Table'])} {r.randint(1, 4)}: x"))
    r.shuffle(rows)
    ids = [x[0] for x in rows]
    links = [(r.choice(ids), r.choice([*ids, "gone"]), r.choice(["caption_of", "references"]), r.choice([None, 0.5, 1.0])) for _ in range(25)]
    ordered = sorted(ids)
    links += [(a, b, "same_section", 0.6) for a, b in zip(ordered, ordered[1:]) if r.random() < 0.85]
    e = spark.createDataFrame([("d", i, n, kind, words, 0) for n, (i, kind, words) in enumerate(rows)], "doc_id string, id string, ord int, type string, text string, page int")
    k = spark.createDataFrame([("d", n, *x) for n, x in enumerate(links)], "doc_id string, ord int, src string, dst string, type string, confidence double")
    nodes, edges = build.convert_graph(e, k, reclassify=seed != 2)
    kinds, labels, want = plain_conversion(rows, links, seed != 2)
    got = nodes.collect()
    assert {n.id: n.type for n in got if "__sec" not in n.id} == kinds
    assert [n.label for n in sorted((n for n in got if "__sec" in n.id), key=lambda n: n.id)] == labels and len(labels) > 1
    assert sorted((x.src, x.dst, x.type, x.confidence) for x in edges.collect()) == want


def test_latex(spark):
    long = "words that go on " * 5
    tex = (f"intro {long}\n\nshort\\section{{The \\textbf{{big}} Method}}{long}\n \n{long}\\subsection*{{Deep}} \\begin{{figure*}}x\\caption{{A {{b}} \\cite{{q}}\\emph{{gone}} c}}"
           f"\\label{{f:1}}\\end{{figure*}}{long}\\section{{Conclusion}}\\begin{{table}}\\end{{table}}\\subsection{{S}}\\begin{{figure}} open {long}")
    out = latex.elements(spark.createDataFrame([("d", tex), ("e", ""), ("f", None), ("g", "\\section{" + "{x} y " * 5000 + "}")], "doc_id string, tex string"))
    rows = out.orderBy("doc_id", "place").collect()
    got = [(r.type, r.text[:12], r.label, r.level, r.section_path, r.section_role) for r in rows if r.doc_id == "d"]
    assert [r.place for r in rows if r.doc_id == "d"] == list(range(11)) and [(r.doc_id, r.text[:7]) for r in rows if r.doc_id != "d"] == [("g", "x y x y")]
    assert got == [
        ("text", "intro words ", None, None, [1], "other"), ("heading", "the method", None, 1, [1], "method"), ("text", "words that g", None, None, [1, 1], "method"),
        ("text", "words that g", None, None, [1, 2], "method"), ("heading", "deep", None, 2, [1, 1], "method"), ("figure", "a b c", "f:1", None, [1, 1, 1], "method"),
        ("text", "words that g", None, None, [1, 1, 2], "method"), ("heading", "conclusion", None, 1, [2], "conclusion"), ("table", "", None, None, [2, 1], "conclusion"),
        ("heading", "s", None, 2, [2, 1], "conclusion"), ("text", "\\begin{figur", None, None, [2, 1, 1], "conclusion")]


def test_paper_graph_without_source_and_by_votes(spark):
    body = "we look at Figure 7 and more words to fill this paragraph up"
    figures = [("a", 0, "a-Figure7-1.png", "figure", "Figure 7: not in the source at all"), ("b", 0, "b-Table1-1.png", "Table", "Table 1: rows"), ("b", 1, "x.png", None, None)]
    paragraphs = [("a", 0, "not found here at all, really not in any way"), ("a", 1, f"{body} one"), ("a", 2, f"{body} two"), ("a", 3, "lost"), ("b", 0, "Table 1")]
    tex = [("a", f"\\section{{One}} {body} one \\section{{Two \\emph{{x}}}} {body} two \\subsection{{no}} end"), ("b", None)]
    nodes, edges = papers.paper_graph(spark.createDataFrame(figures, "doc_id string, place int, id string, type string, caption string"),
                                      spark.createDataFrame(paragraphs, "doc_id string, place int, text string"), spark.createDataFrame(tex, "doc_id string, tex string"))
    inside = {(e.src, e.dst) for e in edges.filter("type = 'contains'").collect()}
    assert {("a__sec00", "a__p000"), ("a__sec00", "a__p001"), ("a__sec00", "a-Figure7-1.png"), ("b__sec00", "b__p000"), ("b__sec00", "b-Table1-1.png__caption")} <= inside
    assert {(e.src, e.dst) for e in edges.filter("type = 'refer_to'").collect()} == {("a__p001", "a-Figure7-1.png"), ("a__p002", "a-Figure7-1.png"), ("b__p000", "b-Table1-1.png")}
    kinds = {n.id: (n.type, n.label) for n in nodes.collect()}
    assert kinds["b-Table1-1.png"] == ("table", "table 1") and kinds["b__sec00"] == ("section_header", "Untitled") and kinds["x.png"] == ("figure", None)


def test_files_of_papers_and_content_lists(spark, tmp_path):
    """One object keyed by paper over many lines, a file of matches, and an array of entries in a paper's own folder."""
    (tmp_path / "p").mkdir()
    book = {"p1": {"all_figures": {"z.png": {"caption": "Figure 1: z", "content_type": "figure"}, "a.png": {"caption": "Table 2: a", "content_type": "table"}, "b.png": {}},
                   "qa": [{"question": "q0", "answer": "x", "reference": "a.png"}, {"question": "q1", "answer": "y", "reference": ["a.png"]}, {"question": "q2", "answer": None, "reference": None}, {"question": "q3", "answer": "z", "reference": "z.png"}]},
            "p2": {"all_figures": {}, "qa": []}, "p3": {"all_figures": {"c.png": {"caption": None}}}}
    (tmp_path / "p/book.json").write_text(json.dumps(book, indent=1))
    (tmp_path / "p/bad.json").write_text("{no")
    d = datasets.papers(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in datasets.paper_figures(d).orderBy("doc_id", "ord").collect()] == [
        ("p1", 0, "z.png", "figure", "Figure 1: z"), ("p1", 1, "a.png", "table", "Table 2: a"), ("p1", 2, "b.png", "figure", ""), ("p3", 0, "c.png", "figure", "")]
    assert [tuple(r) for r in datasets.referring_questions(d).orderBy("qid").collect()] == [("p1_q0", "p1", "q0", "x", ["a.png"]), ("p1_q3", "p1", "q3", "z", ["z.png"])]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/map.json").write_text(json.dumps({"a.png": {"eid": "e9", "similarity": 0.8}, "other.png": {"eid": "e1"}}))
    mapped = datasets.mapped_questions(datasets.paper_questions(d, datasets.MAPPED), datasets.figure_mapping(spark, str(tmp_path / "m")))
    assert [tuple(r) for r in mapped.collect()] == [("spiqa_p1_00", "p1", "q0", "x", ["e9"])]
    (tmp_path / "c/p1/auto").mkdir(parents=True)
    entries = [{"type": "text", "text": "first"}, {"type": "text", "text": "Method", "text_level": 1}, {"type": "image", "image_caption": ["Figure 1: z"], "page_idx": 3},
               {"type": "equation"}, {"type": "table", "table_caption": []}, {"type": "text", "text": "words"}]
    (tmp_path / "c/p1/auto/p1_content_list.json").write_text(json.dumps(entries, indent=2))
    (tmp_path / "c/p1/auto/p1_middle.json").write_text("[]")
    out = datasets.content_list(spark, str(tmp_path / "c"), datasets.paper_figures(d)).orderBy("id").collect()
    assert [(r.doc_id, r.id, r.type, r.section_path, r.section_role, r.page, r.label, r.file) for r in out] == [
        ("p1", "p1__image_001", "figure", [1, 1], "method", 3, "figure1", "z.png"), ("p1", "p1__para_000", "text", [1], "other", -1, None, None),
        ("p1", "p1__para_003", "text", [1, 3], "method", -1, None, None), ("p1", "p1__table_002", "table", [1, 2], "method", -1, None, None)]


def test_text_files_and_folders(spark, tmp_path):
    for folder, name, words in (("one", "a.tex", "A1"), ("two", "a.tex", "A2"), ("two", "b.tex", "B"), ("two", "c.txt", " x \n\n\n\n y\n"), ("two", "no.md", "z")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(words)
    one, two, none = (str(tmp_path / x) for x in ("one", "two", "none"))
    assert {tuple(r) for r in datasets.whole_texts(spark, none, one, two).collect()} == {("a", "A1"), ("b", "B")}
    assert [tuple(r) for r in datasets.paragraph_files(spark, none, two).orderBy("place").collect()] == [("c", 0, "x"), ("c", 1, "y")]
    assert datasets.whole_texts(spark, none).count() == 0
    assert datasets.first_existing(spark, none, two, one) == two and datasets.first_existing(spark, none) == none
    assert datasets.missing_files(spark, one, none) == [none]


def test_results_and_studies(spark, tmp_path):
    for folder, words in (("edge_caption_of_x", '{"results": {"d": {"v": {"mrr": 0.5, "n_queries": 3}}}}'), ("other_run", '{"results": {"d": {"v": {"mrr": 0.25}}}}'), ("edge_bad", "{no")):
        (tmp_path / "runs" / folder).mkdir(parents=True)
        (tmp_path / "runs" / folder / "eval.json").write_text(words)
    rows = spark.createDataFrame([("edge",), ("edge_caption_of",)], "row_id string")
    assert {tuple(r) for r in datasets.run_results(spark, str(tmp_path / "runs"), rows).collect()} == {("edge_caption_of", "d", "v", "mrr", 0.5), ("other", "d", "v", "mrr", 0.25)}
    (tmp_path / "study").mkdir()
    for name, words in (("a.json", json.dumps({"encoder": "x", "hit": 0.5})), ("summary.json", "{}"), ("bad.json", "nothing")):
        (tmp_path / "study" / name).write_text(words)
    assert [tuple(r) for r in datasets.study_results(spark, str(tmp_path / "study"), "encoder string, hit double").collect()] == [("a.json", "x", 0.5)]


def test_alike_visuals_and_random_roles(spark):
    f = spark.createDataFrame([("d", "f1", "figure", "a plot of some words"), ("d", "f2", "table", "a plot of some words"), ("d", "f3", "figure", "")], "doc_id string, file string, type string, text string")
    v = spark.createDataFrame([("d", "v1", 0, "figure", "a plot of some word"), ("d", "v2", 1, "figure", "a plot of some words"), ("d", "v3", 2, "table", "entirely different thing here")], "doc_id string, id string, ord int, type string, text string")
    assert [(r.file, r.id, r.similarity) for r in linking.alike_visuals(f, v).collect()] == [("f1", "v2", 1.0)]
    drawn = linking.random_roles(spark.range(3000).select(F.lit("d").alias("doc_id"), "id"), ("a", "b", "c")).groupBy("drawn").count().collect()
    assert {r.drawn for r in drawn} == {"a", "b", "c"} and all(900 < r["count"] < 1100 for r in drawn)


def test_plain_latex_of_commands(spark):
    rows = [("\\emph{a \\textbf{b}} c", "a b c"), ("x \\cite[p. 3]{key} y\\ref{z}", "x y"), ("\\foo[opt]{kept} \\bar rest", "kept rest"), ("Café $x^2$", "caf x 2"), (None, "")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.plain_latex(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [w for _, w in rows]


def test_pages_hold_their_graph(spark):
    nodes = spark.createDataFrame([("d", "x", "text", None, "intro", "</script> words"), ("d", "y", "figure", "figure 1", None, None)], "doc_id string, id string, type string, label string, section_role string, text string")
    edges = spark.createDataFrame([("d", "x", "y", "refer_to", 0.9, False, None)], "doc_id string, src string, dst string, type string, confidence double, bidirectional boolean, evidence string")
    page = reports.graph_pages(nodes, edges).first().html
    data = json.loads(page.split("const g=")[1].split(";const s=")[0])
    assert [n["name"] for n in data["nodes"]] == ["</script> words…", "figure 1"] and data["edges"][0]["title"] == "<b>refer_to</b><br>confidence: 0.90"
    assert page.count("</script>") == 1


def test_connected_keeps_ever_fewer_edges(spark, monkeypatch):
    """Rounds over a long chain in the order of its ids: tables shrink from round to round, and only what the result reads is left."""
    kept, sizes, paths = papers.kept, [], []

    def counted(df):
        out, path = kept(df)
        paths.append(path.removeprefix("file:"))
        if df.columns == ["doc_id", "src", "dst"]:
            sizes.append(out.count())
        return out, path

    monkeypatch.setattr(papers, "kept", counted)
    n = 1500
    nodes = spark.range(n).selectExpr("'d' AS doc_id", "lpad(id, 6, '0') AS id")
    edges = spark.range(n - 1).selectExpr("'d' AS doc_id", "lpad(id, 6, '0') AS src", "lpad(id + 1, 6, '0') AS dst")
    edges = edges.union(spark.createDataFrame([("d", "000003", "not there"), ("d", "not there", "000001")], edges.schema))
    out = papers.connected(nodes, edges)
    assert {r.component for r in out.collect()} == {"000000"} and out.count() == n
    assert sum(sizes) <= 3 * sizes[0] and sizes[-1] == 0
    assert sum(Path(p).exists() for p in paths) == 1


def test_locate_all_is_locate(spark):
    r = random.Random(8)
    words = ["".join(r.choices("ab", k=r.randint(1, 3))) for _ in range(300)]
    plain = " ".join(words)
    pieces = [plain[a : a + r.randint(1, 60)] + r.choice(["", "c" * 20]) for a in (r.randint(0, 500) for _ in range(400))] + ["", None, "zz"]
    d = spark.createDataFrame([(plain, pieces), (None, ["a"]), ("a", None)], "t string, x array<string>")
    each = F.transform("x", lambda x: text.locate(F.col("t"), x, 20, 5).cast("long"))
    rows = d.select(each.alias("a"), text.locate_all(F.col("t"), F.col("x"), 20, 5).alias("b")).collect()
    assert rows[0].a == rows[0].b and [x.b for x in rows[1:]] == [[None], []]


def plan_of(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_gone_through_once(spark):
    """references and their contexts in one pass, not by pieces that are put together; labels by one pattern for each part."""
    d = spark.createDataFrame([("Fig. 3 and [1] Table 4",), (None,)], "t string")
    assert "regexp_extract_all" not in plan_of(d.select(text.references_with_context(F.col("t"))))
    assert plan_of(d.select(text.anchored_label(F.col("t")))).count("regexp_extract(t#") == 2
    rows = d.select(text.references_with_context(F.col("t")).alias("r"), text.anchored_label(F.col("t")).alias("l")).collect()
    assert [x.label for x in rows[0].r] == ["figure 3", "table 4"] and rows[0].l == "figure 3" and rows[1].r is None and rows[1].l is None


def test_pages_are_paired_where_their_document_is(spark):
    """a page is not joined with itself; equal places and rows without a page make no pair."""
    rows = [("d", "a", 1, 0), ("d", "b", 2, 0), ("d", "c", 2, 0), ("d", "x", 3, 1), ("d", "n", 4, None), ("d", "m", 5, None), ("e", "y", 3, 0)]
    d = papers.page_pairs(spark.createDataFrame(rows, "doc_id string, id string, ord int, page int"))
    assert sorted((e.src, e.dst) for e in d.collect()) == [("a", "b"), ("a", "c")]
    assert "Join" not in plan_of(d)


def test_older_graphs_read_what_they_need(spark, small):
    """edges of order need no texts, and kinds of elements are not joined to them by their ids."""
    from lodegraph.plans import datasets as plans

    assert "Join" not in plan_of(plans.page_graph_order(spark, small)) and "regexp" not in plan_of(plans.page_graph_order(spark, small))
    assert "Join" not in plan_of(plans._page_elements(spark, small, "section_header"))
    kinds = {r.type for r in plans._page_elements(spark, small, "section_header").select("type").distinct().collect()}
    assert "caption" in kinds and "section_header" not in kinds


def test_graphs_are_built_where_their_documents_are(spark):
    """sections are merged, named and given roles by windows inside a document, without a join that shuffles texts."""
    rows = [("d", i, s) for i, s in enumerate(x for x, n in enumerate([2, 9, 3, 8]) for _ in range(n))] + [(None, 0, 0)]
    d = sections.merged(spark.createDataFrame(rows, "doc_id string, ord int, section int"))
    assert {(r.section, r.kept_section) for r in d.collect()} == {(0, 0), (1, 1), (2, 1), (3, 3)} and d.count() == 22
    assert "Join" not in plan_of(d)
    heads = {1: "1 Introduction", 10: "2 Method"}
    es = spark.createDataFrame([("d", f"e{i}", "text", heads.get(i, "words of a text"), i // 5, i) for i in range(20)], "doc_id string, id string, type string, text string, page int, ord int")
    nodes, _ = build.build_graph(es)
    assert "Join" not in plan_of(nodes)
    got = {(r.id, r.label, r.section_role, r.page, r.ord) for r in nodes.filter("type = 'section_header'").collect()}
    assert got == {("d__sec000", "Front Matter", "front_matter", 0, 0), ("d__sec001", "1 Introduction", "intro", 0, 1), ("d__sec002", "2 Method", "method", 2, 10)}
    assert {r.section_role for r in nodes.filter("type = 'text' AND ord > 10").collect()} == {"method"}


def test_files_on_the_way_are_compressed(spark, tmp_path):
    """pages, graphs and lists that are written and read again."""
    from lodegraph.sources import files

    n = spark.createDataFrame([("d", "a", "text", None, "method", "words")], "doc_id string, id string, type string, label string, section_role string, text string")
    e = spark.createDataFrame([], "doc_id string, src string, dst string, type string, confidence double, bidirectional boolean, evidence string")
    reports.write_pages(reports.graph_pages(n, e), str(tmp_path / "pages"))
    files.write_graphs(n.selectExpr("doc_id", "0 AS ord", "id", "type", "1 AS page", "array(1) AS section_path", "section_role", "label"), e.withColumn("ord", F.lit(0)), str(tmp_path / "graphs"))
    for kind in ("pages", "graphs"):
        there = [p.name for p in (tmp_path / kind).rglob("part-*")]
        assert there and all(x.endswith(".gz") for x in there)
    assert [x.id for x in reports.read_pages(spark, str(tmp_path / "pages")).selectExpr("inline(nodes)").collect()] == ["a"]
    assert files.graph_lines(spark, str(tmp_path / "graphs"))[0].first().id == "a"


def test_latex_is_gone_through_once(spark):
    """Sources are cut in one place, all windows have one order, and paths are those of counters kept by hand."""
    r = random.Random(5)
    names = list(latex.LEVELS)
    docs, want = [], {}
    for doc in range(6):
        parts, count, seen, rows, place = [f"Preface of {doc}, which goes on for more than fifty characters in all.\n \n short"] if doc % 2 else [], [0] * 5, False, [], 0
        rows += [("text", [1])] if doc % 2 else []
        for i in range(40):
            if r.random() < 0.4:
                level = r.randint(1, 5)
                parts.append("\\" + names[level - 1] + "{Results " + str(i) + "}")
                count = [*count[: level - 1], count[level - 1] + 1, *[0] * (5 - level)]
                seen, place, top = True, 0, [c for c in count if c]
                rows.append(("heading", top))
            else:
                parts.append(f"Paragraph  {i}\tof\n{doc} goes on  for more than fifty characters in all.")
                place += 1
                rows.append(("text", [*(top if seen else []), place + (0 if seen else doc % 2)]))
        docs.append((doc, "\n\n".join(parts)))
        want[doc] = rows
    out = latex.elements(spark.createDataFrame([*docs, (99, None)], "doc_id long, tex string"))
    got = {}
    for x in sorted(out.collect(), key=lambda x: (x.doc_id, x.place)):
        got.setdefault(x.doc_id, []).append((x.type, list(x.section_path)))
        assert x.place == len(got[x.doc_id]) - 1 and not re.search(r"\s\s|[^\S ]", x.text)
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Generate") == 2


def test_books_are_made_in_one_pass(spark, small, tmp_path, monkeypatch):
    """elements are read once for papers and matches, whose files lie side by side, one for ten papers."""
    from lodegraph.plans import datasets as plans

    made, read = [], []
    elements, folder = plans.elements, plans.folder
    monkeypatch.setattr(plans, "elements", lambda *a: read.append(a) or elements(*a))
    monkeypatch.setattr(plans, "folder", lambda s: made.append(folder(s)) or made[-1])
    plans.paper_questions_mapped(spark, small)
    suppliers = spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("floor(l_suppkey / 10)").distinct().count()
    assert len(read) == 1 and len(made) == 2
    for path in made:
        at = Path(path.removeprefix("file:"))
        assert len(list(at.glob("part-*.txt.gz"))) == suppliers and not [p for p in at.iterdir() if p.is_dir()]
    (tmp_path / "a.json").write_text(json.dumps({"p": {"all_figures": {"x.png": {"caption": "c"}}, "qa": [{"question": "q", "answer": "a", "reference": "x.png"}]}}))
    few, all_ = (datasets.papers(spark, str(tmp_path), figures=f) for f in (False, True))
    assert few.columns == ["doc_id", "qa"] and few.collect() == all_.select("doc_id", "qa").collect()


def test_next_in_a_section_is_sorted_once(spark, small):
    """sections and the edges inside them take one order of a document, besides the one that numbers its lines."""
    from lodegraph.plans import registry

    r = random.Random(2)
    rows = [(d, i, f"{d}.{i}", r.random() < 0.3) for d in (1, 2, None) for i in range(30)]
    d = sections.sessions(spark.createDataFrame(r.sample(rows, len(rows)), "doc_id int, ord int, id string, head boolean"), F.col("head"))
    got = [sections.adjacent(d, by, "n", within=w).select("src", "dst").collect() for by, w in ((["doc_id"], "section"), (["doc_id", "section"], None))]
    assert sorted(got[0]) == sorted(got[1]) == sorted((a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not b[3])
    plan = registry.queries()["reading_next_edges"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 2


@pytest.mark.parametrize("block", [1, 40, 700, 1 << 18])
def test_connected_in_blocks_of_documents(spark, monkeypatch, block):
    """what fits into a block is settled in one shuffle, what does not goes through rounds, with the same result."""
    r, rounds = random.Random(block), papers.connected_in_rounds
    nodes = [(d, f"{d}n{i:03d}") for d in range(6) for i in range(r.choice([1, 30, 300]))] + [(None, "x"), (None, "y"), (7, None), (8, "é"), (8, "z")]
    edges = [(d, f"{d}n{r.randrange(300):03d}", f"{d}n{r.randrange(300):03d}") for d in range(6) for _ in range(200)] + [(None, "x", "y"), (0, "0n000", "1n000"), (8, "z", "é"), (8, None, "z"), (9, "q", "r")]
    root = {n: n[1] for n in nodes}
    for _ in range(300):
        before = dict(root)
        for d, a, b in edges:
            if d is not None and (d, a) in root and (d, b) in root:
                root[d, a] = root[d, b] = min(root[d, a], root[d, b])
        if root == before:
            break
    seen = []
    monkeypatch.setattr(papers, "BLOCK", block)
    monkeypatch.setattr(papers, "connected_in_rounds", lambda n, e: (seen.append(n.count()), rounds(n, e))[1])
    rows, told = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, "50")
    try:
        out = papers.connected(spark.createDataFrame(nodes, "doc_id long, id string"), spark.createDataFrame(edges, "doc_id long, src string, dst string")).collect()
    finally:
        spark.conf.set(rows, told)
    assert sorted(((x.doc_id, x.id), x.component) for x in out if x.id and x.doc_id is not None) == sorted((k, v) for k, v in root.items() if k[0] is not None and k[1])
    assert len(out) == len(nodes) and {x.component for x in out if x.doc_id is None or not x.id} == {"x", "y", None}
    assert (seen[0] > 0) == (block < 700) and seen[0] < len(nodes)


def test_stretches_of_pieces(spark, monkeypatch):
    """places are found all at once, whatever sums collide, and tell the section they are in."""
    r = random.Random(9)
    plain = "".join(r.choices("ab é", k=900))
    heads = {plain[a : a + n] for n in (3, 12) for a in range(0, 800, 7)} | {"".join(r.choices("ab", k=12)) for _ in range(50)}
    for base in (text.BASE, 1):  # with 1 all stretches of the same letters have one sum
        monkeypatch.setattr(text, "BASE", base)
        assert text.first_places(plain, heads) == {h: plain.find(h) for h in heads if h in plain}
    monkeypatch.undo()
    d = spark.createDataFrame([("one two three two", ["two", "three", "one", "none", None, "two thrice"], [1, 4, 4, 9]), (None, ["a"], None)], "t string, x array<string>, s array<bigint>")
    assert [x.i for x in d.select(text.stretch_of_all(F.col("t"), F.col("x"), F.col("s"), 20, 4).alias("i")).collect()] == [[2, 2, None, None, None, 2], [None]]


def test_nodes_of_papers_need_no_places_of_figures(spark):
    """what nodes do not tell is not looked for: texts are gone through once, for paragraphs."""
    f = spark.createDataFrame([("d", 1, "f1", "figure", "Figure 1: a plot of things"), ("e", 1, "f2", "Table", "no label")], "doc_id string, place int, id string, type string, caption string")
    p = spark.createDataFrame([("d", 0, "words of the first part, see Figure 1"), ("d", 1, "nowhere"), ("e", 0, "alone")], "doc_id string, place int, text string")
    t = spark.createDataFrame([("d", "\\section{Intro} words of the first part, see Figure 1 \\section{Method} a plot of things")], "doc_id string, tex string")
    nodes = papers.paper_nodes(f, p, t)
    assert plan_of(nodes).count("ArrowEvalPython") == 1
    both, edges = papers.paper_graph(f, p, t)
    assert sorted(map(tuple, nodes.collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
    assert ("d__sec01", "f1") in {(e.src, e.dst) for e in edges.filter("type = 'contains'").collect()}
