"""Readers of benchmark layouts: elements by line or by page, queries with ground truth, figures of papers, section paths,
page graphs, content lists, LaTeX sources and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text

FLAT = ("doc_id string, eid string, type string, text string, ocr_text string, vlm_text string, page int, bbox_pdf array<double>, "
        "image_b64 string")
PAGE = ("doc_id string, page int, elements array<struct<eid: string, type: string, text: string, bbox_img: array<double>, "
        "bbox_pdf: array<double>>>")
FIGURES = "all_figures: map<string, struct<caption: string, content_type: string>>"
ASKED = "qa: array<struct<question: string, answer: string, reference: variant>>"
PAPERS = f"map<string, struct<{FIGURES}, {ASKED}>>"
CONTENT = ("array<struct<type: string, text_level: int, text: string, page_idx: int, image_caption: array<string>, "
           "table_caption: array<string>>>")
PAGE_GRAPH = ("map<string, struct<nodes: array<string>, edges: array<struct<src: string, dst: string, type: string, "
              "weight: double, confidence: double>>>>")


def some(*columns: str) -> Column:
    """The first of some texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def element_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, doc_id, type, text, page, bbox, has_image) of JSON lines with an element each; a text is the element's own, else
    that of character recognition, else a description, else empty."""
    d = spark.read.schema(FLAT).json(path, mode="DROPMALFORMED")
    return d.select(F.col("eid").alias("id"), "doc_id", "type", F.coalesce(some("text", "ocr_text", "vlm_text"), F.lit("")).alias("text"), "page",
                    F.col("bbox_pdf").alias("bbox"), some("image_b64").isNotNull().alias("has_image"))


def page_lines(spark: SparkSession, path: str, captions_as_text: bool = True) -> DataFrame:
    """(id, doc_id, type, text, page, bbox, ord) of JSON lines with a page each.

    Elements without an id get one from a running number of their document, in the order of pages and of places on them.
    The box is the one in pixels, else the one in points, else zeros; captions count as text.
    """
    d = spark.read.schema(PAGE).json(path, mode="DROPMALFORMED")
    d = d.select("doc_id", "page", F.posexplode("elements").alias("place", "e")).select("doc_id", "page", "place", "e.*")
    w = Window.partitionBy("doc_id").orderBy("page", "place")
    ord_ = F.row_number().over(w) - 1
    number = F.count(F.when(F.col("eid").isNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    made = F.format_string("%s__p%03d__e%04d", "doc_id", "page", number)
    kind = F.when((F.col("type") == "caption") & F.lit(captions_as_text), "text").otherwise(F.coalesce("type", F.lit("text")))
    box = F.coalesce("bbox_img", "bbox_pdf", F.array(*[F.lit(0.0)] * 4))
    return d.select(F.coalesce("eid", made).alias("id"), "doc_id", kind.alias("type"), F.coalesce("text", F.lit("")).alias("text"), "page",
                    box.alias("bbox"), ord_.alias("ord"))


def answered(queries: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Queries (.., gt array) that have ground truth, each of it once; with ``elements``, those whose document is there."""
    d = queries.filter(F.size("gt") > 0).withColumn("gt", F.array_sort(F.array_distinct("gt")))
    return d if elements is None else d.join(elements.select("doc_id").distinct(), "doc_id", "left_semi")


def whole_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """(path, value) of files that are one JSON value each, over however many lines; files that are none are left out."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("value")).filter("value IS NOT NULL")


def papers(spark: SparkSession, path: str, glob: str = "*.json", figures: bool = True) -> DataFrame:
    """(doc_id, all_figures, qa) of files with one object {paper: {all_figures: {file: {caption, content_type}}, qa: [..]}} each.

    Objects become maps of any width, in the order of the file. A question refers to a figure only by a string; a
    reference of another kind, such as a list, is none. Without ``figures`` these are passed over, for readers of questions.
    """
    d = whole_json(spark, path, PAPERS if figures else f"map<string, struct<{ASKED}>>", glob).select(F.explode("value").alias("doc_id", "p"))
    files = lambda: F.transform(F.map_entries("p.all_figures"), lambda e: F.struct(e["key"].alias("file"), e["value"]["caption"].alias("caption"), e["value"]["content_type"].alias("content_type")))
    one = lambda r: F.when(F.schema_of_variant(r) == "STRING", F.variant_get(r, "$", "string"))
    asked = F.transform("p.qa", lambda q: F.struct(q["question"].alias("question"), q["answer"].alias("answer"), one(q["reference"]).alias("reference")))
    return d.select("doc_id", *([files().alias("all_figures")] if figures else []), asked.alias("qa"))


def paper_figures(papers: DataFrame) -> DataFrame:
    """(doc_id, ord, id, type, caption) of the figures and tables of papers, in their order."""
    d = papers.select("doc_id", F.posexplode("all_figures").alias("ord", "f"))
    return d.select("doc_id", "ord", F.col("f.file").alias("id"), F.coalesce("f.content_type", F.lit("figure")).alias("type"),
                    F.coalesce("f.caption", F.lit("")).alias("caption"))


def paper_questions(papers: DataFrame, name: str = "%s_q%d") -> DataFrame:
    """(qid, doc_id, query, answer, reference) of the questions of papers; ``name`` makes a qid of paper and place, from 0."""
    d = papers.select("doc_id", F.posexplode("qa").alias("i", "q"))
    return d.select(F.format_string(name, "doc_id", "i").alias("qid"), "doc_id", F.col("q.question").alias("query"),
                    F.col("q.answer").alias("answer"), F.col("q.reference").alias("reference"))


def referring_questions(papers: DataFrame) -> DataFrame:
    """(qid, doc_id, query, answer, gt): questions that refer to a figure, which is their ground truth."""
    d = paper_questions(papers).filter("reference IS NOT NULL")
    return d.select("qid", "doc_id", "query", "answer", F.array("reference").alias("gt"))


def figure_mapping(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, id) of files with one object {file: {eid: id, ..}} each: the elements that figures were matched to."""
    d = whole_json(spark, path, "map<string, struct<eid: string>>", glob).select(F.explode("value").alias("file", "m"))
    return d.select("file", F.col("m.eid").alias("id")).filter("id IS NOT NULL")


#: How questions of papers whose figures were matched to elements are named.
MAPPED = "spiqa_%s_%02d"


def mapped_questions(questions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Questions whose figure (file) was matched to an element (id): the element is their ground truth; others go."""
    m = mapping.select(F.col("file").alias("reference"), F.array("id").alias("gt"))
    return questions.join(m, "reference").select("qid", "doc_id", "query", "answer", "gt")


def figure_pool(papers: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, type, text): figures with their captions and, if they are given, paragraphs (doc_id, place, text)."""
    d = paper_figures(papers).select("doc_id", "id", "type", F.col("caption").alias("text"))
    if paragraphs is None:
        return d
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    p = paragraphs.select("doc_id", F.format_string("%s__para%03d", "doc_id", number).alias("id"), F.lit("text").alias("type"), "text")
    return d.unionByName(p)


def whole_texts(spark: SparkSession, *folders: str, suffix: str = ".tex") -> DataFrame:
    """(doc_id, text) of files that are named after their document; of the folders that are there the first that has it."""
    out = None
    for i, folder in enumerate(folders):
        if not exists(spark, folder):
            continue
        d = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
        name = F.substring_index(F.col("_metadata.file_name"), suffix, 1)
        d = d.select(name.alias("doc_id"), F.col("value").alias("text"), F.lit(i).alias("i"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], "doc_id string, text string")
    return out.groupBy("doc_id").agg(F.min_by("text", "i").alias("text"))


def paragraph_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(doc_id, place, text): trimmed paragraphs that are not empty, numbered as they are left."""
    d = whole_texts(spark, *folders, suffix=".txt").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "text"))
    d = d.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")
    return d.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("place"), "text")


def section_path_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, id, section_path) of JSON objects {doc_id: {id: path}}, one object a line."""
    d = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, map<string, array<int>>>")).alias("doc_id", "m"))
    return d.select("doc_id", F.explode("m").alias("id", "section_path"))


def page_graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON objects {doc_id: {nodes: ids, edges}}, one object a line: the older layout of graphs."""
    d = spark.read.text(path).select(F.explode(F.from_json("value", PAGE_GRAPH)).alias("doc_id", "g"))
    nodes = d.select("doc_id", F.posexplode("g.nodes").alias("ord", "id"))
    return nodes, d.select("doc_id", F.posexplode("g.edges").alias("ord", "e")).select("doc_id", "ord", "e.*")


def content_list(spark: SparkSession, path: str, figures: DataFrame | None = None, name: str = r"([^/]+)_content_list\.json$", glob: str = "*_content_list.json") -> DataFrame:
    """(doc_id, id, type, section_path, section_role, page, label, file) of files with one JSON array of entries each, anywhere
    below ``path``; ``name`` finds a file's document in its path.

    A text with a level is a heading: a path of ones, an entry deeper than the last one's at most; its role counts down to
    the next heading of level one or two. Other texts, images and tables are elements; their path ends with their place
    behind the heading. ``figures`` (doc_id, ord, id, caption) give the first file whose caption has an element's label.
    """
    d = whole_json(spark, path, CONTENT, glob).select(F.regexp_extract("path", name, 1).alias("doc_id"), F.posexplode("value").alias("at", "e"))
    d = d.filter("doc_id <> ''").select("doc_id", "at", "e.*")
    head = (F.col("type") == "text") & F.col("text_level").isNotNull()
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.filter(head | F.col("type").isin("text", "image", "table"))
    d = d.withColumns({"head": head, "heads": F.count(F.when(head, 1)).over(w)})
    # The k-th heading's path has min(level, one more than the last path) entries: the least of level - k so far, plus k.
    d = d.withColumn("low", F.min(F.when(F.col("head"), F.col("text_level") - F.col("heads"))).over(w))
    d = d.withColumn("depth", F.coalesce(F.least("heads", F.col("low") + F.col("heads")), F.lit(0)))
    own = F.when(head & (F.col("text_level") <= 2), text.role(F.col("text"), text.ROLES_CONTENT_LIST, normalise=False))
    d = d.withColumn("section_role", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("other"))).filter("NOT head")
    place = F.row_number().over(Window.partitionBy("doc_id", "heads").orderBy("at"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    caption = F.coalesce(F.get(F.when(F.col("type") == "image", F.col("image_caption")).otherwise(F.col("table_caption")), F.lit(0)), F.lit(""))
    d = d.withColumns({
        "id": F.format_string("%s__%s_%03d", "doc_id", F.when(F.col("type") == "text", "para").otherwise(F.col("type")), number),
        "section_path": F.concat(F.array_repeat(F.lit(1), F.col("depth").cast("int")), F.array(place)),
        "label": F.when(F.col("type") != "text", text.inline_label(caption)), "page": F.coalesce("page_idx", F.lit(-1)),
        "type": F.when(F.col("type") == "image", "figure").otherwise(F.col("type")),
    })
    if figures is None:
        d = d.withColumn("file", F.lit(None).cast("string"))
    else:
        d = d.join(labelled_files(figures), ["doc_id", "label"], "left")
    return d.select("doc_id", "id", "type", "section_path", "section_role", "page", "label", "file")


def labelled_files(figures: DataFrame) -> DataFrame:
    """(doc_id, label, file): the first file whose caption names a label anywhere."""
    d = figures.select("doc_id", text.inline_label(F.col("caption")).alias("label"), "id", "ord").filter("label IS NOT NULL")
    return d.groupBy("doc_id", "label").agg(F.min_by("id", "ord").alias("file"))


def run_results(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """(row_id, dataset, variant, metric, value) of ``eval.json`` files in folders that are named after rows.

    A folder belongs to the longest of ``rows`` (row_id) that is its name or stands in front of an underscore; without one,
    to what stands before its first underscore. Files that are no JSON are left out.
    """
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "eval.json").text(path, wholetext=True)
    kind = "struct<results: map<string, map<string, map<string, double>>>>"
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    d = d.select(folder.alias("folder"), F.from_json("value", kind).alias("x")).filter("x.results IS NOT NULL")
    heads = d.select("folder", F.explode(F.sequence(F.lit(1), F.size(F.split("folder", "_")))).alias("k"))
    heads = heads.withColumn("row_id", F.expr("substring_index(folder, '_', k)"))
    best = heads.join(rows.select("row_id").distinct(), "row_id").groupBy("folder").agg(F.max_by("row_id", "k").alias("row_id"))
    d = d.join(best, "folder", "left").withColumn("row_id", F.coalesce("row_id", F.expr("substring_index(folder, '_', 1)")))
    d = d.select("row_id", F.explode("x.results").alias("dataset", "a")).select("row_id", "dataset", F.explode("a").alias("variant", "b"))
    return d.select("row_id", "dataset", "variant", F.explode("b").alias("metric", "value")).filter("metric <> 'n_queries' AND value IS NOT NULL")


def study_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the JSON files of a folder, but for its summary; files that are no JSON are left out."""
    d = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).filter("_metadata.file_name <> 'summary.json'")
    d = d.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"))
    return d.filter(F.size(F.filter(F.array(*[F.col(f"x.{f}").isNotNull() for f in d.schema["x"].dataType.names]), lambda y: y)) > 0).select("file", "x.*")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of some paths that is there, on whatever file system it names; the last if none is."""
    return next((p for p in paths if exists(spark, p)), paths[-1])


def missing_files(spark: SparkSession, *paths: str) -> list[str]:
    return [p for p in paths if not exists(spark, p)]
