"""Sections from reading order: headers open groups, groups merge, levels give paths. All are windows over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from ..schema import ELEMENT_TYPES, SECTION_ROLES


def _order(*by: str, at: str = "ord"):
    return Window.partitionBy(*by).orderBy(at)


def _upto(*by: str, at: str = "ord"):
    return _order(*by, at=at).rowsBetween(Window.unboundedPreceding, 0)


def sessions(elements: DataFrame, header: Column) -> DataFrame:
    """``section``: headers so far in the document; 0 before the first one."""
    return elements.withColumn("section", F.sum(header.cast("int")).over(_upto("doc_id")))


def merged(elements: DataFrame, least: int = 8) -> DataFrame:
    """``kept_section``: sections of fewer than ``least`` elements join the last larger one before them (or the first).

    All are windows inside a document, the first of them over it, so rows stay where it lies.
    """
    d = elements.filter("doc_id IS NOT NULL AND section IS NOT NULL")
    d = d.withColumn("mg_first", F.min("section").over(Window.partitionBy("doc_id")))
    d = d.withColumn("mg_size", F.count("*").over(Window.partitionBy("doc_id", "section")))
    own = F.when((F.col("section") == F.col("mg_first")) | (F.col("mg_size") >= least), F.col("section"))
    return d.withColumn("kept_section", F.last(own, ignorenulls=True).over(_upto("doc_id", at="section"))).drop("mg_first", "mg_size")


def paths(headers: DataFrame, depth: int = 4, compat: bool = False) -> DataFrame:
    """``path`` of headers with a ``level``: counters of each level so far, restarted by every higher header.

    Rows without a level have an empty one. With ``compat`` every counter that was opened reads 1, as in extractors that drop a
    level before they read it. A counter is what a level has so far, less what it had at the last higher header, so all windows
    have one order.
    """
    level, w = F.col("level"), _upto("doc_id")
    d = headers.withColumns({f"total{n}": F.sum((level == n).cast("int")).over(w) for n in range(1, depth + 1)})
    higher = {f"before{n}": F.last(F.when(level < n, F.col(f"total{n}")), ignorenulls=True).over(w) for n in range(1, depth + 1)}
    d = d.withColumns(higher)
    count = lambda n: F.col(f"total{n}") - F.coalesce(f"before{n}", F.lit(0))
    read = lambda n: F.when((level >= n) & (count(n) > 0), F.lit(1) if compat else count(n)).cast("int")
    d = d.withColumn("path", F.filter(F.array(*[read(n) for n in range(1, depth + 1)]), lambda x: x.isNotNull()))
    return d.drop(*[f"{k}{n}" for n in range(1, depth + 1) for k in ("total", "before")])


def place_in_section(elements: DataFrame) -> DataFrame:
    """``place``: 1 for the first element of a section."""
    return elements.withColumn("place", F.row_number().over(_order("doc_id", "section")))


def inner_place(elements: DataFrame) -> DataFrame:
    """``intra_pos``: place from 0 over size; paragraphs first, by the number that their id tells, then the others in order."""
    d = elements.withColumn("ip_number", text.paragraph_number(F.col("id")))
    w = Window.partitionBy("doc_id", "section").orderBy(F.asc_nulls_last("ip_number"), "ord")
    size = F.count("*").over(Window.partitionBy("doc_id", "section"))
    return d.withColumn("intra_pos", (F.row_number().over(w) - 1) / size).drop("ip_number")


def node_features(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ELEMENT_TYPES, roles: tuple[str, ...] = SECTION_ROLES) -> DataFrame:
    """(doc_id, id, type_id, role_id, depth, intra_pos) of all nodes (doc_id, id, type, section_role, section_path) of graphs.

    ``edges`` is (doc_id, ord, src, dst, type). What a header ``contains`` is its section, whichever end the header is, and is placed
    by ``inner_place``; what none contains stands at 0. A node without a role takes that of the first section that has it, and stands
    in the last one; sections are in the order of their first edges. Depth is the length of the section's path, 1 where there is none.
    """
    end = lambda k: nodes.select("doc_id", F.col("id").alias(k), F.col("type").alias(f"{k}_type"), F.col("section_role").alias(f"{k}_role"))
    d = edges.filter("type = 'contains'").select("doc_id", "ord", "src", "dst").join(end("src"), ["doc_id", "src"]).join(end("dst"), ["doc_id", "dst"])
    forth, back = (F.coalesce(F.col(f"{k}_type") == "section_header", F.lit(False)) for k in ("src", "dst"))
    told = lambda a, b: F.when(forth, F.col(a)).otherwise(F.col(b))
    d = d.filter(forth | back).select("doc_id", "ord", told("src", "dst").alias("section"), told("dst", "src").alias("id"),
                                      F.coalesce(F.nullif(told("src_role", "dst_role"), F.lit("")), F.lit("other")).alias("inherited"))
    d = inner_place(d).withColumn("turn", F.min("ord").over(Window.partitionBy("doc_id", "section")))
    d = d.groupBy("doc_id", "id").agg(F.max_by("intra_pos", F.struct("turn", "intra_pos")).alias("intra_pos"), F.min_by("inherited", "turn").alias("inherited"))
    role = F.coalesce(F.nullif("section_role", F.lit("")), "inherited", F.lit("other"))
    depth = F.when(F.size("section_path") > 0, F.size("section_path").cast("double")).otherwise(1.0)
    return nodes.join(d, ["doc_id", "id"], "left").select(
        "doc_id", "id", text.number_of(F.coalesce("type", F.lit("text")), types, "text").alias("type_id"),
        text.number_of(role, roles, "other").alias("role_id"), depth.alias("depth"), F.coalesce("intra_pos", F.lit(0.0)).alias("intra_pos"))


def inherited_role(elements: DataFrame) -> DataFrame:
    """``inherited``: the role of the last header of level 1 or 2 so far."""
    own = F.when(F.col("level") <= 2, F.col("role"))
    return elements.withColumn("inherited", F.last(own, ignorenulls=True).over(_upto("doc_id")))


def adjacent(elements: DataFrame, by: list[str], kind: str, confidence: float = 1.0, both: bool = False, within: str | None = None) -> DataFrame:
    """Edges from each element to the next one within ``by``, where both have the same ``within`` if that is given.

    Values of ``within`` are runs in the order of ``ord``, as sections are: its rows are then not sorted apart from those of ``by``.
    """
    w = Window.partitionBy(*by).orderBy("ord")
    nxt = F.lead("id").over(w)
    if within is not None:
        nxt = F.when(F.lead(within).over(w).eqNullSafe(F.col(within)), nxt)
    d = elements.withColumn("dst", nxt).filter("dst IS NOT NULL")
    return d.select("doc_id", F.col("id").alias("src"), "dst", F.lit(kind).alias("type"),
                    F.lit(confidence).alias("confidence"), F.lit(both).alias("bidirectional"))


def running_ids(elements: DataFrame, by: str = "doc_id") -> DataFrame:
    """``eid``: the document and a running number of four digits, from 0."""
    n = F.row_number().over(_order(by)) - 1
    return elements.withColumn("eid", F.concat(F.col(by).cast("string"), F.lit("__e"), F.lpad(n.cast("string"), 4, "0")))


def pending_captions(elements: DataFrame) -> DataFrame:
    """``caption``: for a visual, the last caption on its page, unless a visual between them took it."""
    visual = F.col("type").isin("figure", "table")
    marks = elements.filter(visual | (F.col("type") == "caption"))
    w = _order("doc_id", "page")
    before, text = F.lag("type").over(w), F.lag("id").over(w)
    return marks.withColumn("caption", F.when(before == "caption", text)).filter(visual).select("doc_id", "id", "caption")


def last_header(header: Column, value: str) -> Column:
    """As-of: the value of the latest header at or before each element."""
    return F.last(F.when(header, F.col(value)), ignorenulls=True).over(_upto("doc_id"))


def filled(value: str) -> Column:
    """The nearest earlier value, else the nearest later one."""
    w = _order("doc_id")
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead)


def plurality(d: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; the one seen first among equals."""
    n = d.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "seen")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, value, "n")


def numbered_paths(elements: DataFrame, number: Column, keyword: Column) -> DataFrame:
    """``path``: for a header the section it opens, for any other element the section it is in and its place there, from 1.

    ``number`` is the array of a numbered header, null for others; ``keyword`` tells headers without a number. A numbered
    header is its own path, whatever stood before it. A keyword header is a section of the top level, one after the last: the
    first number of the last numbered header, if any, plus the keyword headers since. Before the first header the place alone
    is the path. Elements are in the order of ``ord``.
    """
    word = keyword & number.isNull()
    d = elements.withColumns({"np_number": number, "np_word": F.coalesce(word, F.lit(False))})
    header = F.col("np_number").isNotNull() | F.col("np_word")
    d = d.withColumns({
        "np_last": F.last("np_number", ignorenulls=True).over(_upto("doc_id")),
        "np_run": F.sum(F.col("np_number").isNotNull().cast("int")).over(_upto("doc_id")),
        "np_section": F.sum(header.cast("int")).over(_upto("doc_id")),
    })
    d = d.withColumn("np_since", F.sum(F.col("np_word").cast("int")).over(_upto("doc_id", "np_run")))
    top = F.coalesce(F.get("np_last", F.lit(0)), F.lit(0)) + F.col("np_since")
    section = F.when(F.col("np_since") > 0, F.array(top.cast("int"))).otherwise(F.coalesce("np_last", F.array().cast("array<int>")))
    place = F.row_number().over(_order("doc_id", "np_section")) - F.when(F.col("np_section") > 0, 1).otherwise(0)
    path = F.when(header, section).otherwise(F.concat(section, F.array(place)))
    return d.withColumn("path", path).drop("np_number", "np_word", "np_last", "np_run", "np_section", "np_since")
