"""LaTeX sources as elements: headings, figures, tables and paragraphs, in the order of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from . import sections

# Depth of headings, and the least length of a paragraph.
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
LEAST = 50
# A braced argument may hold one more level of braces; commands of headings, environments and captions.
ARGUMENT = r"\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
HEADING = r"\\((?:sub){0,2}section|paragraph|subparagraph)\*?\s*" + ARGUMENT
FLOAT = r"\\begin\{(figure|table)\*?\}"
LABEL = r"\\label\{([^}]+)\}"
MARK = rf"(?s)(?:{HEADING}|{FLOAT}.*?\\end\{{\3\*?\}})"


def elements(tex: DataFrame) -> DataFrame:
    """(doc_id, place, type, text, label, level, section_path, section_role) of sources (doc_id, tex).

    A source is cut at its headings and floats; what lies between two of these is paragraphs, and those under fifty characters
    are left out, so is a float that does not end, whose text is then paragraphs. Paths are counters of levels, with the
    place in the section behind them for what is no heading; roles are those of top-level headings. Null has no element.
    """
    d = tex.select("doc_id", F.posexplode(F.arrays_zip(F.split("tex", MARK).alias("gap"), F.regexp_extract_all("tex", F.lit(MARK), F.lit(0)).alias("mark"))).alias("i", "z"))
    piece = lambda part, mark: F.struct(part.cast("string").alias("part"), mark.cast("string").alias("mark"))
    parts = F.transform(F.split("z.gap", r"\n\s*\n"), lambda x: piece(x, F.lit(None)))
    d = d.select("doc_id", "i", F.posexplode(F.concat(parts, F.array(piece(F.lit(None), F.col("z.mark"))))).alias("j", "x"))
    # White space is one space each; runs that are that already are not touched.
    d = d.select("doc_id", (F.col("i").cast("long") * (1 << 32) + F.col("j")).alias("ord"), F.col("x.mark").alias("mark"),
                 F.trim(F.regexp_replace("x.part", r" \s+|[^\S ]\s*", " ")).alias("said")).filter(f"mark IS NOT NULL OR length(said) >= {LEAST}")
    mark = F.col("mark")
    found = lambda p, g: F.nullif(F.regexp_extract(mark, p, g), F.lit(""))
    d = d.withColumns({"kind": found("^" + FLOAT, 1), "prose": mark.isNull()})
    d = d.withColumns({"head": F.when(F.col("kind").isNull(), found(HEADING, 1)), "inner": F.when(F.col("kind").isNull(), F.regexp_extract(mark, HEADING, 2)).otherwise(F.regexp_extract(mark, rf"(?s)\\caption{ARGUMENT}", 1))})
    d = d.withColumn("level", F.coalesce(*[F.when(F.col("head") == name, depth) for name, depth in LEVELS.items()]))
    rows = d.select(
        "doc_id", "ord", F.when(F.col("prose"), "text").otherwise(F.coalesce("kind", F.lit("heading"))).alias("type"),
        F.when(F.col("prose"), F.col("said")).otherwise(text.normal_caption(F.col("inner"), formatting=True)).alias("text"),
        F.when(F.col("kind").isNotNull(), found(LABEL, 1)).alias("label"), "level",
        F.when(F.col("level") == 1, text.role(F.col("inner"), text.ROLES_LATEX, normalise=False)).alias("role"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = sections.paths(rows.withColumn("number", F.row_number().over(w)), depth=len(LEVELS))
    header = F.col("level").isNotNull()
    above = lambda c: F.last(F.when(header, F.col(c)), ignorenulls=True).over(upto)
    rows = rows.withColumns({"section_role": F.coalesce(F.last("role", ignorenulls=True).over(upto), F.lit("other")), "at": F.coalesce(above("number"), F.lit(0)),
                             "path": F.coalesce(above("path"), F.array().cast("array<int>"))})
    path = F.when(header, F.col("path")).otherwise(F.concat("path", F.array(F.col("number") - F.col("at"))))
    return rows.select("doc_id", (F.col("number") - 1).alias("place"), "type", "text", "label", "level", path.alias("section_path"), "section_role")
