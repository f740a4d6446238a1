"""Elements out of plain text and HTML held in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs(df: DataFrame, key: str, column: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, place, text): the trimmed paragraphs of a text that are not empty, with their places from 0."""
    d = df.select(key, F.posexplode(F.split(column, separator)).alias("place", "text"))
    return d.withColumn("text", F.trim("text")).filter("text <> ''")


def html_elements(df: DataFrame, key: str, column: str = "html", tags: tuple[str, ...] = ("h1", "p", "li")) -> DataFrame:
    """(key, place, type, text): what follows each opening tag of some kinds, up to the next tag of any kind.

    Pages close few of their tags, so tags are not paired. Headings are section headers, all else is text.
    """
    pattern = F.lit(f"<({'|'.join(tags)})>([^<]*)")
    kinds, bodies = (F.regexp_extract_all(column, pattern, F.lit(i)) for i in (1, 2))
    d = df.select(key, F.posexplode(F.arrays_zip(kinds.alias("tag"), bodies.alias("text"))).alias("place", "x"))
    kind = F.when(F.col("x.tag").rlike("^h[1-6]$"), "section_header").otherwise("text")
    return d.select(key, "place", kind.alias("type"), "x.text")
