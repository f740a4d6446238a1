"""How queries are registered, and the driver's tables as inputs of the library.

The inputs below are stated once as SQL that both engines read: Spark through ``spark.sql`` and the SQL of a query
through a WITH clause. What queries do with them is written twice, as operators and as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import deal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Derived inputs by name; each may use tables and inputs named before it.
INPUTS = {
    # Token vectors: documents of a hundred, modality by label. Queries are the vectors whose id is divisible by 50, asked
    # of their own document; both grow with the table.
    "vec": """SELECT vec_id AS id, CAST(floor(vec_id / 100) AS BIGINT) AS doc_id, embedding AS v, label,
        CASE WHEN label % 2 = 0 THEN 'text' ELSE 'visual' END AS modality,
        CASE WHEN label % 5 = 0 THEN 'figure' WHEN label % 5 = 1 THEN 'table' WHEN label % 5 = 2 THEN 'caption' ELSE 'text' END AS type,
        CASE WHEN vec_id % 7 = 0 THEN 'appendix' WHEN vec_id % 7 = 1 THEN 'references' WHEN vec_id % 7 = 2 THEN 'front_matter'
             ELSE 'method' END AS section_role FROM embeddings""",
    "ask": "SELECT id AS qid, doc_id, v AS q, label AS q_label FROM vec WHERE id % 50 = 0",
    # Edges between vectors of a document.
    "edge": """SELECT doc_id, id AS src, id + 5 AS dst, 'reading_next' AS type, 1.0 AS confidence, false AS bidirectional FROM vec
        UNION ALL SELECT doc_id, id, id + 35, 'refer_to', 0.9, false FROM vec WHERE id % 3 = 0
        UNION ALL SELECT doc_id, id, id + 10, 'caption_of', 0.5 + (id % 4) * 0.1, true FROM vec WHERE id % 4 = 0
        UNION ALL SELECT doc_id, id + 15, id, 'refer_to', 0.8, true FROM vec WHERE id % 6 = 0
        UNION ALL SELECT doc_id, id, id + 20, 'contains', 1.0, false FROM vec WHERE id % 11 = 0""",
    # Elements: suppliers as documents, lines in order.
    "line": """SELECT l_suppkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
        l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS ord, CAST(l_quantity AS INT) AS q,
        CAST(l_partkey AS INT) AS p, l_returnflag AS f, l_linestatus AS s, CAST(l_linenumber AS INT) AS n,
        l_extendedprice AS price FROM lineitem""",
    "element": """SELECT doc_id, ord, CAST(floor((ord - 1) / 20) AS INT) AS page, q, p, n, price,
        concat(CAST(doc_id AS STRING), '__p', lpad(CAST(CAST(floor((ord - 1) / 20) AS INT) AS STRING), 3, '0'), '__e', lpad(CAST(ord AS STRING), 4, '0')) AS id,
        CASE WHEN n % 4 = 1 AND q > 25 THEN 'section_header' WHEN f = 'A' AND q % 2 = 0 THEN 'figure' WHEN f = 'A' THEN 'table'
             WHEN f = 'R' AND q % 3 = 0 THEN 'caption' ELSE 'text' END AS type,
        CASE WHEN q % 5 < 2 THEN 1 WHEN q % 5 < 4 THEN 2 ELSE 3 END AS level,
        CASE p % 9 WHEN 0 THEN '1 Introduction' WHEN 1 THEN '2.1 Related Work' WHEN 2 THEN 'Sec. 3.4 The Model' WHEN 3 THEN 'A. Results'
             WHEN 4 THEN 'I N TRO DUCT ION' WHEN 5 THEN 'Conclusion' WHEN 6 THEN 'Appendix B' WHEN 7 THEN 'References' ELSE 'Other things' END AS title,
        concat(CASE p % 6 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Fig. ' WHEN 2 THEN 'Table ' WHEN 3 THEN 'tab. ' WHEN 4 THEN 'Algorithm ' ELSE 'the ' END,
               CAST(q % 12 AS STRING), CASE WHEN p % 4 = 0 THEN ': a caption' WHEN p % 4 = 1 THEN '. text' ELSE ' see' END) AS caption,
        concat('As shown in Figure ', CAST(q % 12 AS STRING), ' and [', CAST(p % 9 AS STRING), '] Table ', CAST(p % 12 AS STRING),
               CASE WHEN p % 3 = 0 THEN concat(', Fig. ', CAST(q % 12 AS STRING)) ELSE '' END, '. Eq. ', CAST(n AS STRING)) AS body,
        CAST(p % 400 AS DOUBLE) AS x0, CAST(((ord - 1) % 20) * 40 + q AS DOUBLE) AS y0,
        CAST(p % 400 + 50 + q AS DOUBLE) AS x1, CAST(((ord - 1) % 20) * 40 + 30 + 2 * q AS DOUBLE) AS y1 FROM line""",
    "truth": """SELECT doc_id, ord AS gt_ord, concat('gt', id) AS gt_id, page, x0 - 8 AS gx0, y0 - 5 AS gy0, x1 + n AS gx1, y1 + n AS gy1
        FROM element WHERE p % 5 = 0""",
    # Scores of candidates with graded relevance.
    "graded": """SELECT id % 50 AS anchor, id, (id * 37 % 101) / 25.0 AS s, (id * 53 % 97) / 25.0 AS dropped,
        CASE id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END AS rel FROM vec""",
    # Runs: steps with values by kind.
    "run": """SELECT event_type AS metric, CAST(user_id % 10 AS INT) AS qid, CAST(event_id AS INT) + 1 AS step, value,
        CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS row_id FROM events""",
}


def _needs(sql: str) -> list[str]:
    """Names of inputs in some SQL, with those that they use, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in INPUTS:
            if name not in found and re.search(rf"\b{name}\b(?!\.)", re.sub(r"'[^']*'", "", text)):
                found.add(name)
                todo.append(INPUTS[name])
    return [n for n in INPUTS if n in found]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or an input made from its tables."""
    if name not in INPUTS:
        path = f"{sf_dir}/{name}.parquet"
        deal(spark, path)
        return spark.read.parquet(path)
    text = INPUTS[name]
    used = [n for n in (*INPUTS, "embeddings", "lineitem", "events") if n != name and re.search(rf"\b(?:FROM|JOIN) {n}\b", text)]
    for n in used:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **{n: source(spark, sf_dir, n) for n in used})


def full_sql(sql: str) -> str:
    """SQL for DuckDB: the inputs that it names go before it."""
    parts = [f"{n} AS ({INPUTS[n]})" for n in _needs(sql)]
    if sql.lstrip().startswith("WITH RECURSIVE"):
        return sql.replace("WITH RECURSIVE", f"WITH RECURSIVE {', '.join(parts)},", 1)
    rest = re.sub(r"^\s*WITH\s+", ", " if parts else "WITH ", sql)
    if not parts:
        return sql
    if rest == sql:
        return f"WITH {', '.join(parts)} {sql}"
    return f"WITH {', '.join(parts)}{rest}"


def query(sql: str | None = None, name: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = full_sql(sql)
        return f

    return add
