"""The data model: element kinds, roles, edge kinds and the one table of edge weights."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
ELEMENT_TYPES = ("text", "figure", "table", "caption", "equation", "section_header")
SECTION_ROLES = ("intro", "related_work", "method", "result", "discussion", "conclusion", "appendix", "references",
                 "front_matter", "other")
EDGE_WEIGHTS = {"caption_of": 1.0, "refer_to": 0.8, "contains": 0.5, "reading_next": 0.3, "section_next": 0.2}
ROLE_MODIFIERS = {"appendix": 1.3, "front_matter": 0.8, "references": 0.5}
VISUAL_MODIFIER = 1.1
VISUAL_TYPES = ("figure", "table", "equation")
WEIGHT_MODES = ("uniform", "base", "base+role", "base+visual", "full")
MASKED_SCORE = -1e4
RRF_CONSTANT = 60
SHORTLIST = 50

BBOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x0", "y0", "x1", "y1")])


def _fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def node_schema() -> T.StructType:
    return _fields("id string, type string, page int, section_path array<int>, section_role string, label string")


def edge_schema() -> T.StructType:
    return _fields("src string, dst string, type string, confidence double, bidirectional boolean, evidence string")


#: A corpus graph file: {doc_id: graph}.
GRAPH_FILE = (
    "map<string, struct<doc_id: string, schema_version: string, "
    "nodes: array<struct<id: string, type: string, page: int, section_path: array<int>, section_role: string, label: string>>, "
    "edges: array<struct<src: string, dst: string, type: string, confidence: double, bidirectional: boolean, evidence: string>>>>"
)
ELEMENT_ROW = (
    "doc_id string, id string, type string, text string, page int, bbox_pdf array<double>, label string, "
    "section_role string, section_path array<int>, section_title string, image_path string"
)
