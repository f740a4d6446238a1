"""Secret scans: patterns, and parts of credentials that only count where their complement stands near."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, documents, scanned, without

SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Kind, pattern, group that the length is of, least length; in the order in which ties of a start are listed.
BASE = (("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Weak parts: alone they are no secret.
PARTS = (
    ("ident", r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 3),
    ("endpoint", r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, 4),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
#: What a weak part needs within its scope.
NEEDS = {"ident": ("opaque", "hex"), "endpoint": ("opaque", "hex", "assign"), "opaque": ("access", "ident", "endpoint")}


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost, non-overlapping matches whose group is long enough, with their code points.

    The gaps between matches (split) and the matches lie in turn, so running sums of lengths place them.
    """
    none = F.array().cast(SPANS)
    length = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    found = length(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = F.arrays_zip(length(F.split(text, pattern)).alias("gap"), found.alias("n"),
                        length(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("size"))
    rows = F.filter(rows, lambda z: z["n"].isNotNull())

    def placed(z: Column) -> Column:
        ends = scanned(F.transform(z, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return F.transform(F.arrays_zip(z.alias("z"), ends.alias("end")), lambda x: F.struct(
            (x["end"] - x["z"]["n"]).alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), (x["z"]["size"] >= least).alias("ok")))

    out = bound(rows, placed)
    out = F.transform(F.filter(out, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"], x["kind"]))
    return F.when(F.rlike(text, F.lit(pattern)), out.cast(SPANS)).otherwise(none)


def linked(told: str, scope: int) -> Column:
    """Of all spans, in the order of their starts, those that count: base ones, and weak parts near a complement.

    ``told`` names the array of (start, place, end, kind). What a part is near to begins before it, and then the furthest
    end so far of that kind reaches into its scope, or after it, and then the next start of that kind does. Both are running
    values of the sorted array, so the join is a merge: its work is n log n, whatever the spans are.
    """
    kinds = [k[0] for k in (*BASE, *PARTS)]
    far = 1 << 60
    ends = lambda x: F.struct(*[F.when(x["kind"] == k, x["end"]).otherwise(-far).alias(k) for k in kinds])
    starts = lambda x: F.struct(*[F.when(x["kind"] == k, x["start"]).otherwise(far).alias(k) for k in kinds])
    most = lambda a, b: F.struct(*[F.greatest(a[k], b[k]).alias(k) for k in kinds])
    least = lambda a, b: F.struct(*[F.least(a[k], b[k]).alias(k) for k in kinds])
    before = scanned(F.transform(told, ends), most)
    after = F.reverse(scanned(F.reverse(F.transform(told, starts)), least))
    rows = F.arrays_zip(F.col(told).alias("s"), before.alias("b"), after.alias("a"))

    def near(r: Column, kind: str) -> Column:
        return (r["b"][kind] >= r["s"]["start"] - scope) | (r["a"][kind] <= r["s"]["end"] + scope)

    def counts(r: Column) -> Column:
        out = r["s"]["kind"].isin(*[k[0] for k in BASE])
        for part, needs in NEEDS.items():
            # Neighbours are of other kinds than the part, so a part is never its own complement.
            out = out | (r["s"]["kind"] == part) & reduce(lambda x, y: x | y, [near(r, k) for k in needs])
        return out

    return F.transform(F.filter(rows, counts), lambda r: r["s"])


def find_secrets(docs: DataFrame, scope: int = 160) -> DataFrame:
    """Documents with ``base_spans`` and ``secret_spans``: arrays of (start, end, kind), by start, then kind as listed.

    ``secret_spans`` holds the base spans and the weak parts (identifiers, endpoints, opaque strings) that stand within
    ``scope`` code points of a complementary part: an interval join inside each text. A weak part that overlaps a base
    span is part of it and not told again. Everything happens in the row of a document, in n log n of its spans: there is
    no shuffle.

    Null text is empty and has no span. Rows that repeat are scanned each; extra columns stay, those named like an
    output are replaced. Spans that start at one place stand in the order of their kinds. An empty table gives an empty
    table. A very long text is one value of its row, as it is in the table.
    """
    d = without(docs, "base_spans", "secret_spans").withColumn("ss_text", F.coalesce("text", F.lit("")))
    kinds = [k[0] for k in BASE]
    every = (*kinds, *(p[0] for p in PARTS))
    d = d.withColumns({f"ss_{k[0]}": spans(F.col("ss_text"), *k) for k in (*BASE, *PARTS)})
    place = lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in every]), s["kind"]).alias("place"),
        s["end"].alias("end"), s["kind"].alias("kind"),
    )
    back = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["end"], s["kind"])).cast(SPANS)
    merged = lambda *names: F.sort_array(F.transform(F.concat(*names), place))
    d = d.withColumn("ss_base", merged(*[f"ss_{k}" for k in kinds])).withColumn("base_spans", back(F.col("ss_base")))
    weak = F.concat(*[f"ss_{p[0]}" for p in PARTS])
    d = d.withColumn("ss_all", F.when(F.size(weak) > 0, merged(*[f"ss_{k}" for k in every])))
    # A weak part is clear of base spans if those before it end before it starts and the next starts behind its end.
    of_base = lambda x: x["kind"].isin(*kinds)
    before = scanned(F.transform("ss_all", lambda x: F.when(of_base(x), x["end"]).otherwise(-1)), F.greatest)
    after = F.reverse(scanned(F.reverse(F.transform("ss_all", lambda x: F.when(of_base(x), x["start"]).otherwise(1 << 60))), F.least))
    rows = F.arrays_zip(F.col("ss_all").alias("s"), before.alias("b"), after.alias("a"))
    clear = F.filter(rows, lambda r: of_base(r["s"]) | (r["b"] <= r["s"]["start"]) & (r["a"] >= r["s"]["end"]))
    d = d.withColumn("ss_clear", F.transform(clear, lambda r: r["s"]))
    d = d.withColumn("secret_spans", F.coalesce(back(linked("ss_clear", scope)), "base_spans"))
    return d.drop("ss_text", "ss_base", "ss_all", "ss_clear", *[f"ss_{k}" for k in every])


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``text`` with its secret spans replaced by ``mark``; texts without one stay as they are."""
    # Spans that overlap are one: a span counts from where all before it end, and the text between goes on.
    ends = scanned(F.transform("secret_spans", lambda s: s["end"]), F.greatest)
    rows = F.arrays_zip(F.col("secret_spans").alias("s"), ends.alias("end"))
    before = lambda i: F.when(i > 0, F.get("rd_rows", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    piece = lambda r, i: F.when(r["s"]["start"] >= before(i), F.concat(
        F.substr("text", (before(i) + 1).cast("int"), (r["s"]["start"] - before(i)).cast("int")), F.lit(mark))).otherwise("")
    last = F.element_at("rd_rows", -1)["end"]
    whole = F.concat(F.array_join(F.transform("rd_rows", piece), ""), F.substr("text", (last + 1).cast("int")))
    d = found.withColumn("rd_rows", F.when(F.size("secret_spans") > 0, rows))
    return d.withColumn("text", F.when(F.col("rd_rows").isNotNull(), whole).otherwise(F.col("text"))).drop("rd_rows")


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_told("base_spans"), 256).alias("base_sha256"), _told("secret_spans").alias("spans"),
    )
