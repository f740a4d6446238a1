"""Joins that link elements: labels, neighbours in reading order, boxes, captions that are alike."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import boxes
from ..session import cut, ship
from . import alike


def label_table(captions: DataFrame, visuals: DataFrame) -> DataFrame:
    """(doc_id, label, id): the last caption with a label; where there is none, the first visual that names it itself.

    Both inputs are (doc_id, label, id, ord); a caption row carries the id of its visual.
    """
    have = captions.filter("label IS NOT NULL").groupBy("doc_id", "label").agg(F.max_by("id", "ord").alias("id"))
    own = visuals.filter("label IS NOT NULL").groupBy("doc_id", "label").agg(F.min_by("id", "ord").alias("id"))
    return have.unionByName(own.join(have, ["doc_id", "label"], "left_anti"))


def refer_to(paragraphs: DataFrame, labels: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges (doc_id, src, dst) from paragraphs (doc_id, id, refs array) to what they name, once each, new ones only."""
    d = paragraphs.select("doc_id", F.col("id").alias("src"), F.explode(F.array_distinct("refs")).alias("label"))
    d = d.join(labels.select("doc_id", "label", F.col("id").alias("dst")), ["doc_id", "label"]).select("doc_id", "src", "dst").distinct()
    return d if existing is None else d.join(existing.select("doc_id", "src", "dst"), ["doc_id", "src", "dst"], "left_anti")


def nearby_visual(elements: DataFrame, reach: int = 3) -> DataFrame:
    """(doc_id, caption, visual, gap): the visual nearest to each caption in reading order, at most ``reach`` away.

    A caption is put at every place in its reach, so the join is an equi-join on (document, place).
    """
    cap = elements.filter("type = 'caption'").select("doc_id", F.col("id").alias("caption"), F.col("ord").alias("at"))
    cap = cap.withColumn("ord", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    vis = elements.filter("type IN ('figure', 'table')").select("doc_id", F.col("id").alias("visual"), "ord")
    d = cap.join(vis, ["doc_id", "ord"]).withColumn("gap", F.abs(F.col("ord") - F.col("at")))
    best = d.groupBy("doc_id", "caption").agg(F.min(F.struct("gap", "ord", "visual")).alias("b"))
    return best.select("doc_id", "caption", "b.visual", "b.gap")


def contained_boxes(truth: DataFrame, elements: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs on one page where at least ``least`` of the element's area lies in the truth's box."""
    d = truth.join(elements, ["doc_id", "page"])
    d = d.withColumn("share", boxes.contained(F.col("box"), F.col("gt_box")))
    return d.filter(F.col("share") >= least)


def best_box(truth: DataFrame, elements: DataFrame, least: float = 0.5) -> DataFrame:
    """(gt_id, id, iou): the element with the greatest overlap on the page, the first of equals, if it is enough."""
    d = truth.join(elements, ["doc_id", "page"]).withColumn("iou", boxes.iou(F.col("gt_box"), F.col("box")))
    best = d.groupBy("gt_id").agg(F.min(F.struct((-F.col("iou")).alias("worse"), "ord", "id")).alias("b"))
    return best.select("gt_id", F.col("b.id").alias("id"), (-F.col("b.worse")).alias("iou")).filter(F.col("iou") >= least)


def ratio(a: Column, b: Column) -> Column:
    """Sequence similarity of the first 200 characters of two texts, in Arrow batches; equal pairs of a batch once."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [((p or "")[:200], (q or "")[:200]) for p, q in zip(x, y, strict=True)]
        known = {pair: SequenceMatcher(None, *pair).ratio() for pair in set(pairs)}
        return pd.Series([known[pair] for pair in pairs], dtype="float64")

    return f(a, b)


def letters(text: Column, places: int = 32) -> Column:
    """(size, counts) of the first 200 characters: how many there are, and how often each letter; letters share ``places`` counters."""
    codes = F.transform(F.filter(F.split(F.left(F.coalesce(text, F.lit("")), F.lit(200)), ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(places)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.size(F.filter(codes, lambda c: c == i)))
    return F.struct(F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(200)).alias("size"), counts.alias("counts"))


def most_alike(a: Column, b: Column) -> Column:
    """What ``ratio`` of two texts can be at most, of their ``letters``: twice those that both have, in any order, over both sizes."""
    both = F.aggregate(F.zip_with(a["counts"], b["counts"], lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 2.0 * both / F.greatest(a["size"] + b["size"], F.lit(1))


def by_group(batches, n: int):
    """Rows of sorted batches in groups of their first ``n`` columns, one at a time: (rows that do not ask, rows that ask), by ``asks``, the
    column behind these."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for _, own in groupby(rows, key=lambda row: row[:n]):
        own = list(own)
        at = next((i for i, row in enumerate(own) if row[n]), len(own))
        yield own[:at], own[at:]


def batch_of(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(shape)], schema=shape)


def askers_and_others(asking: DataFrame, others: DataFrame, group: list[str], cells: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides as one kept table of (group, asks, cells), and how many of each a group has where it has both: (group, asking, others)."""
    d = cut(asking.select(*group, F.lit(True).alias("asks"), *cells).unionByName(others.select(*group, F.lit(False).alias("asks"), *cells)))
    n = d.groupBy(*group).agg(F.count_if("asks").alias("asking"), F.count_if(~F.col("asks")).alias("others"))
    return d, n.filter("asking > 0 AND others > 0")


def tasks_for(sizes: DataFrame) -> int:
    """Tasks for comparing the pairs of groups, a million pairs each or so, so that they get more and not larger as tables grow."""
    pairs = sizes.agg(F.sum(F.col("asking").cast("double") * F.col("others"))).first()[0] or 0
    return max(sizes.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / 1e6))


def best_alike(figures: DataFrame, others: DataFrame, group: list[str], least: float, labelled: bool = False, block: int = 512) -> DataFrame:
    """(doc_id, file, id, similarity): for each figure (group, file, text, label) the one of the others (group, id, ord, text, label) of its
    group that scores most, the first of equals, if it is ``least`` at least.

    The score is the ``ratio`` of the texts; if ``labelled``, seven tenths of it and three for an equal label, or one for an equal
    label where a text has no characters. Both sides are dealt into blocks of ``block`` rows or so; a block of each meet in one
    task, which tells only the best of each figure, so pairs are neither kept nor shuffled.
    """
    ship(figures.sparkSession)
    block = min(block, alike.REMEMBER // 4)
    d, n = askers_and_others(figures.select(*group, F.col("file").alias("id"), F.lit(None).cast("long").alias("ord"), "text", "label"),
                             others.withColumn("ord", F.col("ord").cast("long")), group, ["id", "ord", "text", "label"])
    tasks = tasks_for(n)
    d = d.join(n.select(*group, F.ceil(F.col("asking") / block).alias("a"), F.ceil(F.col("others") / block).alias("b")), group)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("a")).otherwise(F.col("b")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), F.col("b")).otherwise(F.col("a")) - 1))
    d = d.withColumn("own", own).withColumn("other", other)
    of_a, of_b = F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))
    keys = [*group, "block_a", "block_b"]
    d = d.select(*group, of_a.alias("block_a"), of_b.alias("block_b"), "asks", "id", "ord", "text", "label")
    d = d.repartition(tasks, *keys).sortWithinPartitions(*keys, "asks", "ord", "id")
    told = d.select("doc_id", F.col("id").alias("file"), "id", "ord", F.lit(0.0).alias("score")).schema
    at = len(keys)

    def best(batches):
        for there, asking in by_group(batches, at):
            if not there or not asking:
                continue
            b, out = alike.Block([row[at + 3] for row in there]), []
            bare, named = np.array([not row[at + 3] for row in there]), np.array([row[at + 4] for row in there], object)
            for row in asking:
                text, label = row[at + 3 : at + 5]
                same = ((named == label) & (label is not None)).astype(np.float64)
                mixed = lambda r, k: np.where(bare[k] | (not text), same[k], 0.3 * same[k] + 0.7 * r)  # noqa: B023, E731
                got = b.best(text, least, mixed if labelled else lambda r, k: r)
                if got:
                    out.append((row[0], row[at + 1], *there[got[0]][at + 1 : at + 3], got[1]))
            yield batch_of(out, shape)

    shape = to_arrow_schema(told)
    best = d.mapInArrow(best, told).groupBy("doc_id", "file").agg(F.min(F.struct((-F.col("score")).alias("worse"), "ord", "id")).alias("b"))
    return best.select("doc_id", "file", F.col("b.id").alias("id"), (-F.col("b.worse")).alias("similarity"))


def fuzzy_captions(figures: DataFrame, captions: DataFrame, least: float = 0.3, block: int = 512) -> DataFrame:
    """(doc_id, file, id, similarity): for each figure the caption of its document that is most alike.

    Three tenths for an equal label, seven for the similarity of the texts; the first of equals; at least ``least``.
    """
    return best_alike(figures, captions, ["doc_id"], least, True, block)


def alike_visuals(figures: DataFrame, visuals: DataFrame, least: float = 0.5, block: int = 512) -> DataFrame:
    """(doc_id, file, id, similarity): for each figure (doc_id, file, type, text) the visual (doc_id, id, ord, type, text) of its
    document and type whose caption is most alike, the first of equals, if it is enough. Texts without characters meet none.
    """
    sides = [d.filter("text <> ''").withColumn("label", F.lit(None).cast("string")) for d in (figures, visuals)]
    return best_alike(*sides, ["doc_id", "type"], least, False, block)


def random_roles(nodes: DataFrame, roles: tuple[str, ...], seed: int = 0) -> DataFrame:
    """``drawn``: a role out of ``roles`` for each node, all equally likely, the same on every run."""
    u = F.conv(F.substring(hash_order(seed, "doc_id", "id"), 1, 8), 16, 10).cast("long")
    return nodes.withColumn("drawn", F.get(F.array(*[F.lit(r) for r in roles]), (u % len(roles)).cast("int")))


def choose_in_turn(wishes: DataFrame) -> DataFrame:
    """(doc_id, who, what) of wishes (doc_id, who, turn, wish, what): in the order of ``turn`` each takes the first of its wishes that is
    still free, the one of the lowest ``wish``.

    That is a stable matching in which everything prefers the earlier turn, so it is found in rounds, not one by one: each names
    its first wish that is left, and everything is held by the earliest turn that names it. Whoever holds it, it goes to that
    turn or an earlier one in the end, so all later turns lose their wish for it, named or not. Rounds are joins and
    aggregates, and end when nobody that names something is turned down.
    """
    left = cut(wishes.select("doc_id", "who", "turn", "wish", "what"))
    while True:
        named = left.groupBy("doc_id", "who").agg(F.min(F.struct("wish", "turn", "what")).alias("w")).select("doc_id", "who", "w.*")
        held = cut(named.groupBy("doc_id", "what").agg(F.min(F.struct("turn", "who")).alias("h"), (F.count("*") > 1).alias("lost")))
        if held.filter("lost").isEmpty():
            return held.select("doc_id", F.col("h.who").alias("who"), "what")
        late = F.coalesce(F.struct("turn", "who") > F.col("h"), F.lit(False))
        left = cut(left.join(held.drop("lost"), ["doc_id", "what"], "left").filter(~late).drop("h"))


def assign_greedily(elements: DataFrame, figures: DataFrame, least: float = 0.6, most: int = alike.REMEMBER) -> DataFrame:
    """(doc_id, id, file, similarity): each element takes the most similar free figure of its type, in order, the first of equals.

    Elements and figures are (doc_id, id or file, type, text, ord). The figures of a document and type lie in one task, up to
    ``most``, and its elements pass by in their order; each is compared only where it may find something better. Where there are
    more figures, ``assign_in_rounds`` finds the same.
    """
    ship(elements.sparkSession)
    cells, keys = ["id", "ord", "text"], ["doc_id", "type"]
    d, n = askers_and_others(elements.filter("text <> ''"), figures.filter("text <> ''").withColumnRenamed("file", "id"), keys, cells)
    tasks = tasks_for(n)
    own = d.join(n.filter(F.col("others") <= most).select(*keys), keys).select(*keys, "asks", *cells)
    own = own.repartition(tasks, *keys).sortWithinPartitions(*keys, "asks", "ord", "id")
    told = own.select("doc_id", "id", F.col("id").alias("file"), F.lit(0.0).alias("similarity")).schema

    def take(batches):
        for there, asking in by_group(batches, 2):
            b, free, out = alike.Block([row[5] for row in there]), np.ones(len(there), bool), []
            for row in asking:
                got = b.best(row[5], least, lambda r, k: r, free) if free.any() else None
                if got:
                    free[got[0]] = False
                    out.append((row[0], row[3], there[got[0]][3], got[1]))
            yield batch_of(out, shape)

    shape = to_arrow_schema(told)
    found, large = own.mapInArrow(take, told), n.filter(F.col("others") > most).select(*keys)
    if large.isEmpty():
        return found
    d = d.join(large, keys)
    return found.union(assign_in_rounds(d.filter("asks"), d.filter("NOT asks").withColumnRenamed("id", "file"), least))


def assign_in_rounds(elements: DataFrame, figures: DataFrame, least: float) -> DataFrame:
    """``assign_greedily`` without a task that has all figures of a document: pairs that reach ``least`` are wishes, and ``choose_in_turn`` gives
    each its figure."""
    figures = figures.select("doc_id", "type", "file", F.col("ord").alias("at"), F.col("text").alias("offered"), letters(F.col("text")).alias("ag_b"))
    d = elements.select("doc_id", "type", F.col("id").alias("who"), F.col("ord").alias("turn"), F.col("text").alias("wanted"), letters(F.col("text")).alias("ag_a"))
    d = d.join(figures, ["doc_id", "type"]).filter(most_alike(F.col("ag_a"), F.col("ag_b")) >= least)
    d = cut(d.drop("ag_a", "ag_b").withColumn("similarity", ratio(F.col("wanted"), F.col("offered"))).filter(F.col("similarity") >= least))
    found = choose_in_turn(d.select("doc_id", "who", "turn", F.struct((-F.col("similarity")).alias("worse"), "at").alias("wish"), F.col("file").alias("what")))
    d = found.withColumnRenamed("what", "file").join(d.select("doc_id", "who", "file", "similarity"), ["doc_id", "who", "file"])
    return d.select("doc_id", F.col("who").alias("id"), "file", "similarity")


def hash_order(seed: int, *names: str) -> Column:
    """A seeded order of rows that is the same on every run and in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def shuffled_roles(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """``shuffled``: the roles of a document dealt out anew among its nodes; each role as often as before."""
    a = nodes.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    b = nodes.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(hash_order(seed, "doc_id", "id"), "id")))
    return a.join(b.select("doc_id", "r", F.col("section_role").alias("shuffled")), ["doc_id", "r"]).drop("r")


def hard_pool(anchors: DataFrame, nodes: DataFrame, positives: DataFrame, seed: int = 0, most: int = 4, size: int = 12) -> DataFrame:
    """(anchor, id, positive): up to ``most`` neighbours of each anchor, then nodes of its document in a seeded order."""
    near = positives.select("anchor", "id", F.lit(0).alias("rank_in"), hash_order(seed, "anchor", "id").alias("h"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("h", "id"))).filter(F.col("r") <= most)
    far = anchors.join(nodes, "doc_id").filter("anchor <> id").join(positives, ["anchor", "id"], "left_anti")
    far = far.select("anchor", "id", F.lit(1).alias("rank_in"), hash_order(seed, "anchor", "id").alias("h"))
    far = far.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("h", "id"))).filter(F.col("r") <= size)
    both = near.unionByName(far).withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("rank_in", "r")))
    return both.filter(F.col("place") <= size).select("anchor", "id", (F.col("rank_in") == 0).alias("positive"), "place")


def hash_number(seed: int, *names: str | Column) -> Column:
    """A seeded number of 32 bits, the same on every run and in any engine."""
    parts = [F.col(n).cast("string") if isinstance(n, str) else n.cast("string") for n in names]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Number all rows from 0 by a column of hexadecimal hashes, whose first three digits deal them into 4096 parts: rows are
    numbered in their part, and only the parts' counts are added up in one task."""
    d = rows.withColumn("nb_part", F.substring(order, 1, 3))
    before = d.groupBy("nb_part").count().select("nb_part", (F.sum("count").over(Window.orderBy("nb_part")) - F.col("count")).alias("nb_before"))
    inside = F.row_number().over(Window.partitionBy("nb_part").orderBy(order)) - 1
    return d.withColumn("nb_inside", inside).join(before, "nb_part").withColumn(out, F.col("nb_before") + F.col("nb_inside")).drop("nb_part", "nb_before", "nb_inside")


def training_pool(anchors: DataFrame, nodes: DataFrame, neighbours: DataFrame, seed: int = 0, size: int = 12, most: int = 4) -> DataFrame:
    """(anchor, id, kind, place): candidates that a training step scores for each anchor (doc_id, anchor, target).

    Up to ``most`` positives, the target first, then its neighbours (anchor, id); negatives of its document; and negatives of
    other documents, a quarter of ``size`` and four at least. Headers are nothing of these. Everything is drawn by seeded
    hashes. A negative of another document is drawn as a number among the documents other than the anchor's, and a number among
    that document's nodes, both of which are joined: no node meets a node that is not drawn. These draws may repeat. With
    no other document, the anchor's own one fills the pool.
    """
    cross = max(4, size // 4)
    nodes = nodes.filter("type IS NULL OR type <> 'section_header'").select("doc_id", "id")
    near = neighbours.select("anchor", "id", F.lit(1).alias("r")).union(anchors.filter("target IS NOT NULL").select("anchor", "target", F.lit(0)))
    near = near.filter("anchor <> id").groupBy("anchor", "id").agg(F.min("r").alias("r")).join(nodes.select("id"), "id", "left_semi")
    near = near.withColumn("h", hash_order(seed, "anchor", "id"))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("r", "h", "id"))).filter(F.col("place") <= most)

    documents = nodes.groupBy("doc_id").count().withColumn("h", hash_order(seed, "doc_id"))
    documents = numbered(documents, "h", "number").select("doc_id", "number", F.col("count").alias("nodes"))
    total = documents.agg(F.count("*").alias("documents"))
    draws = anchors.join(documents.select("doc_id", "number"), "doc_id", "left").crossJoin(F.broadcast(total))  # one row
    draws = draws.withColumn("others", F.col("documents") - F.col("number").isNotNull().cast("int"))
    have = draws.select("anchor", F.when(F.col("others") > 0, cross).otherwise(0).alias("cross"))
    draws = draws.filter("others > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cross - 1))))
    u = hash_number(seed, "anchor", "i", F.lit("document")) % F.col("others")
    draws = draws.select("anchor", "i", (u + F.coalesce((u >= F.col("number")).cast("int"), F.lit(0))).alias("number"))
    draws = draws.join(documents, "number").withColumn("at", hash_number(seed, "anchor", "i", F.lit("node")) % F.col("nodes"))
    inside = F.row_number().over(Window.partitionBy("doc_id").orderBy(hash_order(seed, "id"), "id")) - 1
    far = draws.join(nodes.withColumn("at", inside), ["doc_id", "at"]).select("anchor", "id", F.lit("cross").alias("kind"), "i")

    room = have.join(first.groupBy("anchor").count(), "anchor", "left").select("anchor", (size - F.coalesce("count", F.lit(0)) - F.col("cross")).alias("room"))
    same = anchors.select("doc_id", "anchor").join(nodes, "doc_id").filter("anchor <> id").join(near, ["anchor", "id"], "left_anti")
    same = same.withColumn("i", F.row_number().over(Window.partitionBy("anchor").orderBy(hash_order(seed, "anchor", "id"), "id")))
    same = same.filter(F.col("i") <= size).join(room, "anchor").filter("i <= room").select("anchor", "id", F.lit("same").alias("kind"), "i")

    both = first.select("anchor", "id", F.lit("positive").alias("kind"), F.col("place").alias("i")).union(same).union(far)
    order = Window.partitionBy("anchor").orderBy(F.when(F.col("kind") == "positive", 0).when(F.col("kind") == "same", 1).otherwise(2), "i")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select("anchor", "id", "kind", "place")


def anchor_kind(seed: int, *names: str) -> Column:
    """Which kind of anchor a step draws: a third each of caption, reference and question."""
    u = F.conv(F.substring(hash_order(seed, *names), 1, 8), 16, 10).cast("long") % 100
    return F.when(u < 33, "caption").when(u < 67, "reference").otherwise("question")
