"""Ranking, fusion of scores and shortlists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schema import RRF_CONSTANT, SHORTLIST
from ..session import ship

#: Questions of one block and vectors of one slice, in ranking by counting; scores are compared to so many digits.
BLOCK, SLICE, DIGITS = 4096, 100_000, 6


def rank(df: DataFrame, by: list[str], score: str = "score", ties: str = "ord", out: str = "rank") -> DataFrame:
    """Place 1 for the best score of each query; equal scores keep the order of the candidates."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ties)))


def top(df: DataFrame, by: list[str], k: int = SHORTLIST, score: str = "score", ties: str = "ord") -> DataFrame:
    """The ``k`` best of each query, with their ranks. The window is limited before it is sorted in full."""
    return rank(df, by, score, ties).filter(F.col("rank") <= k)


def reciprocal_rank(df: DataFrame, by: list[str], modality: str = "modality") -> DataFrame:
    """``rrf``: 1 / (60 + place within the query's candidates of one modality), over all that is there."""
    return rank(df, [*by, modality], out="rrf_rank").withColumn("rrf", reciprocal("rrf_rank"))


def reciprocal(place: str) -> Column:
    return 1 / (RRF_CONSTANT + F.col(place))


def z_score(df: DataFrame, by: list[str], modality: str = "modality") -> DataFrame:
    """``z``: the score less its mean over its sample deviation, within query and modality."""
    w = Window.partitionBy(*by, modality)
    spread = F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0)) + 1e-8
    return df.withColumn("z", (F.col("score") - F.avg("score").over(w)) / spread)


def merge_tail(base: DataFrame, refined: DataFrame, by: list[str]) -> DataFrame:
    """The refined shortlist in its new order, then the other candidates in their old one: ``final_rank``.

    ``base`` has rank and score, ``refined`` the refined score of the shortlist's ids.
    """
    d = base.join(refined.select(*by, "id", "refined"), [*by, "id"], "left")
    order = [F.col("refined").isNull(), F.desc("refined"), F.col("rank")]
    return d.withColumn("final_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def nth_largest(df: DataFrame, by: list[str], k: int, score: str = "score") -> DataFrame:
    """The k-th largest score of each group that has k rows, as ``theta``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score)))
    return df.withColumn("nl_place", place).filter(F.col("nl_place") == k).select(*by, F.col(score).alias("theta"))


def longest_prefix(df: DataFrame, prefixes: DataFrame, name: str, prefix: str) -> DataFrame:
    """Each name with the longest of the given prefixes that it starts with; null if none does.

    Prefixes are equated with the heads of the name, one row for each length, so the join is an equi-join.
    """
    heads = df.withColumn("lp_len", F.explode(F.sequence(F.lit(1), F.length(name))))
    heads = heads.filter(F.length(name) > 0).withColumn("lp_head", F.expr(f"substring({name}, 1, lp_len)"))
    found = heads.join(prefixes, F.col("lp_head") == F.col(prefix)).groupBy(name).agg(F.max_by(prefix, "lp_len").alias(prefix))
    return df.join(found, name, "left")


def order_key(doc_id: Column, element_id: Column) -> tuple[Column, Column]:
    """Page and number out of ``doc__p012__e0034`` or ``doc__l00056``; (0, 0) for other ids."""
    tail = F.substring(element_id, F.length(doc_id) + 1, F.length(element_id))
    number = lambda p, i: F.regexp_extract(tail, p, i).try_cast("int")
    page, at, line = number(r"^__p(\d+)__e(\d+)$", 1), number(r"^__p(\d+)__e(\d+)$", 2), number(r"^__l(\d+)$", 1)
    return F.coalesce(page, F.lit(0)), F.coalesce(at, line, F.lit(0))


def in_blocks(asked: DataFrame, elements: DataFrame, with_question: list[str], with_element: list[str]) -> DataFrame:
    """Rows (key, side, id, v, ..) in which every question (qid, q, ..) meets every element (id, v, ..): questions lie in blocks, elements in
    slices, and a block and a slice are a key, in whose rows questions (side 0) come first."""
    ship(asked.sparkSession)
    blocks, slices = max(1, -(-asked.count() // BLOCK)), max(1, -(-elements.count() // SLICE))
    dealt = lambda c, salt, n: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    double = lambda c: F.transform(c, lambda x: x.cast("double")).alias("v")
    ask = asked.select(dealt("qid", 0, blocks).alias("block"), F.lit(0).alias("side"), F.col("qid").alias("id"), double("q"), *with_question).withColumn("slice", every(slices))
    offer = elements.select(dealt("id", 1, slices).alias("slice"), F.lit(1).alias("side"), "id", double("v"), *with_element).withColumn("block", every(blocks))
    both = ask.unionByName(offer, allowMissingColumns=True).withColumn("key", F.col("block") * slices + F.col("slice")).drop("block", "slice")
    return both.repartition("key").sortWithinPartitions("key", "side")


def met(batches, kind):
    """One ``kind`` for each key, which has been asked all questions and met all elements of it."""
    block = None
    for batch in batches:
        key, side = batch["key"].to_numpy(), batch["side"].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if block is None or block.key != key[a]:
                if block is not None:
                    yield block
                block = kind(key[a])
            (block.meet if side[a] else block.ask)(batch.slice(a, b - a))
    if block is not None:
        yield block


def nearest(asked: DataFrame, elements: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): of each question (qid, q) the ``k`` elements (id, v) of the greatest inner product, over all of them.

    Each block of questions keeps its best of a slice as a matrix product goes over it, so that what is shuffled are ``k`` rows
    of a question and slice; these are ranked once more. Scores have six digits, equal ones go by id; a question's own
    element (id = qid) is no answer. Vectors have one length, without nulls.
    """

    def best(batches):
        for block in met(batches, lambda key: _Best(key, k)):
            yield from block.results()

    found = in_blocks(asked, elements, [], []).mapInArrow(best, "qid long, id long, score double")
    return top(found, ["qid"], k, ties="id")


def counted_ranks(wanted: DataFrame, asked: DataFrame, elements: DataFrame) -> DataFrame:
    """``wanted`` (qid, id, score, kind) with ``rank`` and ``kind_rank``: places among all ``elements`` (id, v, kind), and among those
    of the wanted one's kind, for the inner product with the question's vector, of ``asked`` (qid, q).

    Nothing is sorted: an element's place is one more than the number of elements that beat it. Questions lie in blocks and
    elements in slices; where a block meets a slice, products are compared with the block's wanted scores, and counts are added
    up, so what is shuffled back are the wanted rows. Scores are compared to six digits, as ``score`` is rounded; equal ones
    go by id. A question's own element (id = qid) does not count. Vectors have one length, without nulls.
    """
    own = wanted.groupBy("qid").agg(F.collect_list(F.struct("id", F.round(F.col("score") * 10**DIGITS).cast("long").alias("at"), "kind")).alias("items"))
    both = in_blocks(asked.join(own, "qid"), elements, ["items"], ["kind"])

    def count(batches):
        for block in met(batches, _Counts):
            yield from block.results()

    found = both.mapInArrow(count, "qid long, id long, above long, kind_above long")
    found = found.groupBy("qid", "id").agg((F.sum("above") + 1).alias("rank"), (F.sum("kind_above") + 1).alias("kind_rank"))
    return wanted.join(found, ["qid", "id"])


class _Best:
    """The best elements met so far, of a block of questions."""

    def __init__(self, key: int, k: int):
        self.key, self.k, self.parts, self.q = key, k, [], None

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def meet(self, part: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.q is None:
            self.qid = np.concatenate([p["id"].to_numpy() for p in self.parts])
            self.q = np.concatenate([p["v"].flatten().to_numpy().reshape(p.num_rows, -1) for p in self.parts])
            self.least = np.full(len(self.qid), np.iinfo(np.int64).min)
            self.held = [np.zeros(0, np.int64)] * 3
        step = max(1, (1 << 21) // len(self.qid))
        for a in range(0, part.num_rows, step):
            rows = part.slice(a, step)
            ids = rows["id"].to_numpy()
            scores = np.rint((self.q @ rows["v"].flatten().to_numpy().reshape(rows.num_rows, -1).T) * 10**DIGITS).astype(np.int64)
            asked, row = np.nonzero((scores >= self.least[:, None]) & (self.qid[:, None] != ids[None, :]))
            new = (asked, scores[asked, row], ids[row])
            of, score, own = (np.concatenate(x) for x in zip(self.held, new, strict=True))
            order = np.lexsort((own, -score, of))
            of, score, own = of[order], score[order], own[order]
            begin = np.append(True, of[1:] != of[:-1])[: len(of)]
            place = np.arange(len(of)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
            self.least[of[place == self.k - 1]] = score[place == self.k - 1]
            self.held = [x[place < self.k] for x in (of, score, own)]

    def results(self):
        if self.q is not None:
            of, score, own = self.held
            yield pa.RecordBatch.from_arrays([pa.array(self.qid[of]), pa.array(own), pa.array(score / 10**DIGITS)], names=["qid", "id", "score"])


class _Counts:
    """For each wanted item of a block of questions: how many of the elements met so far stand before it."""

    def __init__(self, key: int):
        self.key, self.parts, self.q = key, [], None

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def start(self) -> None:
        take = lambda c: np.concatenate([c(p) for p in self.parts])
        self.qid = take(lambda p: p["id"].to_numpy())
        self.q = take(lambda p: p["v"].flatten().to_numpy().reshape(p.num_rows, -1))
        sizes = take(lambda p: p["items"].value_lengths().to_numpy())
        self.begin = np.append(0, np.cumsum(sizes))
        items = [p["items"].flatten() for p in self.parts]
        self.id, self.at = (np.concatenate([i.field(c).to_numpy() for i in items]) for c in (0, 1))
        self.kind = np.concatenate([i.field(2).to_numpy(zero_copy_only=False) for i in items])
        self.above, self.kind_above = np.zeros(len(self.id), np.int64), np.zeros(len(self.id), np.int64)

    def meet(self, part: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.q is None:
            self.start()
        step = max(1, (1 << 21) // len(self.qid))
        for a in range(0, part.num_rows, step):
            rows = part.slice(a, step)
            ids, kinds = rows["id"].to_numpy(), rows["kind"].to_numpy(zero_copy_only=False)
            v = rows["v"].flatten().to_numpy().reshape(rows.num_rows, -1)
            scores = np.rint((self.q @ v.T) * 10**DIGITS).astype(np.int64)
            named = {k: np.flatnonzero(kinds == k) for k in set(kinds.tolist())}
            for i, qid in enumerate(self.qid.tolist()):
                own = slice(self.begin[i], self.begin[i + 1])
                s = scores[i]
                s[ids == qid] = np.iinfo(np.int64).min
                self.above[own] += before(s, ids, self.at[own], self.id[own])
                for k, rows_of in named.items():
                    mine = np.flatnonzero(self.kind[own] == k) + own.start
                    if len(mine):
                        self.kind_above[mine] += before(s[rows_of], ids[rows_of], self.at[mine], self.id[mine])

    def results(self):
        if self.q is not None:
            qid = np.repeat(self.qid, np.diff(self.begin))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (qid, self.id, self.above, self.kind_above)], names=["qid", "id", "above", "kind_above"])


def before(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many scores stand before each of some (score, id): greater ones, and equal ones of smaller ids."""
    ranked = np.sort(scores)
    low, high = np.searchsorted(ranked, at, "left"), np.searchsorted(ranked, at, "right")
    out = len(ranked) - high
    for j in np.flatnonzero(high > low):
        out[j] += int((ids[scores == at[j]] < own[j]).sum())
    return out
