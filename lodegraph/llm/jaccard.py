"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship
from .arrays import groups, release, roots, whole_groups, windows, word_hashes
from .blocks import in_blocks
from .common import anti_join, components, documents, join_spread, stored, with_group, without

#: Tokens whose hash lies in the first part of the hash space come first in the global order, by their frequency; the
#: rest follow by hash. Frequencies are then needed of the first part only. The share is a little above the prefix.
FIRST = 0.35
#: Frequencies from here on count as one.
MANY = 1 << 20
#: Shared tokens that a pair needs, by the estimated candidates of a document's prefix: (up to, matches).
LADDER = ((4, 1), (64, 2), (1024, 4), (float("inf"), 8))
BLOCK_DOCS, BLOCK_TOKENS = 512, 1 << 20
#: Sets that share a token of their prefixes are told pair by pair up to this many; more of them are one candidate group.
LIST = 64


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles of a text, ASCII letters lowered; a shorter text is one."""
    h = word_hashes(text.encode().lower())
    if 0 < len(h) < n:
        return windows(h, len(h)) + np.uint64(len(h))
    return np.unique(windows(h, n).view(np.int64)).view(np.uint64)


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of a prefix that any document with enough overlap must meet at least once."""
    return n - -(-num * n // den) + 1


def in_first(tokens: np.ndarray) -> np.ndarray:
    return tokens < np.int64(-(1 << 63) + int(FIRST * 2**64))


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def describe(n: int):
    """(doc_id, text) -> (doc_id, n, c1, c2, first): size and digest of the set, tokens in the first part."""

    def f(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                s = shingles(text or "", n).view(np.int64)
                s.sort()
                rows.append((doc, len(s), *digest(s), int(in_first(s).sum())))
            names = ["doc_id", "n", "c1", "c2", "first"]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        release()

    return f


def tokens_of(n: int, num: int, den: int):
    """(doc_id, text) -> (token, c1): the tokens that a prefix may hold. A set that a task has met is not told again."""

    def told(token, owner):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(owner))], names=["token", "c1"])

    def f(batches):
        met: set[int] = set()
        for batch in batches:
            token, owner, size = [], [], 0
            for text in batch["text"].to_pylist():
                s = shingles(text or "", n).view(np.int64)
                s.sort()
                c1 = digest(s)[0]
                if not len(s) or c1 in met:
                    continue
                met.add(c1)
                t = s[: max(int(in_first(s).sum()), prefix_length(len(s), num, den))]
                token.append(t)
                owner.append(np.full(len(t), c1))
                size += len(t)
                if size >= 1 << 18:
                    yield told(token, owner)
                    token, owner, size = [], [], 0
            if token:
                yield told(token, owner)
        release()

    return f


def shared(batches):
    """Rows in the order of (token, c1) -> (token, c1, df) of tokens that at least two sets have; ``MANY`` at most."""
    last, own, many = None, [np.zeros(0, np.int64)], False

    def told(token, c1, df):
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(c1), pa.array(df.astype(np.int64))], names=["token", "c1", "df"])

    def ended():
        rows = np.concatenate(own)
        if many or len(rows) > 1:
            yield told(np.full(len(rows), last), rows, np.full(len(rows), MANY if many else len(rows)))

    for batch in batches:
        token, c1 = batch["token"].to_numpy(), batch["c1"].to_numpy()
        fresh = np.append(True, (token[1:] != token[:-1]) | (c1[1:] != c1[:-1]))[: len(token)]
        token, c1 = token[fresh], c1[fresh]
        if not len(token):
            continue
        change = np.flatnonzero(token[1:] != token[:-1]) + 1
        start = np.append(0, change)
        if token[0] == last:
            head = c1[: change[0]] if len(change) else c1
            tail = own[-1][-1:] if len(own[-1]) else own[-2][-1:] if len(own) > 1 else own[-1]
            own.append(head[1:] if len(tail) and head[0] == tail[0] else head)
            start = start[1:]
            if sum(map(len, own)) >= MANY:
                many = True
                yield from ended()
                own = [np.zeros(0, np.int64)]
        if len(start):
            if last is not None:
                yield from ended()
            end = np.append(start[1:], len(token))
            size = (end - start)[:-1]
            df = np.repeat(size, size)
            body = slice(start[0], start[-1])
            yield told(token[body][df > 1], c1[body][df > 1], df[df > 1])
            last, own, many = token[-1], [c1[start[-1] :]], False
    if last is not None:
        yield from ended()
    release()


def prefixes(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(c1, matches, base, token, place): the shared tokens in the prefix of each set, and their places in the order.

    ``base`` is the length of the plain prefix; a set that expects many candidates has a prefix longer by
    ``matches`` - 1 tokens, of which a pair has to share ``matches``.
    """
    low = F.lit(-(1 << 63) + int(FIRST * 2**64))
    base = F.col("n") - F.ceil(F.col("n") * num / den).cast("long") + 1
    d = rows.join(sets.select("c1", "n", "first").distinct(), "c1")
    d = d.withColumns({"outside": F.col("token") >= low, "base": base})
    order = Window.partitionBy("c1", "n").orderBy("outside", F.when(~F.col("outside"), F.col("df")), "token")
    whole = Window.partitionBy("c1", "n")
    d = d.withColumns({
        "r": F.row_number().over(order), "inside": F.sum(F.when(~F.col("outside"), 1).otherwise(0)).over(whole),
    })
    # Tokens of the first part that no other set has stand before the shared ones. Outside it, all told tokens belong.
    place = F.when(F.col("outside"), F.col("base")).otherwise(F.col("first") - F.col("inside") + F.col("r"))
    d = d.withColumn("place", place)
    cost = F.sum(F.when(F.col("place") <= F.col("base"), F.col("df") - 1).otherwise(0)).over(whole)
    matches = F.lit(LADDER[-1][1])
    for up, m in reversed(LADDER[:-1]):
        matches = F.when(F.col("cost") <= up, F.lit(m)).otherwise(matches)
    d = d.withColumn("cost", cost).withColumn("matches", matches)
    d = d.withColumn("matches", F.when(F.col("first") >= F.col("base") + F.col("matches") - 1, F.col("matches")).otherwise(1))
    return d.filter(F.col("place") <= F.col("base") + F.col("matches") - 1).select("c1", "n", "matches", "base", "token", "place")


def candidates_of(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of sets that may be near: they share as many prefix tokens as the lesser of their two prefixes asks for, and as
    many as the rest of them cannot make up for.

    Each token's list of up to ``LIST`` sets gives its pairs, of sizes that may link; pairs are counted over the tokens and
    those with too few go. Sets in a longer list are tied to its first one instead, so that its pairs are never told: who
    shares such a token is in one group, where all tokens are compared. A pair that shares none is counted in full.
    """
    d = with_group(prefix, "token", "c1", {"k": F.count("*"), "low": F.min("c1")}, {"k": F.sum, "low": F.min}).filter("k > 1")
    hot = d.filter((F.col("k") > LIST) & (F.col("c1") > F.col("low"))).select(F.col("c1").alias("a"), F.col("low").alias("b"))
    short = d.filter(F.col("k") <= LIST)
    side = lambda x: short.select("token", F.col("c1").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "matches", "base", "place")])
    m = F.least("matches_a", "matches_b")
    pairs = side("a").join(side("b"), "token").filter("a < b")
    pairs = pairs.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    pairs = pairs.filter((F.col("place_a") < F.col("base_a") + m) & (F.col("place_b") < F.col("base_b") + m))
    # What is shared beyond both prefixes is behind the end of the one that ends first: so many at most, and so many are needed.
    rest = F.greatest(F.col("n_a") - F.col("base_a"), F.col("n_b") - F.col("base_b")) - m + 1
    short = F.ceil(num * (F.col("n_a") + F.col("n_b")) / F.lit(num + den)) - rest
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(m).alias("m"), F.min(short).alias("short"))
    pairs = pairs.filter("shared >= m AND shared >= short")
    return pairs.select("a", "b").union(hot.distinct())


def common(columns: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the arrays (of distinct values) share; in slices of the values, as a matrix product."""
    n = len(columns)
    value, where = np.unique(np.concatenate(columns), return_inverse=True)
    count = np.bincount(where, minlength=len(value))
    dense = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(n), [len(c) for c in columns])
    keep = count[where] > 1
    row, column = row[keep], dense[where][keep]
    total = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        m = np.zeros((n, step), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        total += m @ m.T
    return total


def verify(num: int, den: int):
    """Groups of candidates -> (rep, root): the links found in each group as a forest."""

    def f(batches):
        for chunk in whole_groups(batches, "bk_key"):
            out = []
            for g in groups(chunk, "bk_key"):
                if g.num_rows < 2:
                    continue
                rep, n, side = g["rep"].to_numpy(), g["n"].to_numpy(), g["bk_block"].to_numpy()
                matches, base = g["matches"].to_numpy(), g["base"].to_numpy()
                sets = [np.frombuffer(x, np.int64) for x in g["set"].to_pylist()]
                token = [np.array(x, np.int64) for x in g["tokens"].to_pylist()]
                place = [np.array(x, np.int64) for x in g["places"].to_pylist()]
                near = np.zeros((len(rep), len(rep)), bool)
                for m in np.unique(matches):
                    own = [t[p <= b + m - 1] for t, p, b in zip(token, place, base, strict=True)]
                    rest = n - base - m + 1
                    need = np.add.outer(n, n) * (num / (num + den)) - 0.5  # half a token less, as this is rounded
                    need -= np.maximum.outer(rest, rest)
                    near |= (np.minimum.outer(matches, matches) == m) & (common(own) >= np.maximum(need, m))
                near &= np.minimum.outer(n, n) * den >= np.maximum.outer(n, n) * num
                if g["bk_low"][0].as_py() != g["bk_high"][0].as_py():
                    near &= side[:, None] != side
                a, b = np.nonzero(np.triu(near, 1))
                if len(a) > 4 * len(rep):
                    both = common(sets)[a, b].astype(np.int64)
                else:
                    both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
                linked = den * both >= num * (n[a] + n[b] - both)
                if linked.any():
                    root = roots(len(rep), a[linked], b[linked])
                    child = np.flatnonzero(root != np.arange(len(rep)))
                    out.append((rep[child], rep[root[child]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
            release()

    return f


def sets_of(n: int):
    """Adds the set of a text's shingles as bytes; rows whose set has another digest than told are left out."""

    def f(batches):
        for batch in batches:
            sets = [shingles(t or "", n).view(np.int64) for t in batch["text"].to_pylist()]
            for s in sets:
                s.sort()
            right = [digest(s) == (a, b) for s, a, b in zip(sets, batch["c1"].to_pylist(), batch["c2"].to_pylist(), strict=True)]
            batch = batch.drop_columns(["text"]).append_column("set", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield batch.filter(pa.array(right, pa.bool_()))
        release()

    return f


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document of (doc_id, text).

    Two documents link if den * |A and B| >= num * |A or B| for their sets of distinct ``n``-word shingles. Documents
    with one set are one class. Tokens that two classes share are counted; each class has a prefix, rarest tokens first,
    longer by m - 1 tokens where it expects many candidates. Pairs of classes that share as many prefix tokens as the lesser
    of their two prefixes asks for come together in groups; in a group each such pair is verified by its exact overlap.
    Large groups are compared in pairs of blocks. Nothing is dropped or capped.

    Sets are of 64-bit hashes of shingles. Null and empty texts have no shingle and link with nothing; a text shorter
    than a shingle is one shingle. A null doc_id links with nothing (component_id null, kept true). Rows with one doc_id
    and different texts are each placed by their own text. Extra columns are ignored; an empty table gives no row.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = stored(texts.mapInArrow(describe(n), "doc_id long, n long, c1 long, c2 long, first long"))
    full = told.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("first").alias("first")))
    rows = texts.filter("doc_id IS NOT NULL").mapInArrow(tokens_of(n, num, den), "token long, c1 long")
    rows = rows.repartition("token").sortWithinPartitions("token", "c1").mapInArrow(shared, "token long, c1 long, df long")
    prefix = stored(prefixes(rows, classes, num, den))
    place = components(candidates_of(prefix, num, den)).withColumnRenamed("id", "c1")
    listed = prefix.groupBy("c1", "n").agg(
        F.first("matches").alias("matches"), F.first("base").alias("base"),
        F.sort_array(F.collect_list(F.struct("token", "place"))).alias("p"))
    candidates = listed.join(place, "c1").join(classes.select("c1", "c2", "n", "rep"), ["c1", "n"])
    candidates = with_group(candidates, "root", "c1", {"k": F.count("*"), "w": F.sum("n")}, {"k": F.sum, "w": F.sum})
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_TOKENS)).cast("int")
    candidates = candidates.withColumn("blocks", blocks).select(
        "rep", "c1", "c2", "n", "matches", "base", "root", "blocks",
        F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["place"]).alias("places"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    ready = texts.withColumnRenamed("doc_id", "rep").join(candidates, "rep").select("text", *candidates.columns)
    ready = ready.mapInArrow(sets_of(n), f"{kinds}, set binary").dropDuplicates(["rep", "c1", "c2"])
    dealt = in_blocks(ready, F.col("root"), F.col("c1"), F.col("blocks"))
    need = dealt.select("bk_key", "bk_block", "bk_low", "bk_high", "rep", "n", "matches", "base", "tokens", "places", "set")
    links = need.mapInArrow(verify(num, den), "a long, b long")
    whole = components(links).withColumnRenamed("id", "rep")
    reps = classes.select("n", "c1", "c2", "rep").join(whole, "rep", "left")
    reps = reps.select("n", "c1", "c2", F.coalesce("root", "rep").alias("found"))
    out = join_spread(told, reps, ["n", "c1", "c2"], "doc_id")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup_near(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id.

    Should a doc_id repeat, rows are told apart by id and text: of rows equal in both one stays, and rows of one id with
    different texts are placed each by its own text, numbered in the order of ids, so that one row of a component stays.
    Rows without a doc_id stay.
    """
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        # Texts of documents that stay are not shuffled.
        gone = stored(jaccard_groups(docs, **options).filter("NOT kept").select("doc_id").distinct())
        return anti_join(docs, gone, "doc_id")
    keyed = docs.filter("doc_id IS NOT NULL").withColumn("dn_text", F.coalesce(F.sha2("text", 256), F.lit("")))
    keys = keyed.select("doc_id", "dn_text").distinct().orderBy("doc_id", "dn_text")
    keys = stored(keys.withColumn("dn_id", F.monotonically_increasing_id()))
    rows = stored(keyed.join(keys, ["doc_id", "dn_text"]).dropDuplicates(["dn_id"]))
    gone = jaccard_groups(rows.select(F.col("dn_id").alias("doc_id"), "text"), **options).filter("NOT kept")
    kept = rows.join(gone.select(F.col("doc_id").alias("dn_id")).distinct(), "dn_id", "left_anti").select(*docs.columns)
    return kept.union(docs.filter("doc_id IS NULL"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id WHERE 100 * o >= 80 * (len(x.s) + len(y.s) - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) m ON s.doc_id = m.a
"""
