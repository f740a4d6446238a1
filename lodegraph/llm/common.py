"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import shared_folder

#: A word: a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Tables that this process has stored, by application.
_tables: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, survives lost executors.

    The table stays for as long as results read it; ``drop_stored`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far(spark: SparkSession) -> int:
    """How many tables this session has stored and not dropped: a mark for ``drop_stored``."""
    return len(_tables.get(spark.sparkContext.applicationId, []))


def drop_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Remove the tables that operators of this session have stored since a mark, but for the last ``keep``, once results of theirs
    are no longer read."""
    tables = _tables.get(spark.sparkContext.applicationId, [])
    paths = tables[since : max(since, len(tables) - keep)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        tables.remove(path)
    return len(paths)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less its columns of these names: an operator's own columns replace columns that clash with them."""
    low = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in low])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_rank(df: DataFrame, group: list[str], order: list[str], salt: Column, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gathering a group in one task.

    Each group is dealt into parts by ``salt``; rows are numbered inside their part by ``order`` and the counts of the
    parts before it (a table of groups x parts) are added. Nulls are not allowed in ``group``.
    """
    part = f"{out}_part"
    dealt = df.withColumn(part, salt)
    counts = dealt.groupBy(*group, part).count()
    before = counts.select(
        *group, part,
        (F.sum("count").over(Window.partitionBy(*group).orderBy(part)) - F.col("count")).alias(f"{out}_before"),
    )
    inside = dealt.withColumn(
        f"{out}_inside", F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    )
    return inside.join(before, [*group, part]).withColumn(out, F.col(f"{out}_before") + F.col(f"{out}_inside")).drop(
        part, f"{out}_before", f"{out}_inside"
    )


#: Parts that the rows of one key are dealt into where something is told to all of them.
SALTS = 32


def with_group(df: DataFrame, key: str, spread: str, first: dict[str, Column], combine: dict) -> DataFrame:
    """``df`` with aggregates of each row's ``key``, without bringing a key's rows into one task.

    A key is dealt into ``SALTS`` parts by ``spread``: ``first`` aggregates a part, ``combine`` the parts of a key, and
    the result goes back to each part. Rows without a key go.
    """
    d = df.withColumn("wg_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = d.groupBy(key, "wg_part").agg(*[c.alias(n) for n, c in first.items()])
    whole = Window.partitionBy(key)
    parts = parts.select(key, "wg_part", *[combine[n](n).over(whole).alias(n) for n in first])
    return d.join(parts, [key, "wg_part"]).drop("wg_part")


def join_spread(df: DataFrame, told: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``df`` with what ``told`` has for its keys, null where it has nothing: a left join in which a key that very many rows
    have is no one task's work, as it is told to ``SALTS`` parts of them. ``told`` has a key once."""
    d = df.withColumn("js_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = d.select(*keys, "js_part").distinct().join(told, keys)
    return d.join(parts, [*keys, "js_part"], "left").drop("js_part")


#: Bits of the table that rows are sifted by: 131,072 words of 64 at most, whatever the number of keys.
SIEVE = 1 << 23


def anti_join(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is not in ``gone``, a stored table of keys, without a shuffle of most of them.

    Keys of ``gone`` set bits of a table of fixed size, which is told to all tasks. Rows whose bit is not set stay where they are;
    only the others, those that go and those that share a bit with one of them, are joined. Rows with a null key stay.
    """
    at, own = F.pmod(F.xxhash64(key), F.lit(SIEVE)), uuid.uuid4().hex  # names that no column of df has
    word, bit = F.shiftright(at, 6).cast("int"), at.bitwiseAND(63).cast("int")
    words = gone.select(word.alias(f"word_{own}"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one"))
    words = words.groupBy(f"word_{own}").agg(F.bit_or("one").alias(f"bits_{own}"))
    d = df.withColumn(f"word_{own}", word).join(F.broadcast(words), f"word_{own}", "left")
    hit = F.call_function("shiftrightunsigned", F.col(f"bits_{own}"), bit).bitwiseAND(1) == 1
    hit = F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()
    names = [quoted(c) for c in df.columns]
    return d.filter(~hit).select(*names).union(d.filter(hit).select(*names).join(gone.select(key), key, "left_anti").select(*names))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id reachable from each id in an undirected edge list, for ids that have an edge.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stand still. Each step is a
    minimum per node, told to the node's edges part by part, so that a node with very many edges is not one task's work;
    each is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = stored(e.filter("u <> v").distinct())
    least = ({"m": F.min("v")}, {"m": F.min})
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_group(both, "u", "v", *least).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_group(large, "u", "v", *least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named: the only element of an array of one."""
    return F.transform(F.array(value), use)[0]


def scanned(values: Column, combine, chunk: int = 256) -> Column:
    """Running totals of an array under an associative ``combine``.

    Totals run inside chunks, then over the chunks' last ones, which each chunk takes up from the one before; arrays grow
    to ``chunk`` entries only (the one of chunks aside), so the work is in proportion to the array.
    """

    def running(part: Column) -> Column:
        step = lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, combine(F.element_at(a, -1), x)).otherwise(x)))
        return F.aggregate(part, F.slice(part, 1, 0), step)

    def taken_up(inner: Column) -> Column:
        def joined(totals: Column) -> Column:
            whole = lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: combine(F.get(totals, i - 1), x)))
            return F.flatten(F.transform(inner, whole))

        return F.when(F.size(inner) == 1, inner[0]).otherwise(bound(running(F.transform(inner, lambda c: F.element_at(c, -1))), joined))

    def scan(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda i: F.slice(v, i * chunk + 1, chunk))
        return F.when(F.size(v) == 0, v).otherwise(bound(F.transform(parts, running), taken_up))

    return bound(values, scan)
