"""Shuffles get more partitions as tables grow, unless the session says how many."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from lodegraph import session
from lodegraph.plans import registry


def test_shuffles_are_dealt_by_the_size_of_tables(spark, small, monkeypatch):
    before = {k: spark.conf.get(k, None) for k in (session.INITIAL, session.JOINED)}
    rows = lambda: sorted(map(tuple, registry.queries()["toc_section"](spark, small).collect()), key=str)
    size = Path(f"{small}/lineitem.parquet").stat().st_size
    want = rows()
    try:
        monkeypatch.setattr(session, "SHARE", size // 50)
        assert rows() == want
        assert int(spark.conf.get(session.INITIAL)) == size // (size // 50) >= 50
        assert spark.conf.get(session.JOINED) == session.JOINED_SIZE
        spark.conf.set(session.INITIAL, "7")
        session.deal(spark, f"{small}/lineitem.parquet")
        assert spark.conf.get(session.INITIAL) == "7"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_kept_tables_leave_no_shuffles(spark):
    """what was shuffled for a table is removed once it is written, and the session's setting stays."""
    told = spark.conf.get(session.CLEANED, None)
    jvm = spark.sparkContext._jvm

    def files():
        dirs = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, fs in os.walk(d.getPath()) for f in fs if f.startswith("shuffle_")}

    d = spark.range(20000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    before = files()
    out, path = session.kept(d)
    assert not files() - before and spark.conf.get(session.CLEANED, None) == told
    assert out.count() == 1000 and out.agg(F.sum("s")).first()[0] == 19999 * 10000
    session.drop(spark, path)
