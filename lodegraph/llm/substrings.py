"""Substring dedup by seed and extend: winnowed anchors are joined, seeds that meet are extended, repeats are cut out."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import keep_words, mixed, sliding_min, windows, word_hashes
from .common import documents, stored, without

SEED = 5
#: Windows of one run at most.
RUN = 16
#: Windows that are combined before a shuffle at one time.
CHUNK = 1_000_000
#: Flags of a run in its lowest bits, under its size and its place: it waits for its windows to be compared; it is known
#: to repeat.
LOOK, KNOWN, SIZE_AT, PLACE_AT = 1, 2, 2, 7


def runs_of(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of each window, hash of each window, start of each run) of a text's word hashes.

    The anchor of a window is the least hash among its seeds, so equal windows have equal anchors wherever they stand.
    Neighbouring windows with one anchor form a run: all extensions of that seed which are ``n`` words long.
    """
    anchor, window = sliding_min(windows(h, SEED), n - SEED + 1), windows(h, n)
    start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(start, len(anchor)))
    if (size > RUN).any():
        start = np.concatenate([np.arange(s, s + m, RUN) for s, m in zip(start, size, strict=True)])
    return anchor, window, start


def least_doc(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the smallest document among the rows that have its value."""
    order = np.lexsort((doc, value))
    fresh = np.append(True, value[order][1:] != value[order][:-1])[: len(order)]
    out = np.empty_like(doc)
    out[order] = doc[order][fresh][np.cumsum(fresh) - 1]
    return out


def scattered(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys for rows that are settled and need not meet any other."""
    return mixed(doc.astype(np.uint64) * np.uint64(31) + place.astype(np.uint64))


def seed_rows(part: list) -> pa.RecordBatch:
    """(key, whole, doc, at) of runs. Of equal runs here only those of the smallest document are still asked about."""
    doc = np.repeat(np.array([p[0] for p in part], np.int64), [len(p[3]) for p in part])
    window = np.concatenate([p[2] for p in part])
    base = np.cumsum([0, *[len(p[2]) for p in part]])
    start = np.concatenate([p[3] + b for p, b in zip(part, base, strict=False)])
    place = np.concatenate([p[3] for p in part]).astype(np.int64)
    anchor = np.concatenate([p[1] for p in part])[start]
    size = np.diff(np.append(start, len(window)))
    inside = (np.arange(len(window)) - np.repeat(start, size)).astype(np.uint64)
    whole = np.add.reduceat(mixed(window + inside * np.uint64(0x2545F4914F6CDD1D)), start) + size.astype(np.uint64)
    known = doc > least_doc(whole ^ anchor, doc)
    at = place << PLACE_AT | size << SIZE_AT | np.where(known, KNOWN, 0)
    key = np.where(known, scattered(doc, place), anchor)
    columns = [key.view(np.int64), np.where(known, np.uint64(0), whole).view(np.int64), doc, at]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "whole", "doc", "at"])


def find_seeds(n: int):
    def find(batches):
        part, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if doc is None or text is None or len(h := word_hashes(text.encode())) < n:
                    continue
                part.append((doc, *runs_of(h, n)))
                size += len(h)
                if size >= CHUNK:
                    yield seed_rows(part)
                    part, size = [], 0
        if part:
            yield seed_rows(part)

    return find


def join_seeds(batches):
    """Rows in the order of (key, whole, doc) -> (doc, at) of runs that repeat as a whole, and of those to look into.

    Runs of one anchor that are equal as a whole follow each other: those behind the smallest document repeat. If an
    anchor has several kinds of runs, the first of each kind may share some windows with another kind. One run and its
    equals in one document are carried from batch to batch, however many documents an anchor has.
    """
    last_key = last_whole = last_doc = None
    held, several = [], False
    for batch in batches:
        columns = [batch[c].to_numpy() for c in ("key", "whole", "doc", "at")]
        settled = columns[3] & KNOWN > 0
        out = [(columns[2][settled], columns[3][settled])]
        key, whole, doc, at = (c[~settled] for c in columns)
        if len(key):
            new_key = np.append(key[0] != last_key, key[1:] != key[:-1])
            new_kind = new_key | np.append(whole[0] != last_whole, whole[1:] != whole[:-1])
            kind, group = np.cumsum(new_kind) - 1, np.cumsum(new_key) - 1
            goes_on = not new_key[0]
            if new_kind[0]:
                least = doc[new_kind][kind]
            else:
                least = np.append(last_doc, doc[new_kind])[kind + 1]
            if goes_on:
                group = group + 1
            kinds = np.bincount(group, new_kind, minlength=group[-1] + 1)
            if goes_on:
                kinds[0] += 2 if several else 1
            first, many = doc == least, kinds[group] > 1
            out.append((doc[~first], at[~first]))
            if goes_on and kinds[0] > 1 and held:
                out += [(d, a | LOOK) for d, a in held]
                held = []
            out.append((doc[first & many], at[first & many] | LOOK))
            open_key = group == group[-1]
            if not (goes_on and group[-1] == 0):
                held = []
            several = kinds[group[-1]] > 1
            if not several:
                held.append((doc[open_key & first], at[open_key & first]))
            last_key, last_whole, last_doc = key[-1], whole[-1], least[-1]
        doc, at = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], names=["doc", "at"])


def window_rows(part: list) -> pa.RecordBatch:
    """(key, doc, at) of windows. Of equal windows here only those of the smallest document are still asked about."""
    doc = np.repeat(np.array([p[0] for p in part], np.int64), [len(p[1]) for p in part])
    window, place = (np.concatenate([p[i] for p in part]) for i in (1, 2))
    known = doc > least_doc(window, doc)
    key = np.where(known, scattered(doc, place), window).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(place << 1 | known)], names=["key", "doc", "at"])


def extend_seeds(n: int):
    """(doc_id, text, sd_at) -> (key, doc, at): a run to look into is extended to its windows, by the words themselves."""

    def extend(batches):
        part, size = [], 0
        for batch in batches:
            for doc, text, at in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["sd_at"], strict=True):
                if doc is None or text is None or not at.is_valid:
                    continue
                at = at.values.to_numpy()
                at = at[at & LOOK > 0]
                if not len(at):
                    continue
                w = windows(word_hashes(text.encode()), n)
                place = np.unique(places(at))
                place = place[place < len(w)]
                part.append((doc, w[place], place))
                size += len(place)
                if size >= CHUNK:
                    yield window_rows(part)
                    part, size = [], 0
        if part:
            yield window_rows(part)

    return extend


def join_windows(batches):
    """Rows in the order of (key, doc) -> (doc, at): the windows that a smaller document has."""
    last = least_last = None
    for batch in batches:
        key, doc, at = (batch[c].to_numpy() for c in ("key", "doc", "at"))
        if not len(key):
            continue
        fresh = np.append(key[0] != last, key[1:] != key[:-1])
        least = doc[fresh][np.cumsum(fresh) - 1] if fresh[0] else np.append(least_last, doc[fresh])[np.cumsum(fresh)]
        hit = (at & 1 > 0) | (doc > least)
        last, least_last = key[-1], least[-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(at[hit] >> 1)], names=["doc", "at"])


def places(at: np.ndarray) -> np.ndarray:
    """The windows of some runs."""
    size = at >> SIZE_AT & (1 << PLACE_AT - SIZE_AT) - 1
    first = np.repeat(at >> PLACE_AT, size)
    return first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)


def by_document(found: DataFrame, out: str) -> DataFrame:
    return found.groupBy(F.col("doc").alias(f"{out}_doc")).agg(F.collect_list("at").alias(out))


def repeats(docs: DataFrame, n: int = 13) -> DataFrame:
    """``docs`` with sd_at and sd_windows: the runs and the single windows that each document repeats of a smaller one.

    Texts are shuffled once, by their ids; runs and windows are joined in streams that are sorted by key, so no anchor
    and no passage is gathered, however many documents share it.
    """
    ship(docs.sparkSession)
    whole_id = F.col("doc_id").cast("long")
    seeds = docs.select(whole_id.alias("doc_id"), "text").mapInArrow(find_seeds(n), "key long, whole long, doc long, at long")
    seeds = seeds.repartition("key").sortWithinPartitions("key", "whole", "doc").mapInArrow(join_seeds, "doc long, at long")
    seeds = stored(by_document(seeds, "sd_at"))
    d = docs.join(seeds, whole_id == F.col("sd_at_doc"), "left").drop("sd_at_doc")
    found = d.select(whole_id.alias("doc_id"), "text", "sd_at").mapInArrow(extend_seeds(n), "key long, doc long, at long")
    found = found.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(join_windows, "doc long, at long")
    return d.join(by_document(found, "sd_windows"), whole_id == F.col("sd_windows_doc"), "left").drop("sd_windows_doc")


def dedup_substrings(docs: DataFrame, n: int = 13) -> DataFrame:
    """Documents with ``n_words``, ``n_removed``, ``repeats`` and ``kept_text``.

    ``repeats`` holds (start, end) of maximal passages, in words, of which every window of ``n`` words also stands in a
    document with a smaller id; ``kept_text`` is the other words joined by one space. Windows are judged on the input.

    Seeds are hashes of five words, winnowed so that each window of ``n`` words has an anchor. Documents are joined on
    anchors; where a seed's whole run of extensions is equal, it repeats as it is, and where an anchor's runs differ, each
    is extended both ways to its single windows, which are joined in turn. Repeated windows that touch are one maximal
    passage. Runs are held equal if 64-bit hashes of the anchor and of all their windows are, windows if 64-bit hashes of
    their words are.

    Null text has no words. A null id is no smaller one: such rows lose nothing and take nothing. Rows with one id are
    not smaller than each other; what any of them repeats is cut, by position, from all of them. Equal rows of different
    ids are no tie: the smallest id keeps its words. Extra columns stay, those named like an output are replaced. An
    empty table gives an empty table. A very long text is hashed in pieces; its hashes are one array in its task.
    """

    @F.pandas_udf("n_words long, n_removed long, repeats array<struct<start:bigint,end:bigint>>, kept_text string")
    def cut(texts: pd.Series, runs: pd.Series, single: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at, one in zip(texts, runs, single, strict=True):
            data = (text or "").encode()
            n_words = len(data.split()) if len(data) < 1 << 20 else len(word_hashes(data))
            change = np.zeros(n_words + 1, np.int64)
            at, one = (np.asarray([] if x is None else x, np.int64) for x in (at, one))
            start = np.unique(np.concatenate([places(at[at & LOOK == 0]), one]))
            start = start[start + n <= n_words]
            change[start] += 1
            np.add.at(change, start + n, -1)
            gone = np.cumsum(change)[:n_words] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            rows.append((n_words, int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)], keep_words(data, gone)))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "repeats", "kept_text"])

    d = repeats(without(docs, "n_words", "n_removed", "repeats", "kept_text", "sd_at", "sd_windows"), n)
    return d.withColumn("sd_cut", cut("text", "sd_at", "sd_windows")).select("*", "sd_cut.*").drop("sd_cut", "sd_at", "sd_windows")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p WHERE i + 12 <= len(w)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
r AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(13)) AS k) WHERE first < doc_id),
s AS (SELECT p.doc_id, count(r.i) AS n_removed,
             coalesce(string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (r.i IS NULL), '') AS kept
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
