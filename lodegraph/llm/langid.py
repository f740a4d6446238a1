"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship
from .arrays import release
from .common import SALTS, documents, without

UNKNOWN = "und"
#: Characters that are counted at one time.
PIECE = 1 << 18
#: Distinct n-grams whose counts a task holds before it passes them on.
HELD = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0 (a word boundary)."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def packed(gram: str) -> int:
    """An n-gram of up to three characters as one number, 21 bits each; a boundary is 0. Different n-grams differ."""
    codes = [0 if c == " " else ord(c) for c in gram]
    return len(gram) << 61 | sum(c << 21 * k for k, c in enumerate(reversed(codes)))


def totals(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, in order, with the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a text, exactly: one, two and three characters of words with a boundary at either end, at least
    one of them a letter. Long texts are counted in pieces that overlap by two characters."""
    parts, text = [], f" {text.lower()} "
    for at in range(0, len(text), PIECE):
        own = text[at : at + PIECE + 2]
        c = _letters()[np.frombuffer(own.encode("utf-32-le", "replace"), np.uint32)]
        n = min(PIECE, len(c))
        a, b, z = (np.append(c, [0, 0])[k : k + n] for k in range(3))
        one, two, three = a > 0, (a > 0) | (b > 0), b > 0
        two &= (np.arange(n) + at) < len(text) - 1
        three &= (np.arange(n) + at) < len(text) - 2
        pair = a << 21 | b
        grams = np.concatenate([a[one] | 1 << 61, pair[two] | 2 << 61, (pair[three] << 21 | z[three]) | 3 << 61])
        grams.sort()
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
        parts.append((grams[first], np.diff(np.append(first, len(grams)))))
    return parts[0] if len(parts) == 1 else totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by their number."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


def fit_profiles(docs: DataFrame, size: int = 300, max_langs: int = 100_000) -> dict[str, list[int]]:
    """{lang: its ``size`` most frequent n-grams}, counted over all documents with a text and a ``lang``.

    Counts are summed per task, as many as ``HELD`` at a time, then per n-gram of a language. Only profiles, of fixed size,
    reach the driver; more than ``max_langs`` languages are an error. Ties go by the n-gram's number.
    """

    def told(held):
        for lang, parts in held.items():
            grams, counts = totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    def count(batches):
        held: dict[str, list] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = held.setdefault(lang, [])
                own.append(gram_counts(text))
                n += len(own[-1][0])
                if n >= HELD:
                    held = {k: [totals(*(np.concatenate(x) for x in zip(*v, strict=True)))] for k, v in held.items()}
                    n = sum(len(v[0][0]) for v in held.values())
                    if 2 * n >= HELD:
                        yield from told(held)
                        held, n = {}, 0
        yield from told(held)
        release()

    ship(docs.sparkSession)
    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    d = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent of each part of a language, then those of the language, so that no language is one task's work.
    d = d.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    for by in (["lang", "part"], ["lang"]):
        d = d.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= size)
    rows = d.select("lang", "gram", "r").limit(size * max_langs + 1).collect()
    if len(rows) > size * max_langs:
        raise ValueError(f"more than {max_langs} languages")
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = 300) -> DataFrame:
    """Documents with ``lang_pred`` and ``score``.

    A document's most frequent n-grams are compared with each profile: the distance is the sum of the differences of
    their ranks, ``size`` for those that a profile lacks. ``score`` is 1 less the least distance over the greatest
    possible one. Ties go to the language that sorts first.

    Null text, text without a letter, and any text where no profile is known: ``und`` with score 0. Only ``text`` is
    read; repeated rows get equal answers; extra columns stay, those named like an output are replaced. An empty table gives
    an empty table; a very long text is counted in pieces.
    """
    ship(docs.sparkSession)
    langs = sorted(profiles)
    # Entries (n-gram, language, rank) by n-gram: as many as the profiles have.
    entry = np.array([(g, i, r) for i, lang in enumerate(langs) for r, g in enumerate(profiles[lang][:size])], np.int64).reshape(-1, 3)
    entry = entry[np.argsort(entry[:, 0], kind="stable")]
    gram, of, rank = (np.ascontiguousarray(entry[:, k]) for k in range(3))

    def one(text: str | None) -> tuple[str, float]:
        top = top_grams(*gram_counts(text), size) if text is not None and langs else ()
        if not len(top):
            return UNKNOWN, 0.0
        begin, end = np.searchsorted(gram, top), np.searchsorted(gram, top, "right")
        n = end - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        saved = size - np.abs(rank[at] - np.repeat(np.arange(len(top)), n))
        far = size * len(top) - np.bincount(of[at], saved, len(langs)).astype(np.int64)
        best = int(np.argmin(far))
        return langs[best], float(1 - far[best] / (size * len(top)))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])
        release()
        return out

    d = without(docs, "lang_pred", "score", "li_found").withColumn("li_found", predict("text"))
    return d.select("*", "li_found.lang_pred", "li_found.score").drop("li_found")


def held_out():
    """True for the third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame) -> dict[str, list[int]]:
    return fit_profiles(docs.filter(~held_out()))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), learned(docs.select("doc_id", "lang", "text")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
