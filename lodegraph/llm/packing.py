"""Best-fit packing: documents cut into pieces and packed into sequences by minimum bin slack."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .arrays import release
from .common import documents, salted_rank, stored, without

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Words whose ids a worker remembers before it forgets them all.
REMEMBER = 100_000
_known: dict[str, bytes] = {}
_known_of = ""
# What a vocabulary does to a text if the ids of its words, encoded apart, are those of the text.
WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"},
}


@lru_cache(2)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@lru_cache(2)
def word_wise(name: str) -> bool:
    """True for a vocabulary whose file says that words may be encoded apart; texts of any other are encoded whole."""
    spec = json.loads(_tokenizer(name).to_str())
    model = {k: spec["model"].get(k) for k in WORD_WISE["model"]}
    return {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "model": model} == WORD_WISE


@lru_cache(2)
def _word_ends(name: str) -> np.ndarray:
    """Which ids end a word."""
    vocabulary = _tokenizer(name).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        ends[i] = token.endswith("</w>")
    return ends


@lru_cache(2)
def _model(name: str):
    return _tokenizer(name).model


def _cut(words: list[str], ids: list[int], ends: list[int]) -> None:
    """``_known`` of words from their ids one after the other, and how many of them lie before the end of each word."""
    data, last = np.array(ids, "<u4").tobytes(), 0
    for w, end in zip(words, ends, strict=True):
        _known[w], last = data[4 * last : 4 * end], end


def _bytes_as_letters() -> dict[int, str]:
    """What the vocabulary writes for each byte: printable bytes stand for themselves, others for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _bytes_as_letters()


def _learn(words: Iterable[str], name: str) -> None:
    """Encode words into ``_known``.

    Lower-case Latin letters (below U+0250 all are their own normal form) are what the vocabulary's model itself takes, once
    their bytes are written as letters, so they skip the steps around it. Other words of letters only end with one word end each, so
    they are encoded together; marks behind letters are a word of their own to the vocabulary, and are encoded apart.
    """
    tokenize, letters, odd, stems = _model(name).tokenize, [], [], {}
    for w in words:
        s = w if w.isalpha() else w.rstrip(punctuation)
        if not s.isalpha() or not (s.isascii() or s.lower().isalpha()):  # a letter that lowers to a letter and a mark
            odd.append(w)
            continue
        if s is not w:
            stems[w] = s
        if s in _known:
            continue
        if s.isascii():
            _known[s] = array("I", [t.id for t in tokenize(s.lower())]).tobytes()
        elif max(s) < "\u0250" and s.lower() == s:
            _known[s] = array("I", [t.id for t in tokenize(s.encode().decode("latin-1").translate(BYTES))]).tobytes()
        else:
            letters.append(s)
    for at in range(0, len(letters), 2048):
        part = letters[at : at + 2048]
        ids = _tokenizer(name).encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
        _cut(part, ids, (np.flatnonzero(_word_ends(name)[ids]) + 1).tolist())
    odd = list({*odd, *(w[len(s) :] for w, s in stems.items())}.difference(_known))
    for w, e in zip(odd, _tokenizer(name).encode_batch_fast(odd, add_special_tokens=False), strict=True):
        _known[w] = np.array(e.ids, "<u4").tobytes()
    for w, s in stems.items():
        _known[w] = _known[s] + _known[w[len(s) :]]


def token_ids(text: str, name: str, wise: bool | None = None) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers.

    A vocabulary that is ``word_wise`` lower-cases, drops white space and never joins across it, so a text's ids are its
    words' ids one after the other, and each word is encoded once. Texts with separators that are white space to Python
    only, and all texts of other vocabularies, are encoded whole. ``wise`` is what ``word_wise`` says, where that is known: to find
    it takes the vocabulary as JSON, which each worker need not hold.
    """
    global _known_of
    if not (word_wise(name) if wise is None else wise) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return np.array(_tokenizer(name).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if _known_of != name:
        _known.clear()
        _known_of = name
    if "\u0130" not in text and "\u03a3" not in text:  # letters that lower otherwise in a word than alone
        text = text.lower()
    words = text.split()
    new = set(words).difference(_known)
    if new:
        if len(_known) + 2 * len(new) > REMEMBER:
            _known.clear()
            new = set(words)
        _learn(new, name)
    return b"".join(map(_known.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id 0, cut every ``capacity``."""
    ship(docs.sparkSession)
    kind, wise = docs.schema["doc_id"].dataType.simpleString(), word_wise(tokenizer)

    def cut(batches):
        for batch in batches:
            fields = [batch.schema.field("doc_id"), pa.field("piece", pa.int32())]
            fields += [pa.field(k, pa.int64()) for k in ("start", "length", "ids_crc32")]
            schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.int64()))] * keep_ids)
            rows = [[] for _ in schema]
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = token_ids(text or "", tokenizer, wise) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (i, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, x in zip(rows, row, strict=False):
                        column.append(x)
                    if keep_ids:
                        rows[-1].append(np.frombuffer(part, "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
        _known.clear()  # the worker goes on to other steps
        release()

    ids = ", ids array<bigint>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")


def fullest(left: int, counts: dict[int, int], order: list[int]) -> dict[int, int]:
    """The fullest feasible combination of lengths for ``left``: {length: uses}. Long pieces are preferred.

    Bit s of an integer says that some combination has the sum s; a length with several pieces enters in powers of two.
    """
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for n in order:
        if n > left:
            continue
        have, power = min(counts[n], left // n), 1
        while have:
            take = min(power, have)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            have, power = have - take, power * 2
        if reach >> left & 1:
            break
    best, uses = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> best & 1:
            uses[n] = uses.get(n, 0) + take
            best -= n * take
    return uses


def bin_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, longest first) and how many sequences have each.

    Each pattern holds the longest piece left and the fullest combination for the rest; it is used as often as its
    lengths last. The work depends on the number of distinct lengths, not of pieces.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while counts:
        order = sorted(counts, reverse=True)
        longest = order[0]
        counts[longest] -= 1
        uses = fullest(capacity - longest, {n: c for n, c in counts.items() if c}, [n for n in order if counts[n]])
        counts[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(counts[n] // u for n, u in uses.items())
        out.append(([n for n in sorted(uses, reverse=True) for _ in range(uses[n])], times))
        for n, u in uses.items():
            counts[n] -= u * times
            if not counts[n]:
                del counts[n]
    return out


def slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{length: (first rank, first sequence, offset) of each run of its pieces, by rank}."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for n, runs in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Only the counts of lengths, ``capacity`` at most, reach the driver, which plans patterns. Pieces of a length are
    numbered in parts by their document, so that a length that a third of all pieces have is not gathered in one task,
    and a piece's number finds its sequence in the plan.
    """
    parts = stored(parts)
    plan = slots(bin_plan({r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}, capacity))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(256)), F.lit(0))
    ranked = salted_rank(parts, ["length"], ["doc_id", "piece", "ids_crc32"], salt, "bp_rank")
    shape = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["bp_rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                first, to, at = plan[int(length[own[0]])]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = to[run] + rank[own] - first[run], at[run]
            rest = batch.drop_columns(["bp_rank"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(sequence), pa.array(offset)], names=[*rest.schema.names, "sequence_id", "offset"])

    return ranked.select(*parts.columns, "bp_rank").mapInArrow(place, shape)


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null text is empty: its document is the end id alone. Documents over ``capacity`` are cut, others never. Rows that
    repeat, null ids too, are documents of their own; pieces of one length are a tie, which goes by document and piece. A
    very long text is many pieces. Extra columns are ignored. An empty table has no piece. Any tokenizer file of the
    library ``tokenizers`` will do; ids are those of the whole text.
    """
    return pack(pieces(docs, tokenizer, capacity, keep_ids), capacity)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(without(documents(spark, sf_dir), "length"))
