"""Quality rules: counts that any language has, then the divergence of a text from its language's reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, WORD, documents, stored, without

#: Classes of characters, taken away one after the other; what is left is the last class, "other".
CLASSES = (
    ("space", SPACE), ("lower", r"[a-z]+"), ("upper", r"[A-Z]+"), ("stop", r"[.,;:!?'\"()-]+"), ("digit", r"[0-9]+"),
    ("letter", r"\p{L}+"), ("symbol", r"[\p{S}\p{P}]+"),
)
SYMBOLS = "#*$%&|<>"
#: Where a word starts, and what may follow its letters.
START, END = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D.,;:!?])"
#: The letters of a word that is all letters but for a mark behind them.
LETTERS = r"^(\p{L}++)" + END


def words_of(text: str) -> Column:
    """The words of a text: a split at one plain character runs no pattern."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def class_counts(d: DataFrame, text: str, solid: str) -> DataFrame:
    """Adds ``qr_classes``, the characters of each class, and ``qr_symbols``; each pattern runs over what was left.

    ``solid`` is the text without white space, in which letters of one case stand in longer runs.
    """
    left, lengths = solid, [F.length(text), F.length(solid)]
    for i, (name, pattern) in enumerate(CLASSES):
        if name == "space":
            continue
        if name == "stop":  # no symbol is among what is gone by now, and little of the text is left
            d = d.withColumn("qr_symbols", F.regexp_count(left, F.lit(f"[{SYMBOLS}]")).cast("long"))
        d = d.withColumn(f"qr_left{i}", F.regexp_replace(left, pattern, ""))
        left = f"qr_left{i}"
        lengths.append(F.length(left))
    counts = [a - b for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1]]
    d = d.withColumn("qr_classes", F.array(*[c.cast("double") for c in counts]))
    return d.drop(*[f"qr_left{i}" for i in range(len(CLASSES))])


def letters_of(word: Column) -> Column:
    """The letters of a word in lower case, of any length; '' for a word that holds anything else."""
    return F.regexp_extract(F.lower(word), LETTERS, 1)


def references(docs: DataFrame, n_common: int = 24) -> DataFrame:
    """(qr_lang, qr_place, qr_ref_classes, qr_common, qr_ref_common, qr_pattern) from all of ``docs``, by their ``lang``.

    Every language has a reference, and all documents together have the one of a null language: both are rolled up from
    one table of classes and one of words. Rows are of fixed width; ``qr_place`` is 0 for the null language and numbers
    the others from that with most characters on.
    """
    d = docs.filter("text IS NOT NULL").select(F.col("lang").alias("qr_lang"), F.col("text").alias("qr_text"))
    names = [f"c{i}" for i in range(len(CLASSES) + 1)]
    # Words are counted as they stand; classes and letters are looked at for distinct ones only. White space is the rest.
    words = d.select("qr_lang", F.explode(words_of("qr_text")).alias("raw"))
    words = class_counts(words.groupBy("qr_lang", "raw").agg(F.count("*").alias("n")), "raw", "raw")
    words = words.groupBy("qr_lang", letters_of(F.col("raw")).alias("w")).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("qr_classes")[i]).alias(c) for i, c in enumerate(names)])
    words = stored(words)
    pooled = stored(words.groupBy("w").agg(F.sum("n").alias("n")))
    sizes = d.groupBy("qr_lang").agg(F.sum(F.length("qr_text")).cast("double").alias("size"))
    by_lang = sizes.join(words.groupBy(F.col("qr_lang").alias("of")).agg(*[F.sum(c).alias(c) for c in names]), F.col("qr_lang").eqNullSafe(F.col("of")), "left")
    space = names[[name for name, _ in CLASSES].index("space")]
    by_lang = by_lang.select("qr_lang", "size", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    by_lang = stored(by_lang.withColumn(space, F.col("size") - sum((F.col(c) for c in names if c != space), F.lit(0.0))))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "qr_lang"))
    rows = by_lang.filter("qr_lang IS NOT NULL").withColumn("qr_place", place).select("qr_lang", "qr_place", *names).union(
        by_lang.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit(None).cast("string"), F.lit(0), *names)
    )
    rows = rows.select("qr_lang", "qr_place", F.array(*names).alias("qr_ref_classes"))
    words = words.filter("qr_lang IS NOT NULL").select("qr_lang", "w", "n").unionByName(
        pooled.select(F.lit(None).cast("string").alias("qr_lang"), "w", "n"))
    total = words.groupBy(F.col("qr_lang").alias("of")).agg(F.sum("n").alias("all"))
    top = Window.partitionBy("qr_lang").orderBy(F.desc("n"), "w")
    words = words.filter("w <> ''").withColumn("r", F.row_number().over(top)).filter(F.col("r") <= n_common)
    words = words.groupBy("qr_lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("x"))
    words = words.join(total, F.col("qr_lang").eqNullSafe(F.col("of")))
    rest = F.col("all") - F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    words = words.select(
        "of", F.transform("x", lambda x: x["w"]).alias("qr_common"),
        F.concat(F.transform("x", lambda x: x["n"].cast("double")), F.array(rest.cast("double"))).alias("qr_ref_common"),
    )
    # The first letters stand in front, where most characters of a text fail at once.
    firsts = F.array_join(F.array_distinct(F.transform("qr_common", lambda w: F.substring(w, 1, 1))), "")
    either = F.concat(F.lit("(?=["), firsts, F.lit(f"]){START}(?:"), F.array_join("qr_common", "|"), F.lit(f"){END}"))
    words = words.withColumn("qr_pattern", either)
    return rows.join(words, F.col("qr_lang").eqNullSafe(F.col("of")), "left").drop("of")


def with_references(d: DataFrame, ref: DataFrame, most: int = 64) -> DataFrame:
    """``d`` with the reference of each row's ``lang``.

    Those of the ``most`` languages with most characters and of null are broadcast; only if there are more languages,
    rows in the others are joined by ``lang``.
    """
    same = F.col("lang").eqNullSafe(F.col("qr_lang"))
    ref = stored(ref)
    if ref.count() <= most + 1:
        return d.join(F.broadcast(ref), same, "left").drop("qr_lang", "qr_place")
    large = ref.filter(F.col("qr_place") <= most)
    rare = d.join(F.broadcast(large.select("qr_lang")), same, "left_anti").join(ref.filter(F.col("qr_place") > most), same, "left")
    return d.join(F.broadcast(large), same).unionByName(rare).drop("qr_lang", "qr_place")


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of counts; null if either sums to 0."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    pair = F.arrays_zip(p.alias("p"), q.alias("q"))

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def term(z: Column) -> Column:
        a, b = z["p"] / z["pt"], z["q"] / z["qt"]
        return (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2

    zipped = F.transform(pair, lambda z: F.struct(
        z["p"].alias("p"), z["q"].alias("q"), total(p).alias("pt"), total(q).alias("qt")))
    sums = F.aggregate(F.transform(zipped, term), F.lit(0.0), lambda a, x: a + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(sums, F.lit(0.0))))


def base_counts(d: DataFrame, text: str = "qr_text") -> DataFrame:
    """n_words, n_dup_lines and n_repeat_words of a column of texts without nulls, and ``qr_solid``, its words joined.

    Windows of five words are compared by a 64-bit hash of the words. Texts that repeat none, nearly all, end at a hash
    set; the others sort their windows, so no text costs more than n log n.
    """
    d = d.withColumn("qr_words", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    # Two words, then twice two, then the fifth; what hangs over the end is cut off.
    both = lambda a, b: F.xxhash64(a, b)
    behind = lambda c, k: F.slice(c, k + 1, F.size("qr_words"))
    d = d.withColumn("qr_hashes", F.zip_with("qr_words", behind("qr_words", 1), both))
    d = d.withColumn("qr_hashes", F.zip_with("qr_hashes", behind("qr_hashes", 2), both))
    windows = F.zip_with("qr_hashes", behind("qr_words", 4), both)
    d = d.withColumn("qr_windows", F.slice(windows, 1, F.greatest(F.size("qr_words") - 4, F.lit(0))))
    d = d.withColumns({"qr_lines": lines, "qr_n": F.size("qr_windows")})
    d = d.withColumn("qr_sorted", F.when(
        F.size(F.array_distinct("qr_windows")) < F.col("qr_n"),
        F.sort_array(F.transform("qr_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    same = lambda x, j: F.coalesce(x["h"] == F.get("qr_sorted", j)["h"], F.lit(False))
    twice = F.filter("qr_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    again = F.sort_array(F.transform(twice, lambda x: x["i"]))
    d = d.withColumn("qr_again", F.coalesce(again, F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("qr_again", lambda s, k: F.least(F.lit(5), F.coalesce(F.get("qr_again", k + 1) - s, F.lit(5)))),
        F.lit(0), lambda a, x: a + x,
    )
    return d.withColumns({
        "n_words": F.size("qr_words").cast("long"),
        "qr_solid": F.array_join("qr_words", ""),
        "n_dup_lines": (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("qr_words", "qr_hashes", "qr_lines", "qr_windows", "qr_n", "qr_sorted", "qr_again")


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
           "common_distance", "kept")


def quality(
    docs: DataFrame,
    max_class: float = 0.3,
    max_common: float = 0.3,
    min_chars: int = 200,
    min_words: int = 50,
    n_common: int = 24,
) -> DataFrame:
    """Documents with their counts, ``base_failed``, two distances and ``kept``.

    A document is compared with its language's reference (with that of all documents if its language is null): the
    histogram of character classes from ``min_chars`` characters on, that of the ``n_common`` most frequent words and
    all others from ``min_words`` words on; below these guards a distance is null and does not speak against a document.

    The bound of 0.3 on the latter is from distances of all rows of sf0.1: of those of ``min_words`` words or more that pass
    the base rules, 17 of 3,233 labelled quality 1 and 226 of 290 labelled quality 0 lie above it.

    Null text counts as empty and fails the base rules, as does any text under ten words. Rows that repeat and rows with
    equal ids are judged each by itself; extra columns stay, those named like an output are replaced. An empty table
    gives an empty table.
    """
    d = without(docs, *OUTPUTS)
    ref = references(d.select("lang", "text"), n_common)
    d = with_references(d.withColumn("qr_text", F.coalesce("text", F.lit(""))), ref)
    d = class_counts(base_counts(d), "qr_text", "qr_solid")
    spaces = F.col("qr_classes")[[name for name, _ in CLASSES].index("space")].cast("long")
    d = d.withColumns({"word_chars": F.length("qr_text").cast("long") - spaces, "n_symbols": F.col("qr_symbols")})
    d = d.withColumn("qr_seen", F.regexp_extract_all(F.lower("qr_text"), F.col("qr_pattern"), F.lit(0)))
    d = d.withColumn("qr_joined", F.concat(F.lit(" "), F.array_join("qr_seen", "  "), F.lit(" ")))
    found = F.transform("qr_common", lambda w: (
        (F.length("qr_joined") - F.length(F.replace(F.col("qr_joined"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
        / (F.length(w) + 2)
    ))
    d = d.withColumn("qr_found", found)
    rest = F.col("n_words") - F.aggregate("qr_found", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("qr_hist", F.concat("qr_found", F.array(rest)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumns({
        "base_failed": failed,
        "class_distance": F.when(F.length("qr_text") >= min_chars, jensen_shannon(F.col("qr_classes"), F.col("qr_ref_classes"))),
        "common_distance": F.when(F.col("n_words") >= min_words, jensen_shannon(F.col("qr_hist"), F.col("qr_ref_common"))),
    })
    fine = F.coalesce(F.col("class_distance") <= max_class, F.lit(True)) & F.coalesce(
        F.col("common_distance") <= max_common, F.lit(True))
    d = d.withColumn("kept", ~F.col("base_failed") & fine)
    return d.drop("qr_text", "qr_ref_classes", "qr_common", "qr_ref_common", "qr_classes", "qr_symbols", "qr_pattern",
                  "qr_solid", "qr_seen", "qr_joined", "qr_found", "qr_hist")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", *OUTPUTS)
