"""Document rules on divergence from a language's usual text.

For each language the characters' classes and the most common words of all its documents are
counted. A document's own counts are compared with them by the Jensen-Shannon distance. Short
documents have too few characters or words for a histogram, so each comparison has a least length.
Base rules on length and repetition come first. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.llm.store import stored

COMMON = 24
LANGUAGES = 256
LEAST_CHARS = 400
LEAST_WORDS = 100
MOST_CLASSES = 0.30
# No document may lie further from the common words than this. Where a language's common words are
# expected LEAST_EXPECTED times in all, neither may it reach this part of the distance of a document
# that has none of them: below that number chance alone takes clean documents as far.
MOST_COMMON = 0.60
PART_OF_NONE = 0.8
LEAST_EXPECTED = 24
# Lower-case letters, then the other character classes, in the order of the counts.
LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = {"upper": LOWER.upper(), "digit": "0123456789", "space": " \t\n\x0b\x0c\r", "symbol": "#*$%&|<>{}[]=_~^@\\/+"}
SYMBOLS = "#*$%&|<>"
# A letter for each place among a language's common words, after one for none of them.
PLACES = "-" + LOWER[:COMMON]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _fewer(before: Column, after: Column) -> Column:
    return (F.length(before) - F.length(after)).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def with_repeated_words(frame: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds the number of words inside 3-word windows that occur twice or more.

    ``hashes`` has the 64-bit hash of every window in order. Windows are sorted by hash with their
    place; equal neighbours are the repeated ones. The k-th place in order covers up to 3 new words.
    Each step is a column of its own, so that none is computed more than once.
    """
    column = F.col(hashes)
    some = F.size(F.array_distinct(column)) < F.size(column)
    placed = F.sort_array(F.transform(column, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size("_placed")
    pairs = F.zip_with(
        F.slice("_placed", F.lit(1), n - 1),
        F.slice("_placed", F.lit(2), n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    m = F.size("_places")
    gaps = F.zip_with(
        F.slice("_places", F.lit(1), m - 1), F.slice("_places", F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(3))
    )
    covered = F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap)
    steps = frame.withColumn("_placed", F.when(some, placed)).withColumn("_places", F.when(n > 1, places))
    counted = F.when(m > 1, covered).otherwise(F.lit(0)).cast("long")
    return steps.withColumn(name, counted).drop("_placed", "_places")


def _total(counts: Column) -> Column:
    return F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))


def _shares(counts: Column, n: Column) -> Column:
    # The total is an array beside the counts: inside a lambda it would be summed again for each.
    return F.zip_with(counts, F.array_repeat(_total(counts), n), lambda c, total: c / total)


def distance(counts: Column, usual: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between counts and an array of shares."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(_shares(counts, F.size(usual)), usual, lambda p, q: part(p, q) + part(q, p))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _measured(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Text, language, ``_classes``: characters of each class, and all others, and ``_symbols``.

    A class is counted by what the text loses with it; each is taken from what the ones before left, the
    usual ones first, so that only the first pass is made over the whole text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*keep, F.coalesce("lang", F.lit("")).alias("_lang"), text.alias("_text"))
    before, counted = "_text", {}
    for name in ("lower", "space", "upper", "digit", "symbol"):
        after = f"_without_{name}"
        rows = rows.withColumn(after, _without(F.col(before), LOWER if name == "lower" else CLASSES[name]))
        before, counted[name] = after, _fewer(F.col(before), F.col(after))
    marks = F.col("_without_digit")
    return rows.select(
        *keep, "_lang", "_text", counted["space"].alias("_space"), _fewer(marks, _without(marks, SYMBOLS)).alias("_symbols"),
        F.array(*[counted[name] for name in ("lower", *CLASSES)], F.length(before).cast("long")).alias("_classes"),
    )


def references(documents: DataFrame) -> DataFrame:
    """One row per language: number of documents, class shares, common words, their shares and limit.

    The limit is ``PART_OF_NONE`` of the distance of a document with none of the common words. All
    documents of a language count.
    """
    rows = _measured(documents, [])
    n = len(CLASSES) + 2
    classes = rows.groupBy("_lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(n)]
    )
    counted = rows.select("_lang", F.explode(words_of(F.lower("_text"))).alias("w")).groupBy("_lang", "w").agg(
        F.count(F.lit(1)).alias("k")
    )
    totals = counted.groupBy("_lang").agg(F.sum("k").alias("total"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("k"), "w"))
    first = counted.withColumn("_place", place).where(F.col("_place") <= COMMON)
    tops = first.groupBy("_lang").agg(F.collect_list(F.struct("w", "k")).alias("top"))
    common = totals.join(tops, "_lang")
    joined = classes.join(common, "_lang", "left")
    top = F.coalesce("top", F.expr("array()").cast("array<struct<w:string,k:bigint>>"))
    known = F.transform(top, lambda t: t["k"])
    rest = F.coalesce("total", F.lit(0)) - F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x)
    shared = joined.select(
        "_lang",
        F.col("n").alias("documents"),
        _shares(F.array(*[F.col(f"c{i}") for i in range(n)]), F.lit(n)).alias("classes"),
        F.transform(top, lambda t: t["w"]).alias("words"),
        _shares(F.concat(known, F.array(rest)), F.size(top) + 1).alias("shares"),
    )
    none = F.concat(F.array_repeat(F.lit(0).cast("long"), F.size("words")), F.array(F.lit(1).cast("long")))
    limit = F.least(PART_OF_NONE * distance(none, F.col("shares")), F.lit(MOST_COMMON))
    return shared.withColumn("limit", limit)


def _with_reference(documents: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """Documents with the reference of their language in ``_usual``, and the common words of any language.

    The words, ``COMMON`` a language, are None beyond ``LANGUAGES`` languages.

    The ``LANGUAGES`` languages with most documents are found in a map at every task, so that their
    documents are not shuffled. Each other language has a small part of the documents at most; those
    are joined to the references by language.
    """
    usual = stored(references(documents), "language-references")
    fields = ["classes", "words", "shares", "limit"]
    entry = F.struct(F.col("_lang").alias("key"), F.struct(*fields).alias("value"))
    most = usual.orderBy(F.desc("documents"), "_lang").limit(LANGUAGES)
    known = most.agg(F.map_from_entries(F.collect_list(entry)).alias("known")).scalar()
    lang = F.coalesce("lang", F.lit(""))
    if usual.count() <= LANGUAGES:
        words = [r["w"] for r in usual.select(F.explode("words").alias("w")).distinct().collect()]
        return _measured(documents, ["doc_id"]).withColumn("_usual", F.element_at(known, F.col("_lang"))), words
    often = _measured(documents.where(F.map_contains_key(known, lang)), ["doc_id"])
    seldom = _measured(documents.where(~F.map_contains_key(known, lang)), ["doc_id"])
    joined = seldom.join(usual.select("_lang", F.struct(*fields).alias("_usual")), "_lang").select(*seldom.columns, "_usual")
    return often.withColumn("_usual", F.element_at(known, F.col("_lang"))).unionByName(joined), None


def rule_values(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, common_distance (null where too short), kept.

    Null texts have no words, null languages are one language. Repeated rows, ids and null ids are
    rows of their own. An empty table gives no rows.
    """
    rows, any_common = _with_reference(documents)
    cut = rows.withColumn("_words", words_of(F.col("_text")))
    n = F.size("_words")
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    pairs = F.zip_with(
        F.slice("_hashes", F.lit(1), n - 2), F.slice("_hashes", F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b)
    )
    windows = F.zip_with(pairs, F.slice("_hashes", F.lit(3), n - 2), lambda a, b: F.xxhash64(a, b))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    usual = F.col("_usual")
    counted = cut.withColumn("_hashes", hashes).select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.length("_text") - F.col("_space")).cast("long").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
        F.length("_text").alias("_chars"),
        "_classes",
        words_of(F.lower("_text")).alias("_words"),
        usual["words"].alias("_common"),
        usual["classes"].alias("_class_shares"),
        usual["shares"].alias("_shares"),
        usual["limit"].alias("_limit"),
    )
    # Words that are common in no language are told by one look into a set; the others have a place among their own.
    listed = F.col("_words") if any_common is None else F.filter("_words", lambda w: w.isin(any_common))
    # A letter per word tells its place: one letter is taken out of a text more quickly than a number out of an array.
    letters = F.transform(listed, lambda w: F.substr(F.lit(PLACES), F.array_position("_common", w) + 1, F.lit(1)))
    coded = counted.withColumn("_letters", F.array_join(letters, ""))
    known = F.transform(
        F.sequence(F.lit(1), F.size("_common")),
        lambda k: _fewer(F.col("_letters"), F.replace("_letters", F.substr(F.lit(PLACES), k + 1, F.lit(1)), F.lit(""))),
    )
    others = F.size("_words") - F.length(F.replace("_letters", F.lit(PLACES[0]), F.lit("")))
    own = F.concat(known, F.array(others.cast("long")))
    some = F.size("_common") > 0
    expected = F.col("n_words") * (1 - F.element_at("_shares", -1))
    valued = with_repeated_words(coded.withColumn("_own", own), "_windows", "n_repeat_words").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words",
        F.when(F.col("_chars") >= LEAST_CHARS, distance(F.col("_classes"), F.col("_class_shares"))).alias(
            "class_distance"
        ),
        F.when(some & (F.col("n_words") >= LEAST_WORDS), distance(F.col("_own"), F.col("_shares"))).alias("common_distance"),
        F.when(some & (expected >= LEAST_EXPECTED), F.col("_limit")).otherwise(F.lit(MOST_COMMON)).alias("_limit"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > MOST_CLASSES, F.lit(False)) | F.coalesce(
        F.col("common_distance") > F.col("_limit"), F.lit(False)
    )
    return valued.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "common_distance",
    )
