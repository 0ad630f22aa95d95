"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's common words are compared with those of all
documents of its language (the mean of their shares) by the Jensen-Shannon distance (square root of the divergence to base 2, so 0 to 1).
A rule only judges documents long enough for its histogram; base rules on length and repetition come first.

Null texts are empty texts. A null or unknown language is a language of its own, whose common words are those of all
languages together. Equal rows get equal results; ``doc_id`` is only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.llm.storage import same, small_first, stored

WORD, SEPARATOR = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Character classes counted apart; what is in none (mostly lower-case letters) is the last class.
CLASSES = (SEPARATOR, r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", SYMBOL)
#: Common words of each language (fixed values).
COMMON = {
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "que"),
}
#: Words of a document that the base rules want, and the share of its words in repeated windows they allow (percent).
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: Characters and words from which on a histogram is judged, and the distances allowed.
LEAST_CHARACTERS, LEAST_JUDGED_WORDS = 200, 100
CHARACTER_DISTANCE, WORD_DISTANCE = 0.25, 0.5

#: Bits for a word's position in one number with the other bits of its window's hash.
_BITS = 24


def _array(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``_words``, ``_separators`` to ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = docs.withColumn("_text", text)
    rows = rows.select("*", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
                       F.regexp_count("_text", F.lit(SEPARATOR)).cast("long").alias("_separators"),
                       F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), lines.alias("_lines"))
    rows = rows.select("*", F.size("_words").cast("long").alias("n_words"),
                       (F.char_length("_text") - F.col("_separators")).cast("long").alias("word_chars"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.when(F.size("_words") >= 3, F.slice(F.transform(
                           "_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
                           F.lit(1), F.size("_words") - 2)).otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    rows = rows.drop("_lines")
    # most texts repeat no window; only the others are sorted, by (hash, position) in one number
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    low = F.lit((1 << _BITS) - 1)
    packed = F.when(again & (F.size("_windows") <= 1 << _BITS), F.sort_array(F.transform(
        "_windows", lambda h, i: F.shiftleft(h, _BITS).bitwiseOR(i.cast("bigint")))))
    rows = rows.select("*", packed.alias("_sorted"), again.alias("_again"))
    place = F.transform("_sorted", lambda x: x.bitwiseAND(low).cast("int"))
    # where two windows agree in the bits kept but differ, or a place needs more bits, whole hashes are sorted with their places
    beside = F.transform("_sorted", lambda x, i: (F.shiftright(x, _BITS) == F.shiftright(F.get("_sorted", i + 1), _BITS)) & (
        F.get("_windows", x.bitwiseAND(low).cast("int")) != F.get("_windows", F.get("_sorted", i + 1).bitwiseAND(low).cast("int"))))
    apart = ~F.exists(beside, lambda differs: F.coalesce(differs, F.lit(False)))
    wide = F.transform(F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda x: x["i"])
    rows = rows.withColumn("_place", F.when(apart, place).when(F.col("_again"), wide)).drop("_sorted")

    def hashed(i: Column) -> Column:
        return F.get("_windows", F.get("_place", i))

    twice = F.transform("_place", lambda p, i: F.when(
        F.coalesce(F.get("_windows", p) == hashed(i + 1), F.lit(False))
        | F.coalesce((i > 0) & (F.get("_windows", p) == hashed(F.greatest(i - 1, F.lit(0)))), F.lit(False)), p))
    rows = rows.withColumn("_twice", F.sort_array(F.filter(twice, lambda p: p.isNotNull()))).drop("_place", "_windows", "_again")
    covered = F.aggregate(F.transform("_twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_twice", i + 1), p + 3) - p)),
                          F.lit(0).cast("bigint"), lambda total, n: total + n)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_twice")


def histograms(rows: DataFrame) -> DataFrame:
    """Adds ``_characters`` and ``_common``: counts by class, and by common word of the row's language."""
    every = sorted({word for words in COMMON.values() for word in words})
    lists = F.coalesce(*[F.when(F.col("lang") == name, _array(*words)) for name, words in COMMON.items()], _array(*every))
    rows = rows.withColumn("_found", F.filter(F.transform("_words", lambda w: F.array_position(lists, w).cast("int")),
                                              lambda i: i > 0)).drop("_words")
    counts = [F.col("_separators"), *[F.regexp_count("_text", F.lit(c)).cast("long") for c in CLASSES[1:4]], F.col("n_symbols")]
    length = F.char_length("_text").cast("long")
    # a sum of removals is cheaper than a pass of a lambda for each word
    words = [(F.size("_found") - F.size(F.array_remove("_found", i + 1))).cast("long") for i in range(len(every))]
    rows = rows.select("*", F.array(*counts).alias("_counted"), length.alias("_length"))
    rest = F.col("_length") - F.aggregate("_counted", F.lit(0).cast("bigint"), lambda total, n: total + n)
    return rows.select(
        "*", F.concat("_counted", F.array(F.greatest(rest, F.lit(0)))).alias("_characters"),
        F.array(*[F.when(F.size(lists) > i, n).otherwise(0) for i, n in enumerate(words)],
                F.col("n_words") - F.size("_found")).alias("_common")).drop("_text", "_counted", "_found", "_separators")


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two columns of counts; 0 if either is empty."""
    total_p, total_q = (F.aggregate(x, F.lit(0.0), lambda total, n: total + n.cast("double")) for x in (p, q))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: F.struct((x / total_p).alias("x"), (y / total_q).alias("y")))
    divergence = F.aggregate(both, F.lit(0.0), lambda total, z: total + (part(z["x"], z["y"]) + part(z["y"], z["x"])) / 2)
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(0.0))


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, character_distance: float = CHARACTER_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, both distances, kept)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    rows = histograms(base_counts(rows)).select("doc_id", "lang", *_BASE, "_length", "_characters", "_common")
    rows = stored(rows, "divergence-rows")
    sizes = {"_characters": len(CLASSES) + 1, "_common": len({w for words in COMMON.values() for w in words}) + 1}
    totals = {"_characters": F.col("_length"), "_common": F.col("n_words")}
    # documents count alike whatever their length, so one long one does not make the reference
    references = rows.groupBy(F.col("lang").alias("_lang")).agg(
        *[F.array(*[F.coalesce(F.avg(F.when(totals[name] > 0, F.col(name)[i] / totals[name])), F.lit(0.0)) for i in range(n)])
          .alias(f"{name}_all") for name, n in sizes.items()])
    rows = rows.join(small_first(references), same(F.col("lang"), F.col("_lang")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    rows = rows.select("doc_id", "lang", *_BASE, "_length", failed.alias("base_failed"),
                       distance("_characters", "_characters_all").alias("character_distance"),
                       distance("_common", "_common_all").alias("word_distance"))
    strange = (((F.col("_length") >= LEAST_CHARACTERS) & (F.col("character_distance") > character_distance))
               | ((F.col("n_words") >= LEAST_JUDGED_WORDS) & (F.col("word_distance") > word_distance)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~strange).drop("_length")
