"""Language by Bayesian evidence fusion: text likelihoods, declared language, address suffix and host priors.

Text likelihoods come from byte trigrams counted per declared language over all rows. What a declaration or an address
suffix says about the language, and how languages spread over hosts, is counted from the languages that the text alone
suggests: a grouped aggregation per declaration, and host priors smoothed from the whole to the suffix, the
registered domain and the host. The posterior multiplies all evidence that a row has; a missing one says nothing.

A class of text in no language has the even spread over trigrams. A row is rejected if that class wins, if no language
reaches half of the posterior, or if its text holds no letter. Null texts are empty texts, and rejected. Null
declarations, suffixes and hosts are missing evidence; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.llm.storage import same, small_batches, small_first, stored
from skyquill.llm.textkit import LOWER, SEPARATORS, slices, text_bytes

LANGUAGES = ("de", "en", "es", "fr")
#: Trigrams are hashed to this many cells.
CELLS = 1 << 16
#: A text of n trigrams counts as n / (1 + n / SATURATION) independent ones.
SATURATION = 200.0
#: Rows of evidence that a coarser prior is worth; prior of text in no language.
PRIOR_ROWS, NO_LANGUAGE = 20.0, 1e-4


def _cells(data: np.ndarray) -> np.ndarray:
    low = LOWER[data].astype(np.uint32)
    mixed = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)


#: Bytes that say something about a language: letters, other than ASCII ones by their bytes, and space between words.
_TELLING = np.zeros(256, bool)
_TELLING[[*range(65, 91), *range(97, 123), *range(128, 256), *SEPARATORS]] = True


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams within rows, and the border of each row in them. Trigrams with digits or marks are left
    out, so numbers, keys and addresses in a text are no evidence against its language."""
    if len(data) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    cells = _cells(data)
    telling = _TELLING[data]
    inside = telling[:-2] & telling[1:-1] & telling[2:]
    for back in (1, 2):  # trigrams that leave their row
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(cells))]] = False
    counts = np.concatenate([[0], np.cumsum(inside)])
    return cells[inside], counts[np.minimum(offsets, len(cells))]


def _count(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            which = np.array([languages.index(x) if x in languages else -1 for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets):
                cells, borders = _trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                row = np.repeat(which[a:b], np.diff(borders))
                for k in range(len(languages)):
                    total[k] += np.bincount(cells[row == k], minlength=CELLS)
        at = np.flatnonzero(total.reshape(-1))
        for s in range(0, len(at), 1 << 16):
            part = at[s:s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((part // CELLS).astype(np.int32)), pa.array((part % CELLS).astype(np.int32)),
                                              pa.array(total.reshape(-1)[part])], ["language", "cell", "n"])
    return run


def text_model(docs: DataFrame, text: Column, declared: Column, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log probability of each trigram cell per language, counted over all rows that declare one of ``languages``."""
    counts = (docs.select(text.cast("string").alias("text"), declared.cast("string").alias("declared"))
              .mapInArrow(_count(languages), "language int, cell int, n long")
              .groupBy("language", "cell").agg(F.sum("n").alias("n")))
    with small_batches(docs.sparkSession):
        counts = counts.toPandas()  # languages * CELLS rows at most
    model = np.full((len(languages), CELLS), 0.1)
    model[counts["language"], counts["cell"]] += counts["n"]
    return np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(model: np.ndarray):
    """Per text the effective log-likelihood of each language, then of no language."""
    even = -float(np.log(CELLS))

    def run(column: pa.Array) -> pa.Array:
        out = []
        data, offsets = text_bytes(column)
        for a, b in slices(offsets):
            cells, borders = _trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            n = np.diff(borders).astype(float)
            scale = 1 / (1 + n / SATURATION)
            sums = [np.concatenate([[0], np.cumsum(values[cells], dtype=float)]) for values in model]
            out.append(np.stack([*((s[borders[1:]] - s[borders[:-1]]) * scale for s in sums), n * scale * even], axis=1))
        flat = np.concatenate(out) if out else np.zeros((0, len(model) + 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * (len(model) + 1)),
                                        pa.array(flat.reshape(-1)))
    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))


@dataclass
class Fusion:
    """The text model and what declarations, suffixes and hosts say; ``apply`` adds ``language``, ``posterior``, ``kept``."""

    languages: tuple[str, ...]
    score: object
    declared: DataFrame
    suffix: DataFrame
    host: DataFrame

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` has ``_text`` (scores), ``_letters``, ``_declared``, ``_suffix`` and ``_host``; these are dropped."""
        n = len(self.languages)
        for name, side in (("_declared", self.declared), ("_suffix", self.suffix), ("_host", self.host)):
            side = side.select(F.col("key").alias("_key"), F.col("says").alias(f"_says{name}"))
            rows = rows.join(small_first(side), same(F.col(name), F.col("_key")), "left").drop("_key")
        even = F.array(*[F.lit(0.0)] * n)
        logs = [F.col("_text")[i] + F.coalesce("_says_declared", even)[i] + F.coalesce("_says_suffix", even)[i]
                + F.coalesce("_says_host", even)[i] for i in range(n)]
        rows = rows.withColumn("_logs", F.array(*logs, F.col("_text")[n] + F.lit(float(np.log(NO_LANGUAGE)))))
        rows = rows.withColumn("_top", F.array_max("_logs"))
        best = F.array_position("_logs", F.col("_top")).cast("int")
        share = 1 / F.aggregate("_logs", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("_top")))
        names = F.array(*[F.lit(x) for x in self.languages], F.lit("und"))
        rows = rows.withColumn("posterior", share).withColumn(
            "language", F.when(F.col("_letters"), F.element_at(names, best)).otherwise(F.lit("und")))
        kept = F.col("_letters") & (F.col("language") != "und") & (F.col("posterior") >= 0.5)
        return rows.withColumn("kept", kept).drop("_text", "_letters", "_declared", "_suffix", "_host", "_logs", "_top",
                                                  "_says_declared", "_says_suffix", "_says_host")


def _evidence(docs: DataFrame, score: object, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    text = text.cast("string")
    return docs.select("*", score(text).alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
                       declared.cast("string").alias("_declared"), suffix.cast("string").alias("_suffix"),
                       host.cast("string").alias("_host"))


def _says(seen: DataFrame, key: str, n: int) -> DataFrame:
    """(key, says): log P(key | language), with one row of each key added to every language."""
    counts = seen.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        *[F.sum((F.col("guess") == i).cast("long") * F.col("rows")).alias(f"n{i}") for i in range(n)])
    totals = counts.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(n)], F.count("*").alias("keys"))
    says = [F.log((F.col(f"n{i}") + 1) / (F.col(f"t{i}") + F.col("keys"))) for i in range(n)]
    return counts.join(F.broadcast(totals)).select("key", F.array(*says).alias("says"))  # one row of totals


def _host_priors(seen: DataFrame, n: int) -> DataFrame:
    """(key, says): log prior of each language on a host, smoothed from all rows to suffix, registered domain and host."""
    counts = [F.sum((F.col("guess") == i).cast("long") * F.col("rows")).alias(f"n{i}") for i in range(n)]
    labels = F.split("_host", r"\.")
    hosts = (seen.where("_host IS NOT NULL").groupBy("_host").agg(*counts)
             .withColumn("domain", F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("_host")))
             .withColumn("suffix", F.element_at(labels, -1)))

    def level(key: str, above: DataFrame | None, above_key: str | None) -> DataFrame:
        rows = hosts.groupBy(key).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)],
                                      *([F.first(above_key).alias(above_key)] if above_key else []))
        if above is not None:
            rows = rows.join(above.withColumnRenamed("prior", "outer"), above_key)
        return rows

    total = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
    everything = sum((F.col(f"n{i}") for i in range(n)), F.lit(0))
    whole = total.select(F.array(*[(F.col(f"n{i}") + 1) / (everything + n) for i in range(n)]).alias("outer"))
    smoothed = F.array(*[(F.col(f"n{i}") + PRIOR_ROWS * F.col("outer")[i]) / (everything + PRIOR_ROWS) for i in range(n)])
    suffix = level("suffix", None, None).join(F.broadcast(whole)).select("suffix", smoothed.alias("prior"))  # one row
    domain = level("domain", suffix, "suffix").select("domain", smoothed.alias("prior"))
    host = level("_host", domain, "domain").select(F.col("_host").alias("key"), smoothed.alias("prior"))
    return host.select("key", F.transform("prior", lambda x: F.log(x)).alias("says"))


def fit(docs: DataFrame, text: Column, declared: Column, suffix: Column, host: Column,
        languages: tuple[str, ...] = LANGUAGES) -> Fusion:
    """Count all evidence over all rows of ``docs``."""
    n = len(languages)
    score = _score(text_model(docs, text, declared, languages))
    seen = _evidence(docs.select(text.alias("t"), declared.alias("d"), suffix.alias("s"), host.alias("o")), score,
                     F.col("t"), F.col("d"), F.col("s"), F.col("o"))
    guess = F.slice("_text", 1, n)
    seen = seen.where("_letters").select((F.array_position(guess, F.array_max(guess)) - 1).alias("guess"),
                                         "_declared", "_suffix", "_host")
    seen = stored(seen.groupBy("guess", "_declared", "_suffix", "_host").agg(F.count("*").alias("rows")), "language-seen")
    return Fusion(languages, score, stored(_says(seen, "_declared", n), "language-declared"),
                  stored(_says(seen, "_suffix", n), "language-suffix"), stored(_host_priors(seen, n), "language-host"))


def identified(docs: DataFrame, text: Column, declared: Column, suffix: Column, host: Column,
               languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``kept``; columns of these names are replaced."""
    fusion = fit(docs, text, declared, suffix, host, languages)
    rows = _evidence(docs, fusion.score, text, declared, suffix, host)
    return fusion.apply(rows.drop("language", "posterior", "kept"))


def documents_language(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(row, language, posterior, kept): ``row`` holds the columns of a document.

    ``lang`` is the declaration and ``source`` stands for the host; documents have no address.
    """
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang", "source")
    found = identified(hidden, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source"), languages)
    return found.select("row", "language", "posterior", "kept")


def spoken(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The documents that are not rejected, unchanged."""
    # numbered names, so that no column clashes and no text is carried twice
    at = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    found = identified(docs.toDF(*at.values()), F.col(at["text"]), F.col(at["lang"]), F.lit(None).cast("string"), F.col(at["source"]), languages)
    return found.where("kept").select(*[F.col(c).alias(name) for name, c in at.items()])


#: Language of the markup, and the path segment that names one.
_MARKUP, _SEGMENT = r"(?i)<html[^>]*\slang=[\"']?([a-z]{2})", r"://[^/?#]*/([a-z]{2})(?:/|$)"


def pages_language(pages: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Web pages: the markup's language, the language in the address (else its last label) and the host are evidence."""
    url = F.col("url").cast("string")
    host = F.nullif(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))
    segment = F.nullif(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.col("html").cast("string"), r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", " "),
                            "(?s)<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(F.col("html").cast("string"), _MARKUP, 1)), F.lit(""))
    return identified(pages, text, declared, F.coalesce(segment, F.element_at(F.split(host, r"\."), -1)), host, languages)
