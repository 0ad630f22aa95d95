"""Registered queries of this subpackage: name -> query, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.llm import chat, oracle, toxicity, urls
from skyquill.llm.bestfit import pack_whole
from skyquill.llm.covertree import near_vectors
from skyquill.llm.divergence import judged
from skyquill.llm.fim import fill_in_middle, restored
from skyquill.llm.language import documents_language, pages_language
from skyquill.llm.mixing import mix
from skyquill.llm.near_text import near_duplicates
from skyquill.llm.packing import pack_documents
from skyquill.llm.runs import periodic_runs
from skyquill.llm.storage import stored
from skyquill.llm.suffixes import repeated_passages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES["op3_minhash_near_dedup"] = op3_minhash_near_dedup
SQL["op3_minhash_near_dedup"] = oracle.NEAR_TEXT


def op6_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the mix takes of each document."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES["op6_budget_mix"] = op6_budget_mix


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES["op1_vector_packing"] = op1_vector_packing


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more in all documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES["op7_suffix_dedup"] = op7_suffix_dedup


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, and whether it is certain enough to keep them."""
    return documents_language(table(spark, sf_dir, "documents")).select("row.doc_id", "row.lang", "language", "posterior", "kept")


QUERIES["op4_language_id"] = op4_language_id


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all pages, by text, markup, address and host."""
    return pages_language(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "language", "posterior", "kept")


QUERIES["page_language"] = page_language


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    found = judged(table(spark, sf_dir, "documents")).drop("lang")
    return found.withColumns({c: F.round(c, 9) for c in ("character_distance", "word_distance")})


QUERIES["op9_divergence_rules"] = op9_divergence_rules
SQL["op9_divergence_rules"] = oracle.DIVERGENCE


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from all conversations formatted, and from one whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = pa.table({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})
    whole = stored(chat.formatted(rows.unionByName(spark.createDataFrame(extra))), "chat-formatted")
    return chat.digests(whole)


QUERIES["op2_chat_format"] = op2_chat_format
SQL["op2_chat_format"] = oracle.CHAT

RULES: list[urls.Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
                          ("allow", "org", "/fr/")]


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation of all pages; a page's labelled outcome is the quality label of its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.judged(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES["op5_url_reputation"] = op5_url_reputation
SQL["op5_url_reputation"] = oracle.URLS


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of two thirds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.scored(docs, scorer).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES["op8_toxicity"] = op8_toxicity


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES["op10_cover_tree"] = op10_cover_tree
SQL["op10_cover_tree"] = oracle.VECTORS


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in as few sequences of 1024 tokens as the search finds."""
    return pack_whole(table(spark, sf_dir, "documents"))


QUERIES["op11_bin_completion"] = op11_bin_completion


def op12_learned_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, cuts and outputs of all documents, and the texts read back from the outputs."""
    cut = fill_in_middle(table(spark, sf_dir, "documents"))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)
    return cut.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES["op12_learned_fim"] = op12_learned_fim
SQL["op12_learned_fim"] = oracle.FIM


def planted(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of which (by doc_id) repeat a stretch of their words to the end."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some of which are planted, and the documents without repetitions."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES["op13_periodic_runs"] = op13_periodic_runs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
