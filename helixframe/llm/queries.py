"""The training-data queries, each applying one operator to its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat_windows, collocations, decontaminate, html_wrapper, jaccard_join, language_id, line_dedup, packing, periodic_runs, pseudonyms, quality_classifier, secrets_scan, sql_twins, weak_supervision
from helixframe.llm.common import table
from helixframe.llm.tokenizers import tokenizer_path

#: The key of the pseudonyms of these queries. A real run passes its own secret.
PSEUDONYM_KEY = "an example key"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers and dates pseudonymised, and what was replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pseudonyms.pseudonymised(docs, PSEUDONYM_KEY)
    return made.select("doc_id", "text", F.size("pii_kinds").cast("bigint").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, posterior quality and whether it is kept."""
    judged = weak_supervision.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the fixed forms, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets_scan.scanned(docs, tokenizer_path("byte_bpe_50k.tiktoken"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "token")
    return found.select("doc_id", *map(count, secrets_scan.KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secret_spans")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by cross-parsing; learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    parser = language_id.learned(docs, ~held_out)
    judged = language_id.identified(docs.select("doc_id", "text"), parser)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 4096 tokens."""
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces).drop("doc_row")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of benchmark windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of links at a Jaccard similarity of 0.9 of 3-word shingles."""
    return jaccard_join.joined(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_html_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_wrapper.extracted(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op9_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's digests, read back from its formatted windows; conversation -7 holds control strings."""
    told = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_windows.conversation_digests(rows)


def op10_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels are learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality_classifier.learned(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = quality_classifier.scored(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), of which some repeat their own words: with h = crc32 of doc_id, g = floor(h / 10) and n words, if h ends in 0, each word i from a = g % n on is word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string"))
    sized = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    g, n = F.floor(h / 10), F.size("w")
    made = sized.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("w"), at(i)))
    return made.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words and digest of what is left without the repeats."""
    found = periodic_runs.with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to five words by their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them go as lines of other documents, and a digest of the rest."""
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_feistel_pseudonyms,
        op2_weak_supervision,
        op3_secret_scan,
        op4_language_id,
        op5_best_fit_packing,
        op6_benchmark_decontamination,
        op7_ngram_jaccard_join,
        op8_html_wrapper_extraction,
        op9_budgeted_chat_windows,
        op10_positive_unlabelled_quality,
        op11_periodic_runs,
        op12_phrase_collocations,
        op13_line_dedup,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(sql_twins.SQL)
