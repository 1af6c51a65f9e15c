"""The training-data pipeline over the documents table.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns
a DataFrame, the next one's docs. All but the last return the columns of documents. No stage
can be told in SQL from end to end (a trained network, components of links, a tokenizer), so
ORACLE_SQL is None and the tests compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, jaccard_join, packing, pseudonyms, quality_classifier
from helixframe.llm.common import checkpointed, table
from helixframe.llm.queries import PSEUDONYM_KEY
from helixframe.llm.tokenizers import tokenizer_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    model = quality_classifier.learned(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where("quality_score >= 0.5").select(docs.columns)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one with the smallest id (five-word n-grams, 0.8)."""
    return jaccard_join.deduplicated(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms; n_chars follows the text."""
    made = pseudonyms.pseudonymised(docs, PSEUDONYM_KEY)
    length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", length).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 4096 tokens."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"))).drop("doc_row")


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", deduplication),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's result is checkpointed, as the next reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
