"""From raw documents to packed training sequences, stage by stage.

1. ``language``: texts without a recognisable language go (no letter, or words that are unsure of theirs); texts of several languages stay.
2. ``exact``: of equal texts the one with the largest id stays.
3. ``near``: of documents linked by five-word shingles at a similarity of 0.8 or more one stays per group.
4. ``mix``: documents are put in the order of the mixture; each source weighs the square root of its number of documents.
5. ``pack``: documents, in that order, are cut and packed into sequences of 2048 tokens.

Stages 1 to 4 return the columns of ``documents``. The first stage learns from the labelled rows it is given (of those whose
crc32(doc_id as text) mod 4 is not 2), never from the label of the text it judges alone: lang, source and doc_id are no inputs of a prediction.

Defined cases: a NULL, empty or letterless text goes in the first stage, so no later stage meets one; NULL labels are not learned from, and
without any label every text goes; NULL sources are a source of their own; NULL ids are rows like others; of repeated rows one stays
(``exact``), of rows with one id and different texts each is judged by itself; very long texts are judged whole and packed in pieces; extra columns of
``documents``, whatever their names, are carried to the mix and dropped by ``pack``; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.exact_dedup import drop_exact_copies
from cohortspark.llm.language_id import fitted, labelled
from cohortspark.llm.mixing import in_mixed_order
from cohortspark.llm.near_dedup import drop_near_copies
from cohortspark.llm.packing import digests, pack
from cohortspark.llm.queries import remainder_of_id
from cohortspark.session import materialize, small_batches

#: What the mean of the words' largest posteriors must reach.
LEAST_SURE = 0.5
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = docs["text"]
    tagged = docs.select(docs["doc_id"].alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"))
    found = labelled(tagged, fitted(docs, remainder_of_id(4) != 2), sure=True)
    sure = F.expr(f"coalesce(lang_pred <> 'und' AND lang_sure >= {LEAST_SURE}, false)")
    with small_batches(spark):  # holds for what is written in there
        left = materialize(found.filter(~sure).select("id", "tag").distinct(), "left-out")
    # Verdicts depend on the text alone, so rows that agree in id and text go or stay together; texts are not written twice.
    keyed = docs.select(F.struct("*").alias("all"), docs["doc_id"].alias("own_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_tag"))
    same = keyed["own_id"].eqNullSafe(left["id"]) & (keyed["own_tag"] == left["tag"])
    return keyed.join(left, same, "left_anti").select("all.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("pack", pack_sequences),
]

#: Classifier, shingle groups, schedule and tokenizer are not SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
