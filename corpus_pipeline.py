"""Corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each stage's rows as Parquet
in the session's shared checkpoint folder and rereads them as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import circulant_minhash, decision_list, hilbert_pack
from fleetpulse.llm.common import WORD_PATTERN, prepare, read
from fleetpulse.llm.queries import identify_documents
from fleetpulse.session import checkpoint_dir


#: Rows and bytes of the Arrow batches between executors and Python workers: four stages share the workers' memory, and
#: texts may be long.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def ready(spark: SparkSession) -> None:
    """What every stage needs of a session."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def unused(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, in whatever case."""
    held = {c.lower() for c in columns}
    while name in held:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with their columns as they came.

    Null and empty texts, and texts without letters, have no language and go; repeated rows are judged alike; an empty
    table stays empty.
    """
    ready(spark)
    return identify_documents(docs).where("language_kept").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep, with their columns as they came.

    Null and empty texts have fewer than 50 words and go; repeated rows are judged alike; without labelled documents no rule
    is learned and the base rules stand alone; an empty table stays empty.
    """
    ready(spark)
    return decision_list.keep(docs, decision_list.learn(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of smallest id (null last), then smallest text.

    Rows count as documents of their own, also where their ids repeat or are null: of rows with one text one stays, of
    different texts under one id each is judged by itself. Texts without words link with nothing; of such rows equal in id
    and text one stays. Between rows of one id and text the other columns decide.
    """
    ready(spark)
    odd = docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        dropped = circulant_minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # places in the order of rows; equal rows are spread over tasks
    key, tie = (unused(c, docs.columns) for c in ("near_dedup_key", "near_dedup_tie"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.col("doc_id").asc_nulls_last(), F.col("text"), F.to_json(F.struct(F.lit(0).alias(key), *rest)), F.col(tie)]
    spread = docs.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = spread.drop(tie).withColumn(key, F.monotonically_increasing_id()).checkpoint()
    judged = circulant_minhash.near_duplicates(keyed, key=key)
    wordless = keyed.where(~F.coalesce("text", F.lit("")).rlike(WORD_PATTERN)).groupBy("doc_id", "text").agg(F.min(key).alias(key))
    left = judged.where(F.col("kept") & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias(key)).union(wordless.select(key))
    return keyed.join(left, key, "left_semi").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens: doc_id, start, length and so on, not the documents' columns.

    A null text is empty and has one token, the closing id; repeated rows are documents of their own; an empty table gives
    no pieces.
    """
    ready(spark)
    model = hilbert_pack.read_model(public_tokenizers.path("byte_bpe_50k.json"))
    return hilbert_pack.pack(docs, model, public_tokenizers.PATTERN, added=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Learned rules, language models and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's rows are Parquet in the shared checkpoint folder."""
    ready(spark)
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
