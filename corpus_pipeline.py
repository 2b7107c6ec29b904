"""From raw documents to a weighted, tokenised training mix.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``.

1. ``toxicity``: documents that score 0.7 or more go.
2. ``language``: documents without a letter, or whose language is not told with a score of 0.3, go.
3. ``near_duplicates``: of each group of near copies the smallest id stays.
4. ``mix``: a token budget by domain, language and source; a document taken in two epochs is two rows.
5. ``encode``: token ids of each remaining document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import langid, minhash, mixing, toxicity
from tallyspark.llm.common import learnable, written
from tallyspark.llm.queries import toxicity_model
from tallyspark.llm.sentencepiece_bpe import encode_documents

TOXIC_FROM, LANGUAGE_FROM = 0.7, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7, by a classifier learnt from the labelled documents."""
    return toxicity.score(docs, toxicity_model(spark, sf_dir), keep=tuple(docs.columns), below=TOXIC_FROM)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filter knows, learnt from those that may be learnt from."""
    model = langid.fit(docs.where(learnable(F.col("doc_id"))))
    return langid.predict(docs, model, keep=tuple(docs.columns), where=True, min_score=LANGUAGE_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with its smallest id (null ids all stay).

    Rows with one id stay if their texts differ; of rows equal in id and text
    one stays, the smallest by its other columns.
    """
    linked = written(minhash.with_kept(minhash.link(docs.select("doc_id", "text"))), "linked")
    dropped = linked.where("not kept").select("doc_id").distinct()
    kept = docs.join(minhash.small_ids(dropped), "doc_id", "left_anti").select(*docs.columns)
    repeated = linked.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = minhash.small_ids(repeated)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = (kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__row"))
            .select("doc_id", "text", *[F.col("__row")[c].alias(c) for c in others]))
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix; a document occurs as often as epochs take it."""
    columns = docs.columns
    slim = mixing.with_levels(docs.select("doc_id", "text", "lang", "source"))
    slim = written(slim.select("doc_id", *mixing.LEVELS, mixing.count_words(F.col("text")).alias("n_tokens")), "mix")
    plan = mixing.make_plan(slim, mixing.budget(), mixing.WEIGHTS, mixing.MAX_EPOCHS, mixing.SEED)
    kept = docs.withColumn("__row", F.struct(*columns))
    taken = mixing.apply_plan(mixing.with_levels(kept), plan, mixing.SEED)
    return (taken.withColumn("__epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("__row.*"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens`` of every row."""
    coded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates),
          ("mix", mix_sources), ("encode", encode)]

#: The classifiers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
