"""The registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat, langid, merkle, minhash, mixing, mtree, prefix_trie, quality, repeats, toxicity, url_filters
from tallyspark.llm.common import held_out, learnable, table, written
from tallyspark.llm.sentencepiece_bpe import encode_documents
from tallyspark.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query(mixing.ORACLE)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a weighted mix of four fifths of all tokens, and their number of copies."""
    docs = mixing.with_levels(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    slim = written(docs.select("doc_id", *mixing.LEVELS, mixing.count_words(F.col("text")).alias("n_tokens")), "op1")
    plan = mixing.make_plan(slim, mixing.budget(), mixing.WEIGHTS, mixing.MAX_EPOCHS, mixing.SEED)
    return mixing.apply_plan(slim, plan, mixing.SEED)


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a filter learnt from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(learnable(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; sizes and digests of both."""
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                             decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query(chat.ORACLE)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation (and -7), read the output back, digest it."""
    return chat.read_back(chat.format_turns(chat.with_marked(table(spark, sf_dir, "conversations"))))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with cutoffs per language from the quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = written(quality.measure(docs, keep=("doc_id", "lang")), "op5")
    good = (table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .where("quality = 1").select("doc_id"))
    labelled = measured.join(good, "doc_id", "left_semi")
    judged = quality.judge(measured, "lang", quality.choose_cutoffs(labelled, "lang", ~quality.base_failed()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Classifier:
    """A classifier learnt from the texts and labels of documents not held out."""
    may = learnable(F.col("doc_id"))
    return toxicity.fit(table(spark, sf_dir, "documents").where(may), table(spark, sf_dir, "labels").where(may))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(minhash.ORACLE)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document; the smallest id of each is kept."""
    return minhash.with_kept(minhash.link(table(spark, sf_dir, "documents")))


@query(mtree.ORACLE)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "n_bytes"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query()
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, from rules and templates that are learnt from what two thirds of the pages hold.

    A page is labelled bad if its html has a seed word; urls are no labels, and
    pages whose crc32(page_id as text) modulo 3 is 1 are held out of learning.
    """
    bad = F.when(learnable(F.col("page_id")), F.coalesce(url_filters.seeded(F.col("html").cast("string")), F.lit(False)))
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), url_filters.RULES, bad)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "reason",
                         held_out(F.col("page_id")).alias("held_out"))


@query(repeats.ORACLE)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document with a smaller id also has."""
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("spans")


@query(prefix_trie.ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations' beginnings."""
    turns = written(prefix_trie.coded_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


@query(merkle.ORACLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and whether its tampered copy still folds to the root."""
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))
