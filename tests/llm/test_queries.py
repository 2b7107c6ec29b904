"""The registered queries and the pipeline's stages on the smallest data, against brute force."""

from __future__ import annotations

import hashlib
import os
import re
from itertools import combinations

import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyspark.llm import url_filters
from tallyspark.llm.common import written
from tests.llm.test_operators import naive_counts, naive_sets

DATA = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_digests_of_documents(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in entry.queries()["op3_sentencepiece"](spark, DATA).collect():
        ids = lib.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    judged = entry.queries()["op5_quality"](spark, DATA).collect()
    assert len(judged) == len(texts)
    for r in judged:
        counts = naive_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)


def test_templates_on_held_out_pages(spark):
    """Blocked pages among those that taught nothing, against their own contents."""
    data = "/root/testdata/sf0.1"
    got = {r.page_id: r for r in entry.queries()["op10_url_filters"](spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert len(got) == pages.count()
    bad = {r[0] for r in pages.where(url_filters.seeded(F.col("html"))).select("page_id").collect()}
    held = [r for r in got.values() if r.held_out and r.rule is None]
    blocked = [r for r in held if r.verdict == "block"]
    hits = sum(r.page_id in bad for r in blocked)
    all_bad = sum(r.page_id in bad for r in held)
    print("held out, bad, blocked, rightly:", len(held), all_bad, len(blocked), hits)
    assert blocked and hits >= 0.9 * len(blocked)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= before
        before = kept[name]
    assert len(kept["language"]) == len(kept["toxicity"])  # every text of this table has letters
    left = written(corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA), "left")
    texts = [r.text for r in left.collect()]
    sets = naive_sets(texts)
    assert not [1 for a, b in combinations(range(len(sets)), 2)
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(coded) == docs.count() and all(r.n_tokens == len(r.ids) for r in coded)
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text, "en", "b", 9), (1, text, "en", "a", 9), (1, other, "en", "c", 9), (2, text + " x", "en", "a", 9),
            (3, None, None, None, None), (3, None, None, None, None), (None, text, "en", "a", 9), (None, text, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[6], rows[7]]))


def test_written_tables_are_released(spark):
    from tallyspark import session
    entry.queries()["op12_prefix_trie"](spark, DATA).collect()
    entry.queries()["op11_substring_dedup"](spark, DATA).collect()
    session.release_all(spark)
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables"
    assert not os.path.exists(folder) or not os.listdir(folder)
