"""Repeated passages against brute force, and on nulls, ties, long texts, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import repeats

SCHEMA = "doc_id long, text string, row int, parcel string, words string"


def brute(rows):
    """Rows (doc_id, n_words, n_removed, kept_sha256, spans) by a table of all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - 49):
                s = tuple(w[p:p + 50])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - 49):
                if least[tuple(w[p:p + 50])] < i:
                    gone.update(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        starts = sorted(p for p in gone if p - 1 not in gone)
        spans = [(s, next(p for p in range(s, len(w) + 1) if p not in gone)) for s in starts]
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), spans))
    return out


def passages():
    draw = random.Random(11)
    word = lambda: draw.choice(["lorem", "ipsum", "Dolor", "sit,", "ämet", "日本"]) + str(draw.randrange(300))
    text = lambda n: [word() for _ in range(n)]
    common, other = text(50), text(130)
    rows = []
    for i in range(300):
        parts = text(draw.choice([0, 1, 10, 24, 25, 26, 49, 60, 200]))
        if draw.random() < 0.4:
            parts = parts + common[:draw.choice([24, 25, 49, 50, 50])] + text(draw.randrange(40))
        if draw.random() < 0.4:
            at = draw.randrange(80)
            parts = parts + other[at:at + draw.choice([49, 50, 51, 75, 130])] + text(draw.randrange(3))
        if i and draw.random() < 0.1:
            parts = (rows[draw.randrange(i)][1] or "").split()
        if parts and draw.random() < 0.1:
            parts = parts + parts  # a repeat within one document is none
        rows.append((draw.randrange(-500, 500), draw.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [rows[0]] * 3 + [(None, " ".join(common + other)), (None, None), (77, None), (78, ""), (79, " \n\t "),
                             (900, " ".join(["a"] * 3000)), (901, " ".join(["a"] * 60)), (902, " ".join(["a"] * 49)),
                             (903, " ".join(common)), (904, " ".join(common).upper())]
    long = text(30_000)
    rows += [(950, " ".join(long)), (951, " ".join(long[7:29_000] + text(10) + long[100:160])), (952, "x" * 300_000 + " " + " ".join(common))]
    # boilerplate of 30 words that only document 800 precedes, and 60 words around it that 801 and 805 share
    around = text(60)
    rows += [(800, " ".join(around[15:45])), (801, " ".join(text(3) + around)), (805, " ".join(around))]
    return rows


@pytest.mark.parametrize("bucket_words, parts", [(1_000_000, 1), (3_000, 7), (500, 40)])
def test_repeats_by_brute_force(spark, monkeypatch, bucket_words, parts):
    monkeypatch.setattr(repeats, "BUCKET_WORDS", bucket_words)
    rows = passages()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = repeats.repeats(df)
    flat = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, [tuple(s) for s in r.spans]) for r in got.collect()]
    assert sorted(map(str, flat)) == sorted(map(str, brute(rows)))
    assert sum(r[2] > 0 for r in flat) > 50
    if parts == 1:
        unique = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).where("n = 1")
        left = got.join(unique, "doc_id").select(F.sha2(repeats.without(F.col("text"), F.col("spans")), 256).alias("a"), "kept_sha256")
        assert left.count() > 200 and left.where("a <> kept_sha256").count() == 0


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.repeats(none).count() == 0
    short = spark.createDataFrame([(1, "a b", 1, "", ""), (None, None, 1, "", "")], SCHEMA)
    assert [(r.n_words, r.n_removed, r.spans) for r in repeats.repeats(short).orderBy("n_words").collect()] == [(0, 0, []), (2, 0, [])]


def test_rolling_hashes_and_packing():
    draw = np.random.default_rng(5)
    words = draw.integers(0, 2**63, 200).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    for size in (1, 2, 3, 25, 50, 64, 199, 200, 201):
        want = []
        for i in range(len(words) - size + 1):
            h = 0
            for w in words[i:i + size].tolist():
                h = (h * base + w) % 2**64
            want.append(h)
        assert repeats._rolling(words, size, np.uint64(base)).tolist() == want
    values = np.sort(draw.integers(0, 2**62, 1000).astype(np.uint64))
    assert (repeats._unpack(repeats._pack(values), 1000) == values).all()
    small = draw.integers(0, 2**32, 99).astype(np.uint32)
    assert (repeats._from_planes(repeats._planes(small), 99, np.uint32) == small).all()
