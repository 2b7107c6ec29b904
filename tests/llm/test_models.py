"""The language filter against plain sets of n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import langid


def grams(text):
    """n-grams of the words, edges marked, with repeats."""
    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        marked = "\x02" + word.lower().strip(".,;:!?\"'()[]{}<>|#*$%&=+-_/\\~`^@") + "\x03"
        out += [marked[i:i + n] for n in langid.SIZES for i in range(len(marked) - n + 1)]
    return out


def sets_of(rows):
    """The n-grams that belong to each language, by the same two rates, from whole counts."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        if lang is not None:
            counts[lang].update(grams(text))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = Counter()
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best[g], x)
    return {k: {g for g, x in r.items() if x >= langid.LEAST_RATE and x >= langid.LEAST_SHARE * best[g]} for k, r in rate.items()}


def test_languages_by_sets_of_grams(spark):
    draw = random.Random(6)
    syllables = {"aa": ["ba", "lo", "mi", "the", "un"], "bb": ["the", "ing", "er", "lo", "ou"], "cc": ["ñas", "é", "un", "ba", "sch"]}

    def text(lang):
        words = ["".join(draw.choice(syllables[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(1, 30))]
        return draw.choice([" ", "\n"]).join(w.upper() if draw.random() < 0.1 else w + draw.choice(["", ",", "."]) for w in words)

    taught = [(text(lang), lang) for lang in syllables for _ in range(150)] + [("ba lo", None), (None, "aa"), ("", "bb")]
    asked = [text(draw.choice(list(syllables))) + " " + text(draw.choice(list(syllables))) for _ in range(300)]
    asked += [None, "", "12 ...", "ba", "x" * 50_000, "the lo " * 20_000, "qqq", "é", asked[0], asked[0]]
    model = langid.fit(spark.createDataFrame(taught, "text string, lang string"))
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = sets_of(taught)
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        found = Counter(grams(t))
        counts = {k: sum(n for g, n in found.items() if g in held[k]) for k in sorted(held)}
        total = sum(counts.values())
        ranked = sorted(counts.values())
        if ranked[-1] - ranked[-2] > 0.01 * len(grams(t)) + 2:  # beyond what the filter's false positives can turn
            assert got[i].lang_pred == max(counts, key=counts.get), t[:80]
        if total > 200:
            assert abs(got[i].score - ranked[-1] / total) < 0.01
    best = spark.createDataFrame([(1, "lo")], "doc_id long, text string")
    assert langid.predict(best, model).where(F.col("lang_pred").isin(*syllables)).count() == 1
