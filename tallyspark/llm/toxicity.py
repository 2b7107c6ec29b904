"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled.  A
logistic model over the words and character n-grams that occur in a text is
fitted in numpy by the non-negative risk estimator, which takes the share of
positives expected among the unlabelled (the class prior) off the negative risk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import (bounded_sample, encode_words, map_texts, plain_words, split_words, text_chunks,
                                   word_grams)

#: Character n-grams with the word's edges; 3 also holds one-letter words whole.
SIZES = (3, 4, 5, 6, 7)
#: Positive and unlabelled rows that the classifier is fitted on (hash samples beyond).
POSITIVE_ROWS, UNLABELLED_ROWS = 3_000, 9_000
#: A feature occurs in so many positive texts, so much more often than in unlabelled ones,
#: and so many standard deviations above what their rate lets expect.
LEAST_POSITIVE, LEAST_RATIO, LEAST_SIGMAS = 3, 2.5, 5.0
#: Features of the model at most, the clearest first.
MAX_FEATURES = 20_000
#: Few rounds: early stopping keeps every toxic word in the model.
ROUNDS, LEARNING_RATE, L2 = 60, 0.05, 1e-5


@dataclass
class Classifier:
    """Weights of the n-gram hashes whose presence tells toxic texts."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def _matches(texts: pa.Array, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) numbers of the features that occur in each text, each pair once."""
    words, rows = split_words(texts)
    distinct, codes = encode_words(words)
    hashes, of = word_grams(plain_words(distinct), SIZES)
    if not len(hashes) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    hit = grams[at] == hashes
    at, of = at[hit], of[hit]
    # Features of each distinct word, then of each text's words.
    order = np.argsort(of, kind="stable")
    at, bounds = at[order], np.searchsorted(of[order], np.arange(len(distinct) + 1))
    sizes = np.diff(bounds)
    some = sizes[codes] > 0
    rows, codes = rows[some], codes[some]
    n = sizes[codes]
    ends = np.cumsum(n)
    features = at[np.repeat(bounds[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    pairs = np.unique(np.repeat(rows.astype(np.int64), n) * len(grams) + features)
    return pairs // len(grams), pairs % len(grams)


def _gram_rows(sample: DataFrame) -> DataFrame:
    """(n-gram, positive texts, unlabelled texts) with each n-gram once per text, added up per chunk."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 0, 1 << 20):
            positive = chunk.column(1).to_numpy(zero_copy_only=False)
            words, rows = split_words(pc.fill_null(chunk.column(0), ""))
            distinct, codes = encode_words(words)
            hashes, of = word_grams(plain_words(distinct), SIZES)
            grams, number = np.unique(hashes, return_inverse=True)
            pairs = np.unique(rows.astype(np.int64) * len(distinct) + codes)
            rows, codes = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
            order = np.argsort(of, kind="stable")
            number, bounds = number[order], np.searchsorted(of[order], np.arange(len(distinct) + 1))
            sizes = np.diff(bounds)[codes]
            ends = np.cumsum(sizes)
            flat = number[np.repeat(bounds[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
            pairs = np.unique(np.repeat(rows, sizes) * max(1, len(grams)) + flat)
            toxic = positive[pairs // max(1, len(grams))]
            both = [np.bincount((pairs % max(1, len(grams)))[x], minlength=len(grams)) for x in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *map(pa.array, both)], ["gram", "p", "u"])

    rows = sample.mapInArrow(run, "gram long, p long, u long")
    return rows.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float,
          rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model by gradient steps on the non-negative risk.

    With the sigmoid losses l+(z) = s(-z) and l-(z) = s(z) the risk is ``prior * E_P[l+] +
    max(0, E_U[l-] - prior * E_P[l-])``; where the second part is negative, its
    gradient is stepped back.  Weights stay non-negative, as every feature was
    chosen for speaking for the positives: copies of a toxic text among the
    unlabelled can't turn its words into evidence against.
    """
    def flat(rows):
        sizes = np.array([len(r) for r in rows])
        return np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows)

    (pf, pr, np_), (uf, ur, nu) = flat(positive), flat(unlabelled)
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)

    def margins(f, r, n):
        return b + np.bincount(r, weights=w[f], minlength=n)

    def push(slopes, f, r):
        return np.append(np.bincount(f, weights=slopes[r], minlength=n_features), slopes.sum())

    for t in range(1, rounds + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(margins(*x), -30, 30))) for x in ((pf, pr, np_), (uf, ur, nu)))
        towards_p, towards_u = sp * (1 - sp) / np_, su * (1 - su) / nu
        rest = push(towards_u, uf, ur) - push(prior * towards_p, pf, pr)
        gradient = rest - push(prior * towards_p, pf, pr) if su.mean() >= prior * sp.mean() else -rest
        gradient += L2 * np.append(w, 0)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        move = LEARNING_RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, b


def _once(found: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Texts with the same features, if they have any, count once: copies are no more evidence."""
    seen, out = set(), []
    for f in found:
        if not len(f) or f.tobytes() not in seen:
            seen.add(f.tobytes())
            out.append(f)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", positive: str = "toxic",
        prior: float | None = None, positive_rows: int = POSITIVE_ROWS,
        unlabelled_rows: int = UNLABELLED_ROWS) -> Classifier:
    """Learn from ``docs`` that ``labels`` confirms (``positive`` is 1) and from all others, unlabelled.

    ``prior`` is the share of toxic texts among the unlabelled; without it, the
    share of 1 among the labels that are not null, applied to the texts that have
    no label (those labelled 0 have none).  Fitted on hash samples of
    about ``positive_rows`` and ``unlabelled_rows`` keys, drawn before any text
    is read.  Of rows with the same key the largest text counts, and a key with
    a positive label is positive; null keys are left out.  Without a positive or
    an unlabelled row the model has no features and scores every text 0.
    """
    marks = (labels.where(F.col(f"`{positive}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("k"))
             .agg(F.max(F.col(f"`{positive}`") == 1).alias("p")))
    keys = (docs.select(F.col(f"`{key}`").alias("k")).where("k is not null").join(marks, "k", "left")
            .select("k", F.coalesce("p", F.lit(False)).alias("p"), F.col("p").isNotNull().alias("known")))
    counted = keys.agg(F.count(F.when(F.col("p"), 1)).alias("p"), F.count(F.when(F.col("known"), 1)).alias("known"),
                       F.count("*").alias("n")).first()
    none = Classifier(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    if not counted["p"] or counted["n"] == counted["p"]:
        return none
    n_u = counted["n"] - counted["p"]
    if prior is None:
        prior = counted["p"] / counted["known"] * (counted["n"] - counted["known"]) / n_u
    prior = min(max(prior, 1e-3), 0.9)
    chosen = bounded_sample(keys.where("p"), F.col("k"), positive_rows, counted["p"]).unionByName(
        bounded_sample(keys.where("not p"), F.col("k"), unlabelled_rows, n_u))
    chosen = F.broadcast(chosen.select("k", "p").distinct())  # about positive_rows + unlabelled_rows keys
    sample = (docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
              .join(chosen, "k").groupBy("k").agg(F.max("t").alias("t"), F.max("p").alias("p")).select("t", "p"))
    sample = sample.persist()
    try:
        sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
        s_p, s_u = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))
        rate = (F.col("u") + 0.5) / (s_u + 0.5)
        ratio = F.col("p") / s_p / rate
        sigmas = (F.col("p") - s_p * rate) / F.sqrt(s_p * rate)
        chosen = (_gram_rows(sample).where(F.col("p") >= LEAST_POSITIVE).withColumn("ratio", ratio)
                  .where((F.col("ratio") >= LEAST_RATIO) & (sigmas >= LEAST_SIGMAS))
                  .orderBy(F.desc(F.col("p") * F.log("ratio")), "gram").limit(MAX_FEATURES).select("gram").toArrow())
        grams = np.sort(chosen.column(0).to_numpy().view(np.uint64))
        if not len(grams):
            return none

        def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in text_chunks(batches, 0):
                at, found = _matches(chunk.column(0), grams)
                bounds = np.searchsorted(at, np.arange(chunk.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.astype(np.int32)))],
                    ["p", "f"])

        got = sample.mapInArrow(features, "p boolean, f array<int>").toArrow()
    finally:
        sample.unpersist()
    is_p = got.column("p").to_numpy()
    found = [np.asarray(x, np.int64) for x in got.column("f").to_pylist()]
    by = [_once(f for f, p in zip(found, is_p) if p == which) for which in (True, False)]
    w, b = train(*by, len(grams), prior)
    return Classifier(grams, w, float(b))


def score(df: DataFrame, model: Classifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          below: float | None = None) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1, higher: more likely toxic) of each whole text.

    Null and empty texts have no features and score the model's base rate.
    Repeated rows are scored each.  ``below`` returns, of the kept columns only,
    the rows that score less.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType())]
    if below is not None:
        fields = [T.StructField("__passed", T.BooleanType())]

    def step():
        m = shared.value

        def apply(texts: pa.Array) -> list[pa.Array]:
            rows, features = _matches(texts, m.grams)
            margin = m.bias + np.bincount(rows, weights=m.weights[features], minlength=len(texts))
            scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            return [pa.array(scores if below is None else scores < below)]

        return apply

    return map_texts(df, text, step, fields, keep, where=None if below is None else "__passed")
