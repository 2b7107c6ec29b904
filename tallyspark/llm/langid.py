"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, per slot, a bit for every language; the slots
of an n-gram, and-ed together, return all languages that contain it.  A text
counts, per language, the n-grams that its filter slice holds; the expected
false positives of the slice are taken off, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import (encode_words, map_texts, mix64, plain_words, split_words, sum_by_row, text_chunks,
                                   word_grams)

#: Character n-grams of words, edges included.
SIZES = (2, 3, 4)
#: Labelled rows per language that the filter is fitted on (a hash sample beyond).
SAMPLE_ROWS = 4_000
#: An n-gram belongs to a language that has at least this part of its n-grams ...
LEAST_RATE = 2e-6
#: ... and this part of the rate of the language that uses it most.
LEAST_SHARE = 0.34
#: N-grams in the filter at most, the most frequent first: with SLOTS_PER_GRAM this bounds the filter to 32 MB.
MAX_GRAMS = 262_144
SLOTS_PER_GRAM = 12
N_HASHES = 4
UNDETERMINED = "und"


@dataclass
class MaskFilter:
    """Bit-sliced Bloom filter from n-gram hashes to bitmasks of languages (words of 64 each)."""

    languages: list[str]
    slots: np.ndarray = field(repr=False)  # [words of 64 languages, slots]

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, language_of: np.ndarray) -> MaskFilter:
        bits = max(10, int(SLOTS_PER_GRAM * max(1, len(np.unique(grams))) - 1).bit_length())
        slots = np.zeros(((len(languages) + 63) // 64, 1 << bits), np.uint64)
        made = cls(languages, slots)
        masks = np.uint64(1) << (language_of % 64).astype(np.uint64)
        for at in made._places(grams):
            np.bitwise_or.at(slots, (language_of // 64, at), masks)
        return made

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """Slot numbers of each n-gram under each of the filter's hashes."""
        last = np.uint64(self.slots.shape[1] - 1)
        first, step = grams, mix64(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for i in range(N_HASHES):
            yield ((first + np.uint64(i) * step) & last).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that hold each n-gram, [words of 64 languages, n-grams]."""
        out = np.full((self.slots.shape[0], len(grams)), ~np.uint64(0))
        for at in self._places(grams):
            out &= self.slots[:, at]
        return out

    def false_rates(self) -> np.ndarray:
        """Per language, the chance that a foreign n-gram is found in its slice."""
        fill = [((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(fill) ** N_HASHES


def _gram_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(language, n-gram, count) rows, added up per chunk where the text is read."""
    source = df.select(F.col(f"`{label}`").cast("string").alias("language"),
                       F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 1):
            labels = np.array(chunk.column(0).to_pylist(), object)
            for language in sorted(set(labels)):
                texts = pc.fill_null(chunk.column(1).filter(pa.array(labels == language)), "")
                distinct, codes = encode_words(split_words(texts)[0])
                hashes, rows = word_grams(plain_words(distinct), SIZES)
                grams, at = np.unique(hashes, return_inverse=True)
                counts = np.bincount(at, weights=np.bincount(codes, minlength=len(distinct))[rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams), pa.string()), pa.array(grams.view(np.int64)),
                     pa.array(counts.astype(np.int64))], ["language", "gram", "n"])

    rows = source.mapInArrow(run, "language string, gram long, n long")
    return rows.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> MaskFilter:
    """Learn a filter from labelled rows (null labels are left out).

    Fitted on a hash sample of about ``sample_rows`` rows of each language.  The
    filter's size is bounded by ``MAX_GRAMS``; there may be any number of
    languages that a model of ``sample_rows`` rows each is worth having for.
    """
    labelled = df.where(F.col(f"`{label}`").isNotNull())
    sizes = {r["label"]: r["n"] for r in labelled.groupBy(F.col(f"`{label}`").cast("string").alias("label"))
             .agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return MaskFilter([], np.zeros((0, 1024), np.uint64))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col(f"`{text}`"), F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col(f"`{label}`").cast("string")])
    counts = _gram_counts(sample, text, label)
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "language").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(
        F.max("rate").alias("best"), F.collect_list(F.struct("language", "rate")).alias("by"))
    held = (best.where(F.col("best") >= LEAST_RATE).orderBy(F.desc("best"), "gram").limit(MAX_GRAMS)
            .select("gram", F.filter("by", lambda x: (x["rate"] >= LEAST_RATE) & (
                x["rate"] >= LEAST_SHARE * F.col("best")))["language"].alias("languages"))
            .select("gram", F.explode("languages").alias("language")).toArrow())
    number = {k: i for i, k in enumerate(languages)}
    grams = held.column("gram").to_numpy().view(np.uint64)
    language_of = np.array([number[k] for k in held.column("language").to_pylist()], np.int64)
    return MaskFilter.build(languages, grams, language_of)


def predict(df: DataFrame, model: MaskFilter, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            where: bool = False, min_score: float = 0.0) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (the winner's part of all corrected counts).

    ``und`` with score 0 where the text is null, empty or has no letter, or the
    model knows no language.  A text of letters none of whose n-grams any
    language holds gets the first language, with score 0; of equal counts the
    first language by name wins.  ``where`` returns only the kept columns of
    rows that are not ``und`` and score at least ``min_score``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if where:
        fields = [T.StructField("__passed", T.BooleanType())]

    def step():
        filter_ = shared.value
        false = filter_.false_rates() if filter_.languages else np.zeros(0)

        def apply(texts: pa.Array) -> list[pa.Array]:
            words, rows = split_words(texts)
            distinct, codes = encode_words(words)
            n = len(texts)
            letters = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)
            lettered = sum_by_row(letters[codes], rows, n) > 0
            hashes, of = word_grams(plain_words(distinct), SIZES)
            masks = filter_.masks(hashes)
            per_word = np.bincount(of, minlength=len(distinct))
            total = sum_by_row(per_word[codes], rows, n)
            corrected = np.zeros((len(filter_.languages), n))
            for k, rate in enumerate(false):
                hit = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits = np.bincount(of, weights=hit, minlength=len(distinct)).astype(np.int64)
                found = sum_by_row(hits[codes], rows, n)
                corrected[k] = np.maximum(0, (found - total * rate) / (1 - rate))
            if not filter_.languages:
                lettered &= False
                best, score = np.zeros(n, np.int64), np.zeros(n)
            else:
                best, score = corrected.argmax(0), corrected.max(0) / np.maximum(corrected.sum(0), 1e-300)
            score = np.where(lettered, score, 0.0)
            if where:
                return [pa.array(lettered & (score >= min_score))]
            names = pa.array([*filter_.languages, UNDETERMINED]).take(
                pa.array(np.where(lettered, best, len(filter_.languages))))
            return [names, pa.array(score)]

        return apply

    return map_texts(df, text, step, fields, keep, where="__passed" if where else None)
