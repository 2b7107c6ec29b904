"""Token counts by a map-side two-tier lookup of pre-token lengths.

White space always ends a pre-token of the supported tokenizers, so the count of
a text is the sum over its white-space-separated pieces.  Tier one is a compact
broadcast table with the token counts of frequent pieces; tier two is a bounded
cache in each Python worker, whose misses the tokenizer itself encodes in
batches.  Nothing is shuffled: counts are added up where the text is read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import bounded_sample, encode_words, map_texts, split_words, sum_by_row

#: Pieces in the broadcast table: bounds it to a few MB for any corpus.
FREQUENT = 60_000
#: Rows whose pieces are counted to choose the frequent ones; the choice moves time, never results.
FREQUENT_SAMPLE = 4_000
#: Pieces held by a worker's cache before its older half is let go.
CACHE = 200_000
#: Longer pieces are encoded but not kept.
CACHE_CHARS = 64


class PieceCounter:
    """Token counts of white-space-free pieces, through a worker's cache."""

    def __init__(self, tokenizer_path: str, capacity: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.capacity = capacity
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(pieces), 4096):
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces[i:i + 4096], add_special_tokens=False)]
        return out

    def counts(self, pieces: list[str]) -> np.ndarray:
        new, old = self.new, self.old
        got = [new.get(p) or old.get(p) or -1 for p in pieces]
        missing = [i for i, n in enumerate(got) if n < 0]
        for i, n in zip(missing, self.encode([pieces[i] for i in missing])):
            got[i] = n
            if len(pieces[i]) <= CACHE_CHARS:
                new[pieces[i]] = n
                if len(new) >= self.capacity // 2:
                    self.old, self.new = new, {}
                    new = self.new
        return np.array(got, np.int64)


def frequent_pieces(df: DataFrame, text: str, tokenizer_path: str, top: int = FREQUENT,
                    sample_rows: int = FREQUENT_SAMPLE) -> tuple[list[str], list[int]]:
    """The most frequent pieces of a hash sample of rows, with their token counts (at most ``top``)."""
    total = df.count()
    col = F.col(f"`{text}`")
    sample = bounded_sample(df.select(col.cast("string").alias("t")), F.col("t"), sample_rows, total)
    rows = (sample.select(F.explode(F.split("t", r"[\x20\x09-\x0D]+")).alias("p"))
            .where((F.length("p") > 0) & (F.length("p") <= CACHE_CHARS))
            .groupBy("p").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "p").limit(top).select("p").collect())
    pieces = [r.p for r in rows]
    return pieces, PieceCounter(tokenizer_path).encode(pieces)


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 frequent: tuple[list[str], list[int]] | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``: the count that the tokenizer library gives for the whole text.

    ``tokenizer_path`` names a ``tokenizers`` JSON file whose pre-tokenizer drops
    white space.  No begin, end or other special tokens are added; the strings
    of special tokens inside a text count as the library's default has it.  Null
    and empty texts have 0 tokens.  Repeated rows are counted each; an empty
    table gives an empty table.  A kept column named ``n_tokens`` is replaced.
    """
    pieces, lengths = frequent if frequent is not None else frequent_pieces(df, text, tokenizer_path)
    shared = df.sparkSession.sparkContext.broadcast((pieces, np.array(lengths, np.int64)))

    def step():
        values, known = shared.value
        known = np.concatenate([known, [0]])
        value_set, counter = pa.array(values, pa.string()), PieceCounter(tokenizer_path)

        def apply(texts: pa.Array) -> list[pa.Array]:
            words, rows = split_words(texts)
            distinct, codes = encode_words(words)
            at = pc.fill_null(pc.index_in(distinct, value_set=value_set), -1).to_numpy(zero_copy_only=False)
            counts = known[at]
            misses = np.flatnonzero(at < 0)
            if len(misses):
                counts[misses] = counter.counts(distinct.take(pa.array(misses)).to_pylist())
            return [pa.array(sum_by_row(counts[codes], rows, len(texts)), pa.int64())]

        return apply

    return map_texts(df, text, step, [T.StructField("n_tokens", T.LongType())], keep)
