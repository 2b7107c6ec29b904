"""Helpers shared by the training-data operators: bounded text chunks, word splits, splits by id."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import scratch_path

#: Text bytes that one step of a Python worker handles at once (a single longer text is one step).
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch at most; it is held by the JVM and by the worker, beside the chunk.
BATCH_ROWS = 1024

TextStep = Callable[[pa.Array], Sequence[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared checkpoint folder: it outlives lost executors.

    ``session.release`` deletes it, ``session.release_all`` all of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lineage_path = path
    return out


def held_out(doc_id: Column) -> Column:
    """True for documents kept out of learning: crc32(doc_id as text) mod 3 is 1 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for documents that may be learnt from (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def text_chunks(batches: Iterable[pa.RecordBatch], column: int,
                max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``, as rows here are whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, text: str, step: Callable[[], TextStep], fields: Sequence[T.StructField],
              keep: Sequence[str], where: str | None = None) -> DataFrame:
    """Run ``step()`` over bounded chunks of a text column, in Arrow batches.

    ``step`` is called once per task and returns a function from a string array
    (nulls already empty) to one Arrow array per field.  The result has the
    columns ``keep`` (as they are) and then ``fields``; a kept column with the
    name of a field gives way to it.  ``where`` names a boolean field: only rows
    where it is true are returned, and the field itself is left out.
    """
    bound_batches(df.sparkSession)
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    kept_fields = [source.schema.fields[i] for i in range(len(keep))]
    out_fields = [f for f in fields if f.name != where]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = step()
        for chunk in text_chunks(batches, n_keep):
            made = apply(pc.fill_null(chunk.column(n_keep), ""))
            arrays = [chunk.column(i) for i in range(n_keep)]
            arrays += [a for a, f in zip(made, fields) if f.name != where]
            out = pa.RecordBatch.from_arrays(arrays, [*keep, *[f.name for f in out_fields]])
            if where is not None:
                out = out.filter(made[names.index(where)])
            yield out
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, T.StructType([*kept_fields, *out_fields]))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, flat, and the row number of each word."""
    lists = pc.ascii_split_whitespace(texts)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows.filter(full).to_numpy()


def encode_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and, for each word, its number among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def sum_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums of ``values`` per row number."""
    if not len(values):
        return np.zeros(n, np.int64)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    bounds = np.searchsorted(rows, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit xxh3 hash of each string."""
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``key`` (all, if there are fewer)."""
    if total <= rows:
        return df
    cut = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(key, F.lit(20)), F.lit(1 << 30)) < cut)


def word_grams(words: pa.Array, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character n-grams of each word, edges marked, and each gram's word number."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    lengths = pc.utf8_length(marked).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(words)), lengths)
    hashes, rows = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes) + 1):
        rolling = rolling[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:]
        if n in sizes and len(rolling):
            inside = row[:len(rolling)] == row[n - 1:]
            hashes.append(mix64(rolling[inside] + np.uint64(n)))
            rows.append(row[:len(rolling)][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def plain_words(words: pa.Array) -> pa.Array:
    """Lower-case words without the punctuation around them."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=_PUNCTUATION)


_PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&=+-_/\\~`^@"
