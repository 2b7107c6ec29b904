"""Repeated passages between documents, found by fixed-block anchors.

Any passage of 50 words contains, wherever it starts, one whole *reference
block*: 25 consecutive words that begin at a multiple of 25 in their document.

1. Index and probe.  Reference blocks and all rolling 25-word windows meet by
   hash.  Documents travel in *parcels* of bounded text; a parcel sends each
   distinct hash once to the hash's bucket, with a flag for blocks and one for
   hashes of several documents.  A bucket sends back the *anchors*: hashes of a
   block that two documents hold.
2. Extend.  Around its anchors a parcel takes every 50-word window that contains
   one (no other can be repeated) and asks the window's bucket for the smallest
   document that holds it; the answer is one bit per window.  Windows of a
   document that a smaller one holds, taken together where they overlap, are the
   maximal exact repeats.

Copies of whole documents are told by a digest beforehand and take no part in 2.
Anchors are hints, so their hashes are cut to a few bits more than there are
words; windows are compared by 96 bits, beside the anchor.  A hash that many
documents share enters a bucket once per parcel, and what travels is sorted
hashes as compressed differences, a row per parcel and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bound_batches, encode_words, hash_strings, mix64, split_words, text_chunks, written

#: Words of a window, and of a reference block: every window contains a whole one.
WINDOW, BLOCK = 50, 25
#: Words per bucket of hashes.
BUCKET_WORDS = 1_000_000
#: Bits of an anchor's hash beyond those that number all words.
SPARE_BITS = 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as compressed differences, byte plane by byte plane."""
    return _planes(np.diff(sorted_values, prepend=np.uint64(0)))


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(data, n, np.uint64), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    size = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes(), "zstd", asbytes=True)


def _from_planes(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def _double(low: np.ndarray, high: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Rolling hashes of windows that are one of ``low`` and then one of ``high``, which has ``length`` words."""
    with np.errstate(over="ignore"):
        power = np.uint64(pow(int(base), length, 1 << 64))
        first = low[:len(low)]
        return first * power + high


def _rolling(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of all windows of ``size`` values, by doubling."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    power, length = words, 1           # hashes of windows of ``length`` = 1, 2, 4, ... words
    out, done = None, 0
    while True:
        if size & length:
            if out is None:
                out = power
            else:                      # ``out`` covers ``done`` words; ``length`` more go before them
                n = len(words) - (done + length) + 1
                out = _double(power[:n], out[length:length + n], done, base)
            done += length
        if done == size:
            return out[:len(words) - size + 1]
        n = len(words) - 2 * length + 1
        power, length = _double(power[:n], power[length:length + n], length, base), 2 * length


class _Words:
    """The words of some documents as hashes, and the windows inside a document."""

    def __init__(self, texts: pa.Array):
        flat, self.rows = split_words(texts)
        distinct, codes = encode_words(flat)
        self.hashes = mix64(hash_strings(distinct))[codes] if len(flat) else np.zeros(0, np.uint64)
        self.counts = np.bincount(self.rows, minlength=len(texts))
        self.starts = np.cumsum(self.counts) - self.counts

    def windows(self, size: int) -> np.ndarray:
        """Places of all windows of ``size`` words that lie in one document."""
        n = max(0, len(self.rows) - size + 1)
        return np.flatnonzero(self.rows[:n] == self.rows[len(self.rows) - n:])

    def anchors(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cut hashes of all rolling windows of ``BLOCK`` words."""
        at = self.windows(BLOCK)
        return at, mix64(_rolling(self.hashes, BLOCK, _BASE)[at]) >> np.uint64(shift)

    def long_windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows of ``WINDOW`` words at the places ``at``."""
        a = mix64(_rolling(self.hashes, WINDOW, _BASE)[at])
        b = mix64(_rolling(mix64(self.hashes ^ _OTHER), WINDOW, _OTHER | np.uint64(1))[at])
        return a, (b >> np.uint64(32)).astype(np.uint32)


def _buckets(hashes: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Bucket of hashes of ``bits`` bits; it does not fall as the hash rises."""
    top = hashes >> np.uint64(bits - 32) if bits > 32 else hashes << np.uint64(32 - bits)
    return ((top * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def _cuts(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each run of ascending bucket numbers."""
    if len(buckets):
        edges = np.flatnonzero(np.diff(buckets)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
            yield int(buckets[a]), a, b


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``parcel, row, id, words, n_words, kept_sha256`` of each row of ``docs``.

    ``words`` are the row's words joined by one space, null where no window can
    be repeated (fewer than ``WINDOW`` words, or a null key); ``kept_sha256`` is
    their digest.  A parcel is a bounded number of consecutive rows.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    names = ["parcel", "row", "id", "words", "n_words", "kept_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = TaskContext.get().partitionId() << 32
        for chunk in text_chunks(batches, 1):
            n = chunk.num_rows
            flat, rows = split_words(pc.fill_null(chunk.column(1), ""))
            counts = np.bincount(rows, minlength=n)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat), " ")
            digests = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in joined]
            short = pa.array(counts < WINDOW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, parcel)), pa.array(np.arange(n, dtype=np.int32)), chunk.column(0),
                 pc.if_else(pc.or_(short, pc.is_null(chunk.column(0))), pa.scalar(None, pa.string()), joined),
                 pa.array(counts.astype(np.int64)), pa.array(digests, pa.string())], names)
            parcel += 1

    return source.mapInArrow(run, "parcel long, row int, id long, words string, n_words long, kept_sha256 string")


def _parcels(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each parcel of batches that are ordered by their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        parcels = b.column(0).to_numpy()
        for parcel, start, end in _cuts(parcels):
            if held and held[0].column(0)[0].as_py() != parcel:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def anchors(measured: DataFrame, total: int) -> DataFrame:
    """``parcel, n, data``: the hashes of a parcel that a reference block and two documents hold.

    A row per parcel and bucket; ``data`` are ``n`` ascending hashes of ``anchor_bits(total)`` bits.
    """
    bits, n_buckets = anchor_bits(total), -(-total // BUCKET_WORDS)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcel, rows in _parcels(batches):
            words = _Words(_column(rows, "words"))
            ids = _column(rows, "id").to_numpy()
            at, hashes = words.anchors(64 - bits)
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            block = (at - words.starts[words.rows[at]]) % BLOCK == 0
            of = ids[words.rows[at]]
            first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
            if not len(first):
                continue
            several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
            flags = np.logical_or.reduceat(block, first).astype(np.uint64) * np.uint64(2) + several.astype(np.uint64)
            hashes = hashes[first]
            out = [(b, parcel, e - s, _pack(hashes[s:e] << np.uint64(2) | flags[s:e]))
                   for b, s, e in _cuts(_buckets(hashes, bits, n_buckets))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             ["bucket", "parcel", "n", "data"])

    def meet(bucket: pa.Table) -> pa.Table:
        parcels, sizes = bucket.column("parcel").to_pylist(), bucket.column("n").to_pylist()
        values = np.concatenate([_unpack(d, n) for d, n in zip(bucket.column("data").to_pylist(), sizes)])
        hashes, inverse, times = np.unique(values >> np.uint64(2), return_inverse=True, return_counts=True)
        flags = np.zeros(len(hashes), np.uint64)
        np.bitwise_or.at(flags, inverse, values & np.uint64(3))
        good = (flags >= 2) & ((times > 1) | (flags & np.uint64(1) > 0))
        keep, ends = good[inverse], np.cumsum(sizes)
        out = []
        for parcel, end, n in zip(parcels, ends, sizes):
            mine = (values[end - n:end] >> np.uint64(2))[keep[end - n:end]]
            if len(mine):
                out.append((parcel, len(mine), _pack(mine)))
        columns = zip(*out) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))],
                                    ["parcel", "n", "data"])

    probes = (measured.where("words is not null").select("parcel", "id", "words")
              .mapInArrow(probe, "bucket long, parcel long, n int, data binary"))
    return probes.groupBy("bucket").applyInArrow(meet, "parcel long, n int, data binary")


def anchor_bits(total: int) -> int:
    """Bits of an anchor's hash among ``total`` words (62 at most, as two flags travel with it)."""
    return min(62, max(32, total.bit_length() + SPARE_BITS))


_EXTENDED = ("parcel long, row int, id long, words string, runs array<int>, bucket long, n int, "
             "hashes binary, more binary, owner binary, owners array<long>")


def _runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))


def _distinct(words: _Words, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct windows (ascending, both parts), the smallest id of each, and the number of each place's window."""
    a, b = words.long_windows(at)
    order = np.lexsort((b, a))
    a, b, of = a[order], b[order], ids[words.rows[at]][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[first], b[first], np.minimum.reduceat(of, first) if len(first) else of, number


def extend(measured: DataFrame, found: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """The windows around anchors: rows of documents that have any (``runs``), and rows for buckets of windows."""
    bits, n_buckets = anchor_bits(total), -(-total // BUCKET_WORDS)
    names = [f.split()[0] for f in _EXTENDED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary(), pa.binary(),
             pa.binary(), pa.list_(pa.int64())]

    def look(docs: pa.Table, hints: pa.Table) -> pa.Table:
        none = pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        skipped = [r for r in hints.column("row").to_pylist() if r is not None]
        docs = docs.filter(pc.invert(pc.is_in(docs.column("row"), pa.array(skipped, pa.int32()))))
        packed = [_unpack(d, n) for d, n in zip(hints.column("data").to_pylist(), hints.column("n").to_pylist()) if d is not None]
        if not docs.num_rows or not packed:
            return none
        parcel = docs.column("parcel")[0].as_py()
        words, ids = _Words(_column(docs, "words")), _column(docs, "id").to_numpy()
        at, hashes = words.anchors(64 - bits)
        hints_sorted = np.sort(np.concatenate(packed))
        place = np.minimum(np.searchsorted(hints_sorted, hashes), len(hints_sorted) - 1)
        hit = np.zeros(len(words.rows) + 1, np.int64)
        hit[at[hints_sorted[place] == hashes] + 1] = 1
        hit = np.cumsum(hit)
        at = words.windows(WINDOW)
        at = at[hit[at + WINDOW - BLOCK + 1] > hit[at]]
        if not len(at):
            return none
        mask = np.zeros(len(words.rows), bool)
        mask[at] = True
        touched = np.unique(words.rows[at]).tolist()
        runs = [_runs(mask[words.starts[i]:words.starts[i] + words.counts[i]]).tolist() for i in touched]
        some = docs.take(pa.array(touched))
        out = [[parcel] * len(touched), some.column("row").to_pylist(), some.column("id").to_pylist(),
               some.column("words").to_pylist(), runs, *([None] * len(touched) for _ in range(6))]
        a, b, low, _ = _distinct(words, at, ids)
        for bucket, s, e in _cuts(_buckets(a, 64, n_buckets)):
            owners, owner = np.unique(low[s:e], return_inverse=True)
            for column, value in zip(out, (parcel, None, None, None, None, bucket, e - s, _pack(a[s:e]), _planes(b[s:e]),
                                           _planes(owner.astype(np.uint32)), owners.tolist())):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    hints = found.withColumn("row", F.lit(None).cast("int")).unionByName(
        copies.select("parcel", "row"), allowMissingColumns=True).select("parcel", "row", "n", "data")
    docs = measured.where("words is not null").select("parcel", "row", "id", "words")
    return docs.groupBy("parcel").cogroup(hints.groupBy("parcel")).applyInArrow(look, _EXTENDED)


def earlier(extended: DataFrame) -> DataFrame:
    """``parcel, bucket, bits``: for each window that a parcel asked for, whether a smaller document elsewhere holds it."""
    def compare(bucket: pa.Table) -> pa.Table:
        sizes = bucket.column("n").to_pylist()
        a = np.concatenate([_unpack(d, n) for d, n in zip(bucket.column("hashes").to_pylist(), sizes)])
        b = np.concatenate([_from_planes(d, n, np.uint32) for d, n in zip(bucket.column("more").to_pylist(), sizes)])
        low = np.concatenate([np.array(o, np.int64)[_from_planes(d, n, np.uint32)] for o, d, n in zip(
            bucket.column("owners").to_pylist(), bucket.column("owner").to_pylist(), sizes)])
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        least = np.minimum.reduceat(low[order], np.flatnonzero(new))
        beaten = np.empty(len(a), bool)
        beaten[order] = least[np.cumsum(new) - 1] < low[order]
        ends = np.cumsum(sizes)
        return pa.Table.from_arrays([
            bucket.column("parcel").combine_chunks(), bucket.column("bucket").combine_chunks(),
            pa.array([np.packbits(beaten[e - n:e]).tobytes() for e, n in zip(ends, sizes)], pa.binary())], ["parcel", "bucket", "bits"])

    asked = extended.where("bucket is not null").select("bucket", "parcel", "n", "hashes", "more", "owner", "owners")
    return asked.groupBy("bucket").applyInArrow(compare, "parcel long, bucket long, bits binary")


def spans(extended: DataFrame, answers: DataFrame, total: int) -> DataFrame:
    """``parcel, row, spans, n_removed, kept_sha256`` of the documents with repeats.

    ``spans`` hold the first word (from 0) and the one after the last of each maximal repeat or chain of overlapping ones.
    """
    n_buckets = -(-total // BUCKET_WORDS)
    names = ["parcel", "row", "spans", "n_removed", "kept_sha256"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int32(), span, pa.int64(), pa.string()]

    def remove(docs: pa.Table, bits: pa.Table) -> pa.Table:
        words, ids = _Words(_column(docs, "words")), _column(docs, "id").to_numpy()
        runs = docs.column("runs").to_pylist()
        at = np.concatenate([np.arange(a, b) + s for r, s in zip(runs, words.starts) for a, b in zip(r[::2], r[1::2])])
        a, _, low, number = _distinct(words, at, ids)
        answer = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()))
        beaten = np.zeros(len(a), bool)
        for bucket, s, e in _cuts(_buckets(a, 64, n_buckets)):
            beaten[s:e] = np.unpackbits(np.frombuffer(answer[bucket], np.uint8), count=e - s)
        lost = at[beaten[number] | (low[number] < ids[words.rows[at]])]
        cover = np.zeros(len(words.rows) + 1, np.int32)
        np.add.at(cover, lost, 1)
        np.add.at(cover, lost + WINDOW, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for i in np.unique(words.rows[lost]).tolist():
            mine = gone[words.starts[i]:words.starts[i] + words.counts[i]]
            edges = _runs(mine).tolist()
            kept = np.array(docs.column("words")[i].as_py().split(" "), object)[~mine]
            out.append((docs.column("parcel")[i].as_py(), docs.column("row")[i].as_py(),
                        [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])], int(mine.sum()),
                        hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    docs = extended.where("bucket is null").select("parcel", "row", "id", "words", "runs")
    return docs.groupBy("parcel").cogroup(answers.groupBy("parcel")).applyInArrow(
        remove, "parcel long, row int, spans array<struct<start: int, end: int>>, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    r"""``key, n_words, n_removed, kept_sha256, spans`` of each row of ``docs``.

    Words are ``[^\x20\x09-\x0D]+``, unchanged.  A word is removed if a window
    of ``WINDOW`` words covers it whose words, in order, also occur in a row
    with a smaller key.  ``spans`` are the removed words, ``kept_sha256`` the
    digest of the others joined by one space (``without`` gives that text).

    A null text has no words.  Rows that share a key don't count as smaller
    than each other; rows with a null key remove nothing and keep all.  Other
    columns play no part; an empty table gives an empty result.
    """
    measured = written(measure(docs, text, key), "measured")
    able = measured.where("words is not null")
    total = able.agg(F.sum("n_words")).first()[0] or 0
    columns = [F.col("id").alias(key), "n_words"]
    nothing = F.array().cast("array<struct<start: int, end: int>>")
    if not total:
        return measured.select(*columns, F.lit(0).cast("long").alias("n_removed"), "kept_sha256", nothing.alias("spans"))
    classes = (able.groupBy("kept_sha256", "n_words").agg(F.min("id").alias("low"), F.max("id").alias("high"))
               .where("low < high").select("kept_sha256", "n_words", "low"))
    copies = written(able.select("parcel", "row", "id", "n_words", "kept_sha256").join(classes, ["kept_sha256", "n_words"])
                     .where("id > low").select("parcel", "row"), "copies")
    extended = written(extend(measured, anchors(measured, total), copies, total), "extended")
    found = spans(extended, earlier(extended), total).unionByName(
        copies.select("parcel", "row", F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans"),
                      F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit(b""), 256).alias("kept_sha256")))
    found = found.withColumnRenamed("kept_sha256", "left_sha256")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    touched = F.col("left_sha256").isNotNull()
    return measured.drop("words").join(found, ["parcel", "row"], "left").select(
        *columns,
        F.when(touched, F.coalesce("n_removed", "n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce("left_sha256", "kept_sha256").alias("kept_sha256"),
        F.when(touched, F.coalesce("spans", whole)).otherwise(nothing).alias("spans"))


def without(text: Column, removed: Column) -> Column:
    """The words of ``text`` outside the spans ``removed``, joined by one space."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w, i: ~F.exists(removed, lambda s: (s["start"] <= i) & (i < s["end"]))), " ")


ORACLE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS s
  FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts WHERE doc_id IS NOT NULL)),
firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
lost AS (SELECT DISTINCT r, j FROM (
  SELECT r, i + unnest(range(0, {WINDOW})) AS j FROM windows JOIN firsts USING (s) WHERE low < doc_id)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM texts),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) FILTER (l.j IS NULL) AS kept, count(l.j) AS n_removed
  FROM words LEFT JOIN lost l USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
