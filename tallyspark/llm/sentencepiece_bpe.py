"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is split before every space that follows a non-space; as no piece of the
vocabulary holds a space mark after another character, the segments encode on
their own.  Each segment merges by a score-ordered agenda of its adjacent
symbol pairs: the best-scored pair first, the leftmost of equals.  Short
segments of an Arrow batch run their agendas side by side in numpy (each round
merges the head of every agenda); long ones use a heap.  Both give the ids of
the ``sentencepiece`` library, which can be asked for comparison per batch.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.common import map_texts

MARK = "▁"
#: Segments with more characters use the heap agenda instead of the batched one.
LONG_SEGMENT = 48
#: Segments that a worker's cache holds at most.
CACHE = 200_000
_NONE = np.int32(2**31 - 1)


class MergeVocabulary:
    """Pieces, scores and the table of mergeable symbol pairs of a BPE model file."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        n = lib.get_piece_size()
        self.size = n
        self.byte_ids = np.full(256, -1, np.int64)
        self.surfaces: list[bytes] = []
        self.is_byte = np.zeros(n, bool)
        ids: dict[str, int] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                self.surfaces.append(bytes([value]))
            elif lib.is_control(i):
                self.surfaces.append(b"")
            elif lib.is_unknown(i):
                self.surfaces.append(lib.decode([i]).encode())
                self.is_byte[i] = True  # keeps its leading space, as byte pieces do
            elif lib.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece holds a space mark inside; segments would not be independent")
                ids[piece] = i
                self.surfaces.append(piece.replace(MARK, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        if lib.encode("  a") != lib.encode(MARK + MARK + "a") or lib.decode(lib.encode(" a ")) != " a ":
            raise ValueError("the model's normaliser is not the identity with a leading space")
        scores = np.array([lib.get_score(i) for i in range(n)])
        order = {s: r for r, s in enumerate(sorted(set(scores[list(ids.values())]), reverse=True))}
        # Symbols: pieces by id, then the characters of pieces that are no piece themselves.
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - set(ids)):
            symbols[c] = n + len(symbols) - len(ids)
        self.width = n + len(symbols) - len(ids) + 1
        self.other = self.width - 1  # any other character
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (order[scores[i]], i)
        self.pairs = pairs
        # Open addressing with few filled slots, for look-ups of whole arrays.
        self.slot_bits = max(10, (8 * len(pairs)).bit_length())
        self.slot_keys = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_ranks = np.full(1 << self.slot_bits, _NONE, np.int32)
        self.slot_ids = np.full(1 << self.slot_bits, -1, np.int32)
        for key, at in zip(pairs, self._slots(np.array(list(pairs), np.int64)).tolist()):
            while self.slot_keys[at] >= 0:
                at = (at + 1) & ((1 << self.slot_bits) - 1)
            self.slot_keys[at] = key
            self.slot_ranks[at], self.slot_ids[at] = pairs[key]
        self.char_symbols = {c: s for c, s in symbols.items() if len(c) == 1}
        self.low = np.full(0x10000, self.other, np.int32)
        self.high: dict[int, int] = {}
        for c, s in self.char_symbols.items():
            if ord(c) < 0x10000:
                self.low[ord(c)] = s
            else:
                self.high[ord(c)] = s
        self.no_cache = (pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))
        self.cache = self.no_cache
        self.low[ord(" ")] = self.char_symbols.get(MARK, self.other)

    def char_to_symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbol numbers of code points (a space stands for the mark)."""
        out = self.low[np.minimum(points, 0xFFFF)]
        beyond = np.flatnonzero(points > 0xFFFF)
        if len(beyond):
            out[beyond] = [self.high.get(int(p), self.other) for p in points[beyond]]
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the lower, the sooner; none: the largest) and the merged piece."""
        key = left.astype(np.int64) * self.width + right
        at = self._slots(key)
        there = self.slot_keys[at]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.slot_bits) - 1)
            there = self.slot_keys[at[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return self.slot_ranks[at], self.slot_ids[at]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        product = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (product >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def spell(self, symbol: int, char: str) -> list[int]:
        """Ids of a symbol: itself if a piece, else the bytes of its character."""
        return [symbol] if symbol < self.size else [int(self.byte_ids[b]) for b in char.encode()]

    def encode_segment(self, segment: str) -> list[int]:
        """One segment by a heap agenda: O(n log n) for any length."""
        chars = segment.replace(" ", MARK)
        symbols = self.char_to_symbols(np.frombuffer(segment.encode("utf-32-le"), "<u4")).tolist()
        n, width, pairs = len(symbols), self.width, self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def propose(i: int) -> None:
            j = after[i]
            if j < n and (hit := pairs.get(symbols[i] * width + symbols[j])):
                heapq.heappush(agenda, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n):
            propose(i)
        while agenda:
            _, i, left, right, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                propose(before[i])
            propose(i)
        out: list[int] = []
        i = 0
        while i < n:
            out += self.spell(symbols[i], chars[i])
            i = after[i]
        return out

    def encode_segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many segments, flat, and the bounds of each segment's ids."""
        n = len(segments)
        lengths = pc.utf8_length(segments).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(segments.to_pylist()).encode("utf-32-le"), "<u4")
        long = np.flatnonzero(lengths > LONG_SEGMENT)
        row = np.repeat(np.arange(n), lengths)
        if len(long):
            short = np.repeat(lengths <= LONG_SEGMENT, lengths)
            points, row = points[short], row[short]
        symbol = self.char_to_symbols(points)
        char = points.astype(np.int64)
        done_rows, done_symbols, done_chars = [], [], []
        same = np.append(row[1:] == row[:-1], False)
        rank = np.full(len(row), _NONE, np.int32)
        made = np.zeros(len(row), np.int32)
        at = np.flatnonzero(same)
        rank[at], made[at] = self.look_up(symbol[at], symbol[at + 1])
        while len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(row)))
            best = np.minimum.reduceat(rank, first)
            # Segments whose agenda is empty are done.
            ended = best == _NONE
            if ended.any():
                gone = np.repeat(ended, size)
                done_rows.append(row[gone])
                done_symbols.append(symbol[gone])
                done_chars.append(char[gone])
                stay = ~gone
                row, symbol, char, rank, made = row[stay], symbol[stay], char[stay], rank[stay], made[stay]
                best, size = best[~ended], size[~ended]
                if not len(row):
                    break
            # The head of each agenda: the leftmost pair of the best rank.
            heads = np.flatnonzero(rank == np.repeat(best, size))
            heads = heads[np.append(True, row[heads[1:]] != row[heads[:-1]])]
            symbol[heads] = made[heads]
            stay = np.ones(len(row), bool)
            stay[heads + 1] = False
            heads -= np.arange(len(heads))  # one symbol goes before each later head
            row, symbol, char, rank, made = row[stay], symbol[stay], char[stay], rank[stay], made[stay]
            # Only pairs beside a merge change.
            left = heads[(heads > 0) & (row[heads - 1] == row[heads])] - 1
            right = heads[np.append(row, -1)[heads + 1] == row[heads]]
            rank[heads] = _NONE
            at = np.concatenate([left, right])
            rank[at], made[at] = self.look_up(symbol[at], symbol[at + 1])
        if done_rows:
            row, symbol, char = (np.concatenate(x) for x in (done_rows, done_symbols, done_chars))
        ids, row = self._spell_all(row, symbol.astype(np.int64), char)
        if len(long):
            extra = [self.encode_segment(s) for s in segments.take(pa.array(long)).to_pylist()]
            row = np.concatenate([row, np.repeat(long, [len(x) for x in extra])])
            ids = np.concatenate([ids, np.array([i for x in extra for i in x], np.int64)])
        order = np.argsort(row, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(row[order], np.arange(n + 1))

    def _spell_all(self, row: np.ndarray, symbol: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelt = np.flatnonzero(symbol >= self.size)
        if not len(spelt):
            return symbol, row
        as_bytes = [chr(c if c != 32 else 0x2581).encode() for c in char[spelt].tolist()]
        times = np.ones(len(symbol), np.int64)
        times[spelt] = [len(b) for b in as_bytes]
        out, rows = np.repeat(symbol, times), np.repeat(row, times)
        out[np.repeat(symbol >= self.size, times)] = self.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
        return out, rows

    def encode_distinct(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_segments``, with the segments of earlier batches from a bounded cache."""
        n = len(segments)
        known, known_ids, known_at = self.cache
        at = pc.fill_null(pc.index_in(segments, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        missing = segments.take(pa.array(new))
        ids, bounds = self.encode_segments(missing)
        at[new] = len(known) + np.arange(len(new))
        all_ids = np.concatenate([known_ids, ids])
        all_at = np.concatenate([known_at, known_at[-1] + bounds[1:]])
        lengths = np.diff(all_at)[at]
        ends = np.cumsum(lengths)
        out = all_ids[np.repeat(all_at[at] - (ends - lengths), lengths) + np.arange(ends[-1] if n else 0)]
        bounds = np.concatenate([[0], ends])
        # Grow while there is room, else begin anew with this batch's segments.
        grown = (pa.concat_arrays([known, missing]), all_ids, all_at)
        for cache in (grown, (segments, out, bounds), self.no_cache):
            if len(cache[0]) <= CACHE and cache[0].nbytes <= 32 * CACHE:
                self.cache = cache
                break
        return out, bounds

    def encode_texts(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text, without begin or end ids."""
        spaced = pc.replace_substring(texts, MARK, " ")
        full = pc.greater(pc.binary_length(spaced), 0)
        spaced = pc.if_else(full, pc.binary_join_element_wise(" ", spaced, ""), "")
        n = len(spaced)
        offsets = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset:spaced.offset + n + 1]
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[:offsets[-1]]
        space = data == 32
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(starts)
        starts = starts[starts >= offsets[0]]
        if not len(starts):
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
        bounds = np.append(starts, offsets[-1]).astype(np.int32)
        segments = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), spaced.buffers()[2])
        coded = segments.dictionary_encode()
        ids, at = self.encode_distinct(coded.dictionary)
        codes = coded.indices.to_numpy()
        lengths = np.diff(at)[codes]
        ends = np.cumsum(lengths)
        flat = ids[np.repeat(at[codes] - (ends - lengths), lengths) + np.arange(ends[-1])]
        by_text = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(by_text.astype(np.int32)), pa.array(flat))

    def decode_ids(self, lists: pa.ListArray) -> pa.Array:
        """Text of each list of ids, as the library's ``decode``.

        The first leading space goes; bytes that are not UTF-8 become U+FFFD each;
        control ids, which ``encode`` never makes, stand for nothing.
        """
        # A text's first piece has its leading space off; byte pieces stay as they are.
        first = [s if b else s.removeprefix(b" ") for s, b in zip(self.surfaces, self.is_byte)]
        surfaces = pa.array(self.surfaces + first, pa.binary())
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = lists.flatten().to_numpy().astype(np.int64)
        ids[offsets[:-1][np.diff(offsets) > 0]] += self.size
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), surfaces.take(pa.array(ids))), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self._lenient(b) for b in joined.to_pylist()], pa.string())

    @staticmethod
    def _lenient(raw: bytes) -> str:
        out = []
        while raw:
            try:
                return "".join(out) + raw.decode()
            except UnicodeDecodeError as e:
                out.append(raw[:e.start].decode() + "�")
                raw = raw[e.start + 1:]
        return "".join(out)


_loaded: dict[str, MergeVocabulary] = {}


def vocabulary(model_path: str) -> MergeVocabulary:
    """The vocabulary of a model file, loaded once per process."""
    if model_path not in _loaded:
        _loaded[model_path] = MergeVocabulary(model_path)
    return _loaded[model_path]


def encode_documents(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                     decode: bool = False, check: bool = False) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int), the encoding of each whole text.

    ``decode`` adds ``decoded``, the text that the ids stand for; ``check`` adds
    ``as_library``, true where the ``sentencepiece`` library gives the same ids
    (asked per Arrow chunk, on one thread).  Null and empty texts have no ids and
    decode to the empty text.  Repeated rows are encoded each; an empty table
    stays empty.  A kept column with the name of a result is replaced.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))
    if check:
        fields.append(T.StructField("as_library", T.BooleanType()))

    def step():
        vocab = vocabulary(model_path)

        def apply(texts: pa.Array) -> list[pa.Array]:
            ids = vocab.encode_texts(texts)
            out = [ids]
            if decode:
                out.append(vocab.decode_ids(ids))
            if check:
                theirs = vocab.library.encode(texts.to_pylist(), num_threads=1)
                out.append(pa.array([a == b for a, b in zip(ids.to_pylist(), theirs)], pa.bool_()))
            return out

        return apply

    return map_texts(df, text, step, fields, keep)
