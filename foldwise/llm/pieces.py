"""SentencePiece segmentation of whole texts as a max-plus scan, and decoding.

Pieces, scores and byte fallback come from a public model file.  The segmentation is the one of highest total
score, as in the format's unigram models; a character outside the vocabulary scores 10 below the least piece.  The
file of a merge model holds ranks in place of log-probabilities; rank r then scores -log(r + 2), as Zipf's law has it.
Among equals the path whose last piece is longest wins, from the end backwards.

* No piece holds a space mark after another character, so a text may be cut there without changing the result.
  The distinct segments of a batch are solved once, many at a time.
* A giant text is split into chunks of ``CHUNK`` characters that lie in different tasks.  The state at a chunk border
  is how far the first piece boundary lies behind it, below the longest piece's length.  Each chunk yields a
  max-plus transfer matrix between states; the matrices of a text are combined by an associative scan, which fixes
  the state at every border, and each chunk is then traced back on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bytetext as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and from how many on a text is split.
CHUNK = 4096
GIANT = 16 * CHUNK
NONE = -np.inf
_SPACE = 0x20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces of a model file as a trie over characters, in open-addressed arrays."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.bytes_of: list[bytes] = []
        scores, normal, self.byte_ids, self.unknown, merges = [], [], np.full(256, -1, np.int32), 0, False
        for number, value in _fields(model):
            if number == 2:
                merges = dict(_fields(value)).get(3, 1) == 2
            if number != 1:
                continue
            piece = dict(_fields(value))
            text, kind = piece[1].decode(), piece.get(3, 1)
            score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
            at = len(self.text)
            self.text.append(text)
            scores.append(score)
            if kind == 6:
                self.byte_ids[int(text[3:5], 16)] = at
                self.bytes_of.append(bytes([int(text[3:5], 16)]))
            elif kind in (1, 4):
                normal.append((text.replace("▁", " "), at))
                self.bytes_of.append(text.replace("▁", " ").encode())
            else:
                self.unknown = at if kind == 2 else self.unknown
                self.bytes_of.append(b"")
        if any(" " in text.lstrip(" ") for text, _ in normal):
            raise ValueError("a piece holds a space mark after another character; texts can't be cut before spaces")
        self.scores = np.array(scores)
        if merges:
            self.scores = -np.log(2 - self.scores)
        # multiples of 2^-16 add up exactly, so the grouping of a sum never changes it
        self.scores = np.round(self.scores * 65536) / 65536
        self.unknown_score = min(self.scores[at] for _, at in normal) - 10
        self.longest = max(len(text) for text, _ in normal)
        letters = sorted({c for text, _ in normal for c in text})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for text, at in normal:
            node = 0
            for c in text:
                node = nodes.setdefault((node, int(self.letter[ord(c)])), len(nodes) + 1)
            ends[node] = at
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.width = width
        bits = max(8, (4 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.array([a * width + c for a, c in nodes], np.int64)
        slot = self._slot(keys)
        for k, s, node in zip(keys.tolist(), slot.tolist(), nodes.values()):
            while self.key[s] >= 0:
                s = (s + 1) & ((1 << bits) - 1)
            self.key[s], self.next[s] = k, node
        lengths = np.array([len(b) for b in self.bytes_of])
        self.byte_bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The trie node after each letter, 0 where there is none."""
        keys = node.astype(np.int64) * self.width + letter
        slot, out = self._slot(keys), np.zeros(len(keys), np.int32)
        left = np.flatnonzero(letter > 0)
        while len(left):
            held = self.key[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.next[slot[left[same]]]
            left = left[~same & (held >= 0)]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)
        return out

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of each length (first axis, from 1) that starts at each place of rows of characters.

        Rows are padded with -1.  A character that is no piece has the unknown score and id -1.
        """
        n, size = codes.shape
        letter = np.where(codes >= 0, self.letter[np.maximum(codes, 0)], 0)
        score = np.full((self.longest, n, size), NONE)
        ids = np.full((self.longest, n, size), -1, np.int32)
        at = np.flatnonzero(codes.reshape(-1) >= 0)
        column = at % size
        flat_letter, node = letter.reshape(-1), np.zeros(len(at), np.int32)
        for k in range(self.longest):
            inside = column + k < size
            at, column, node = at[inside], column[inside], node[inside]
            node = self.step(node, flat_letter[at + k])
            alive = node > 0
            at, column, node = at[alive], column[alive], node[alive]
            piece = self.piece[node]
            full = piece >= 0
            score[k].reshape(-1)[at[full]] = self.scores[piece[full]]
            ids[k].reshape(-1)[at[full]] = piece[full]
            if not len(at):
                break
        single = score[0]
        single[(codes >= 0) & (ids[0] < 0)] = self.unknown_score
        return score, ids


@lru_cache(maxsize=2)
def _load(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as f:
        return Vocabulary(f.read())


def ship_model(spark: SparkSession, model: str = MODEL) -> str:
    """Send the model file to every task; its name there."""
    spark.sparkContext.addFile(model)
    return model.rstrip("/").rsplit("/", 1)[-1]


def _forward(score: np.ndarray, start: np.ndarray, last_start: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Best scores of each boundary: (places + longest, rows, states) from ``start`` (rows, states, longest states of entry).

    ``start`` gives for each row and state the score of each entry place; pieces start before ``last_start`` only.
    ``lengths``, when given, receives the length of the best piece that ends at each boundary (first state only).
    """
    longest, n, size = score.shape
    states = start.shape[1]
    best = np.full((last_start + 2 * longest, n, states), NONE)  # place t is stored at t + longest
    for place in range(start.shape[2]):
        best[longest + place] = start[:, :, place]
    # ending[l, t]: score of the piece of length l + 1 that ends at t
    for t in range(1, last_start + longest):
        reach = range(max(1, t - last_start + 1), longest + 1)
        if not len(reach):
            break
        l = np.arange(reach[-1], reach[0] - 1, -1)
        l = l[t - l >= 0]
        if not len(l):
            continue
        inside = t - l < size
        l = l[inside]
        options = best[longest + t - l] + score[l - 1, :, t - l][:, :, None]
        top = options.max(axis=0)
        if lengths is not None:
            better = top[:, 0] > best[longest + t][:, 0]
            lengths[t][better] = l[options[:, :, 0].argmax(axis=0)][better]
        best[longest + t] = np.maximum(best[longest + t], top)
    return best[longest:]


def _trace(lengths: np.ndarray, ids: np.ndarray, entry: np.ndarray, exit_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start place and id of the pieces between entry and exit place of each row, in order."""
    rows, at = np.arange(len(entry)), exit_.astype(np.int64)
    found = []
    while True:
        on = at > entry[rows]
        rows, at = rows[on], at[on]
        if not len(rows):
            break
        size = lengths[at, rows]
        at = at - size
        found.append((rows, at, ids[size - 1, rows, at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    r, a, i = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((a, r))
    return r[order], a[order], i[order]


def _with_bytes(vocabulary: Vocabulary, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace unknown characters (id -1, character in ``codes``) by the ids of their bytes, or by the unknown id."""
    gone = np.flatnonzero(ids < 0)
    if not len(gone):
        return rows, ids
    spelled = [[int(vocabulary.byte_ids[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes[gone].tolist()]
    spelled = [s if min(s) >= 0 else [vocabulary.unknown] for s in spelled]
    count = np.ones(len(ids), np.int64)
    count[gone] = [len(s) for s in spelled]
    out_rows, out = np.repeat(rows, count), np.repeat(ids, count)
    out[out < 0] = [x for s in spelled for x in s]
    return out_rows, out


def _solve(vocabulary: Vocabulary, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of the pieces of whole rows of characters padded with -1."""
    score, ids = vocabulary.matches(codes)
    lengths = np.zeros((codes.shape[1] + 2 * vocabulary.longest, len(codes)), np.int64)
    _forward(score, np.zeros((len(codes), 1, 1)), codes.shape[1], lengths)
    rows, place, piece = _trace(lengths, ids, np.zeros(len(codes), np.int64), sizes)
    return _with_bytes(vocabulary, rows, piece, codes[rows, place])


def transfer(vocabulary: Vocabulary, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The max-plus matrix of each chunk: best score from entry state to exit state.

    ``codes`` holds each chunk's ``sizes`` own characters and up to longest - 1 characters that follow.
    """
    longest = vocabulary.longest
    out = np.full((len(codes), longest, longest), NONE)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        score, _ = vocabulary.matches(codes[rows])
        entry = np.where(np.eye(longest) > 0, 0.0, NONE)
        best = _forward(score, np.broadcast_to(entry, (len(rows), longest, longest)), int(size))
        out[rows] = best[size : size + longest].transpose(1, 2, 0)
    return out


def times(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return (one[:, :, :, None] + two[:, None, :, :]).max(axis=2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Inclusive prefix products by doubling: log2(n) rounds of products of independent pairs."""
    out, reach = matrices.copy(), 1
    while reach < len(out):
        out[reach:] = times(out[:-reach], out[reach:])
        reach *= 2
    return out


def border_states(matrices: np.ndarray) -> np.ndarray:
    """The state at every chunk border of the best path that starts and ends in state 0 (one more than chunks).

    Among equally good paths a border takes the lowest state.
    """
    prefix = scan(matrices)
    states = np.zeros(len(matrices) + 1, np.int64)
    for k in range(len(matrices) - 1, 0, -1):
        value = prefix[k - 1][0] + matrices[k][:, states[k + 1]]
        states[k] = int(value.argmax())
    return states


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the segments: a space after another byte, a line end, what follows a line end, a text's start."""
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    space, line = data == _SPACE, data == 0x0A
    first = line.copy()
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    return np.flatnonzero(first | head[:-1])


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All characters of byte ranges one after another, and how many each range has."""
    size = ends - starts
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    picked = data[at]
    codes = np.frombuffer(picked.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.int32)
    lead = np.concatenate([[0], np.cumsum((picked & 0xC0) != 0x80)])
    bounds = np.concatenate([[0], np.cumsum(size)])
    return codes, lead[bounds[1:]] - lead[bounds[:-1]]


def _padded(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max(initial=1))), -1, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes
    return out


def _with_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with the space mark that stands before every non-empty text."""
    sizes = np.diff(offsets)
    filled = sizes > 0
    return np.insert(data, offsets[:-1][filled], _SPACE), np.concatenate([[0], np.cumsum(sizes + filled)])


def encode_batch(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the bounds of each text."""
    data, offsets = _with_prefix(data, offsets)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    starts = _segments(data, offsets)
    ends = np.append(starts[1:], len(data))
    keys = _range_keys(data, starts, ends)
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    codes, sizes = _characters(data, starts[first], ends[first])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    pieces = np.zeros(len(first) + 1, np.int64)
    rows_of, ids_of = [], []
    at = 0
    while at < len(order):
        longest = int(sizes[order[at]])
        most = max(1, (1 << 20) // ((max(longest, 8) + vocabulary.longest) * 16))
        stop = min(len(order), at + most, int(np.searchsorted(sizes[order], max(longest * 5 // 4, longest + 1), "right")))
        part = order[at:stop]
        size = sizes[part]
        pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[part], size)
        rows, ids = _solve(vocabulary, _padded(codes[pick], size), size)
        rows_of.append(part[rows])
        ids_of.append(ids)
        at = stop
    rows, ids = np.concatenate(rows_of), np.concatenate(ids_of)
    turn = np.argsort(rows, kind="stable")
    ids = ids[turn]
    np.add.at(pieces, rows + 1, 1)
    pieces = np.cumsum(pieces)
    count = np.diff(pieces)[inverse]
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(total[-1]) - np.repeat(total[:-1] - pieces[inverse], count)
    return ids[at], total[np.searchsorted(starts, offsets)]


def _range_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges follow one another."""
    keys = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 18):
        s, e = starts[a : a + (1 << 18)], ends[a : a + (1 << 18)]
        part = data[s[0] : e[-1]].astype(np.uint64) + np.uint64(1)
        power, inverse = B._power_tables(len(part) + 1)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)])])
        keys[a : a + (1 << 18)] = B.mix((running[e - s[0]] - running[s - s[0]]) * inverse[s - s[0]] + (e - s).astype(np.uint64))
    return keys


def decode_batch(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decoded texts and their offsets; the space mark before a text is taken away."""
    size = vocabulary.byte_bounds[ids + 1] - vocabulary.byte_bounds[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    data = vocabulary.byte_pool[np.arange(total[-1]) - np.repeat(total[:-1] - vocabulary.byte_bounds[ids], size)]
    offsets = total[bounds]
    lead = offsets[:-1][np.diff(offsets) > 0]
    lead = lead[data[lead] == _SPACE]
    gone = np.zeros(len(data) + 1, np.int64)
    gone[lead + 1] = 1
    return np.delete(data, lead), offsets - np.cumsum(gone)[offsets]


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoder(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _load(name)
        for batch in batches:
            for a, b in B.row_slices(batch["text"], B.SLICE_BYTES):
                ids, bounds = encode_batch(vocabulary, *B.flat(batch["text"].slice(a, b - a)))
                kept = [batch[c].slice(a, b - a) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, _lists(ids, bounds)], names=[*(c for c in batch.schema.names if c != "text"), "ids"])

    return run


def _chunk_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.encode("utf-32-le", "surrogatepass") for t in batch["text"].to_pylist()]
    sizes = np.array([len(t) // 4 for t in texts])
    return _padded(np.frombuffer(b"".join(texts), np.int32), sizes), np.minimum(sizes, batch["size"].to_numpy())


def _transfers(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _load(name)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                matrices = transfer(vocabulary, *_chunk_codes(part))
                yield pa.RecordBatch.from_arrays([part["key"], part["chunk"], pa.array([m.tobytes() for m in matrices], pa.binary())], names=["key", "chunk", "matrix"])

    return run


def _states_of_text(chunks: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values("chunk")
    side = int(round((len(chunks["matrix"].iloc[0]) / 8) ** 0.5))
    states = border_states(np.stack([np.frombuffer(m, float).reshape(side, side) for m in chunks["matrix"]]))
    return pd.DataFrame({"key": chunks["key"], "chunk": chunks["chunk"], "entry": states[:-1], "leave": states[1:]})


def _tracer(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _load(name)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                codes, sizes = _chunk_codes(part)
                entry, leave = part["entry"].to_numpy(), part["leave"].to_numpy()
                score, ids = vocabulary.matches(codes)
                out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(codes)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    start = np.full((len(rows), 1, vocabulary.longest), NONE)
                    start[np.arange(len(rows)), 0, entry[rows]] = 0
                    lengths = np.zeros((codes.shape[1] + 2 * vocabulary.longest, len(rows)), np.int64)
                    _forward(score[:, rows], start, int(size), lengths)
                    r, place, piece = _trace(lengths, ids[:, rows], entry[rows], size + leave[rows])
                    r, piece = _with_bytes(vocabulary, r, piece, codes[rows[r], place])
                    for k, found in enumerate(np.split(piece, np.searchsorted(r, np.arange(1, len(rows))))):
                        out[rows[k]] = found
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])])
                yield pa.RecordBatch.from_arrays([part["key"], part["chunk"], _lists(np.concatenate(out), bounds)], names=["key", "chunk", "part_ids"])

    return run


def _giants(texts: DataFrame, name: str, longest: int, chunk: int) -> DataFrame:
    """(key, ids) of each distinct giant text; ``texts`` has key and text with the space mark before it."""
    size = F.length("text")
    starts = F.explode(F.sequence(F.lit(0), F.ceil(size / chunk).cast("int") - 1)).alias("chunk")
    own = F.least(F.lit(chunk), F.col("total") - F.col("chunk") * chunk).cast("bigint")
    chunks = (
        texts.select("key", "text", size.alias("total"), starts)
        .select("key", "chunk", own.alias("size"), F.col("text").substr(F.col("chunk") * chunk + 1, F.lit(chunk + longest - 1)).alias("text"))
        .repartition("key", "chunk")
    )
    matrices = chunks.mapInArrow(_transfers(name), "key bigint, chunk int, matrix binary")
    states = matrices.groupBy("key").applyInPandas(_states_of_text, "key bigint, chunk int, entry bigint, leave bigint")
    parts = chunks.join(states, ["key", "chunk"]).mapInArrow(_tracer(name), "key bigint, chunk int, part_ids array<int>")
    rows = F.sort_array(F.collect_list(F.struct("chunk", "part_ids")))
    return parts.groupBy("key").agg(F.flatten(rows.getField("part_ids")).alias("ids"))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, giant: int = GIANT, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, ids for every row of ``docs`` (doc_id and text; others are ignored), with ``extra`` bigint columns.

    Null and empty texts have no ids.  Rows that repeat a giant text share its encoding.  White space is kept as it
    is; characters outside the vocabulary become their bytes, and so does U+2581, which is the mark of a space only
    within pieces.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    name = ship_model(spark, model)
    with open(model, "rb") as f:
        longest = Vocabulary(f.read()).longest
    extra = extra or {}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col("text").cast("string").alias("text"))
    large = F.coalesce(F.length("text") > giant, F.lit(False))
    kept = ["doc_id", *extra]
    small = texts.where(~large).mapInArrow(_encoder(name), ", ".join(f"{c} bigint" for c in kept) + ", ids array<int>")
    marked = texts.where(large).select(*kept, F.xxhash64("text").alias("key"), F.concat(F.lit(" "), "text").alias("text"))
    solved = _giants(marked.select("key", "text").dropDuplicates(["key"]), name, longest, chunk)
    return small.unionByName(marked.select(*kept, "key").join(solved, "key").select(*kept, "ids"))


def _id_slices(lists: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` ids together; a longer list comes alone."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1, [len(sizes)]])
    yield from ((int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def _decoder(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _load(name)
        for batch in batches:
            for a, b in _id_slices(batch["ids"]):
                part = batch.slice(a, b - a)
                lists = part["ids"].fill_null([]) if part["ids"].null_count else part["ids"]
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                data, offsets = decode_batch(vocabulary, flat, bounds)
                raw = data.tobytes()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(offsets[:-1], offsets[1:])]
                names = [c for c in part.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), part["ids"], pa.array(texts, pa.string())], names=[*names, "ids", "decoded"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``; null or no ids give the empty text."""
    name = ship_model(encoded.sparkSession, model)
    kept = ", ".join(f"{c} {kind}" for c, kind in encoded.dtypes if c not in ("ids", "decoded"))
    return encoded.select(*(c for c in encoded.columns if c not in ("ids", "decoded")), "ids").mapInArrow(_decoder(name), f"{kept}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, same for every row: whether the decoded ids are the text, by a hash taken before encoding.

    Null texts count as empty.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    encoded = encode(texts, model, extra={"mark": F.xxhash64("text")})
    return decode(encoded, model).select("doc_id", "ids", (F.xxhash64("decoded") == F.col("mark")).alias("same"))
