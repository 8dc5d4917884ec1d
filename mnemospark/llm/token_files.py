"""Token ids as compressed binary files: an adaptive context-mixing range coder over independent blocks.

File format.  A data set is a Parquet table of segments in document order (part, seq); the body of
a segment is little-endian: magic ``TKS1``, the numbers of documents and blocks (uint32 each), then
each document's id (int64) and number of ids (uint64), then each block's number of ids, number of
16-bit code words and CRC-32 of its ids (as uint32) and code words (all uint32), then the blocks' code words.  Blocks
hold BLOCK ids (the last one fewer), start from an empty model, and can be decoded alone.

Coding an id: the last two ids predict one id each (order 2 and order 1, the id that last followed
them in the block, with a confidence).  A binary decision says whether order 2 is right; its
probability mixes both orders' estimates in the logistic domain with weights that are trained as
coding goes on.  If not, a second decision says whether order 1 is right.  If not, the upper eight
bits of the id are coded by an adaptive binary tree (order 0) and the lower bits directly.  All is
integer arithmetic, so that any machine decodes the same.  Many blocks are coded side by side in numpy.

Defined results: null texts are empty and hold the end id alone; ids must be below 65536; rows keep
their multiplicity; rows are ordered by id, rows without an id first, equal ids by text; a damaged
block raises an error.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import column, in_arrow, pieces

BLOCK = 4096
SLOT_BITS = 11
MAGIC = b"TKS1"
END_ID = 2
#: Blocks that are coded side by side.
LANES = 1024

_X = np.arange(4096)
#: ln(p / (1 - p)) in 1/256, and its inverse, for probabilities in 1/4096; rounded to integers.
STRETCH = np.round(256 * np.log((_X + 0.5) / (4095.5 - _X))).astype(np.int32)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 4064).astype(np.int32)


_P = np.concatenate([_X, _X])
#: A probability after a bit, at bit * 4096 + probability.
NEXT = np.clip(_P + (((np.repeat([0, 1], 4096) << 12) - _P) >> 4), 32, 4064).astype(np.int32)
#: The confidence in a guess (in bits 16 and up) after a wrong and after a right one.
TRUST = np.array([t >> 1 for t in range(16)] + [min(t + 1, 15) for t in range(16)], np.uint32) << 16


class Model:
    """The adaptive state of many blocks: a guess and the confidence in it lie in one number."""

    def __init__(self, lanes: int):
        n = np.arange(lanes)
        self.row, self.lane16, self.lane2 = n << SLOT_BITS, n << 4, n << 1
        self.state = [np.zeros(lanes << SLOT_BITS, np.uint32) for _ in range(2)]
        self.hit = [np.full(lanes * 16, 2048, np.int32) for _ in range(3)]
        self.weight = [np.full(lanes * 2, 1 << 15, np.int32) for _ in range(2)]
        self.tree = np.full(lanes * 256, 2048, np.int32)

    def look(self, n: int, before: np.ndarray, before2: np.ndarray) -> tuple:
        """Slots, states, guesses, cells of confidence and the mixed probability of order 2 for the first n blocks."""
        slots, row = (1 << SLOT_BITS) - 1, self.row[:n]
        at = [row + (((before2 * 31 + before) * 40503 >> 4) & slots), row + ((before * 40503 >> 3) & slots)]
        state = [self.state[k].take(at[k]) for k in range(2)]
        trust = [x >> 16 for x in state]
        guess = [x & 0xFFFF for x in state]
        same = guess[0] == guess[1]
        cell = [self.lane16[:n] + x for x in trust]
        chance = [self.hit[k].take(cell[k]) for k in range(2)]
        logit = [STRETCH.take(x) for x in chance]
        pick = self.lane2[:n] + same
        weight = [self.weight[k].take(pick) for k in range(2)]
        dot = (weight[0] * logit[0] + weight[1] * logit[1]) >> 16
        p = SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2047)
        return at, trust, guess, same, cell, (chance, logit, pick, weight, p)

    def learn_mix(self, cell: list, mix: tuple, hit: np.ndarray) -> None:
        chance, logit, pick, weight, p = mix
        bit = hit.astype(np.int32) << 12
        error = bit - p
        for k in range(2):
            self.weight[k][pick] = weight[k] + ((logit[k] * error) >> 9)
            self.hit[k][cell[k]] = NEXT.take(chance[k] + bit)

    def learn_ids(self, at: list, trust: list, guess: list, ids: np.ndarray) -> None:
        own = ids.astype(np.uint32)
        for k in range(2):
            self.state[k][at[k]] = TRUST.take(trust[k] + ((guess[k] == own).astype(np.uint32) << 4)) | own


class Writer:
    """Range coders of many blocks; carries are settled at the end."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, (1 << 32) - 1, np.int64)
        self.out, self.at = np.zeros((lanes, words), np.uint32), np.arange(lanes) * words

    def _emit(self, low: np.ndarray, width: np.ndarray, lane: np.ndarray | None) -> None:
        small = np.flatnonzero(width < 1 << 16)
        if len(small):
            own, value = small if lane is None else lane[small], low[small]
            at = self.at[own]
            self.out.reshape(-1)[at] = value >> 16
            self.at[own] = at + 1
            low[small] = (value & 0xFFFF) << 16
            width[small] <<= 16

    def bits(self, lane: np.ndarray | None, n: int, bits: list[np.ndarray], chances: list[np.ndarray], last: np.ndarray | None = None) -> None:
        """A few decisions one after another, and eight plain bits, for some lanes (None: the first n)."""
        low, width = (self.low[:n], self.range[:n]) if lane is None else (self.low[lane], self.range[lane])
        for bit, p in zip(bits, chances):
            bound = (width >> 12) * p
            low += np.where(bit, 0, bound)
            width[:] = np.where(bit, bound, width - bound)
            self._emit(low, width, lane)
        if last is not None:
            width >>= 8
            low += width * last
            self._emit(low, width, lane)
        if lane is not None:
            self.low[lane], self.range[lane] = low, width

    def words(self) -> list[np.ndarray]:
        for _ in range(2):
            self.out.reshape(-1)[self.at] = self.low >> 16
            self.at += 1
            self.low = (self.low & 0xFFFF) << 16
        for i in range(self.out.shape[1] - 1, 0, -1):
            self.out[:, i - 1] += self.out[:, i] >> 16
        sizes = self.at - np.arange(len(self.at)) * self.out.shape[1]
        return [(row[:n] & 0xFFFF).astype("<u2") for row, n in zip(self.out, sizes)]


class Reader:
    """The same coders, reading."""

    def __init__(self, words: list[np.ndarray]):
        most = max(map(len, words)) + 4
        self.words = np.zeros((len(words), most), np.uint16)
        for row, w in zip(self.words, words):
            row[: len(w)] = w
        first = np.arange(len(words)) * most
        self.code = (self.words[:, 0].astype(np.int64) << 16) | self.words[:, 1]
        self.at, self.last = first + 2, first + most - 1
        self.range = np.full(len(words), (1 << 32) - 1, np.int64)

    def open(self, lane: np.ndarray | None, n: int) -> None:
        """The next decisions are those of some lanes (None: the first n)."""
        self.lane = lane
        self.own = (self.code[:n], self.range[:n]) if lane is None else (self.code[lane], self.range[lane])

    def close(self) -> None:
        if self.lane is not None:
            self.code[self.lane], self.range[self.lane] = self.own

    def _take(self) -> None:
        code, width = self.own
        small = np.flatnonzero(width < 1 << 16)
        if len(small):
            own = small if self.lane is None else self.lane[small]
            at = self.at[own]
            code[small] = (code[small] << 16) | self.words.reshape(-1)[at]
            self.at[own] = np.minimum(at + 1, self.last[own])
            width[small] <<= 16

    def bit(self, p: np.ndarray) -> np.ndarray:
        code, width = self.own
        bound = (width >> 12) * p
        one = code < bound
        code -= np.where(one, 0, bound)
        width[:] = np.where(one, bound, width - bound)
        self._take()
        return one

    def plain(self) -> np.ndarray:
        code, width = self.own
        width >>= 8
        value = np.minimum(code // width, 255)
        code -= value * width
        self._take()
        return value


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(position, blocks that have it); blocks are in order of falling size."""
    for t in range(int(sizes[0]) if len(sizes) else 0):
        yield t, int(np.searchsorted(-sizes, -t, "left"))


def _side_by_side(sizes: list[int]) -> Iterator[list[int]]:
    """The blocks in order of falling size, in groups of about equal numbers up to LANES."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for some in np.array_split(order, -(-len(order) // LANES) or 1):
        if len(some):
            yield some.tolist()


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The code words of each block."""
    out: list = [None] * len(blocks)
    for some in _side_by_side([len(b) for b in blocks]):
        sizes = np.array([len(blocks[i]) for i in some])
        rows = np.zeros((len(some), int(sizes.max(initial=0))), np.int64)
        for lane, i in enumerate(some):
            rows[lane, : sizes[lane]] = blocks[i]
        ids = np.ascontiguousarray(rows.T)
        model, writer = Model(len(some)), Writer(len(some), 2 * int(sizes.max(initial=0)) + 8)
        before = before2 = np.zeros(len(some), np.int64)
        for t, n in _steps(sizes):
            own = ids[t, :n]
            at, trust, guess, same, cell, mix = model.look(n, before[:n], before2[:n])
            hit = guess[0] == own
            writer.bits(None, n, [hit], [mix[-1]])
            model.learn_mix(cell, mix, hit)
            left = ~hit
            rest = np.flatnonzero(left & ~same)
            if len(rest):
                spot = cell[1][rest]
                again = guess[1][rest] == own[rest]
                chance = model.hit[2].take(spot)
                writer.bits(rest, n, [again], [chance])
                model.hit[2][spot] = NEXT.take(chance + (again.astype(np.int32) << 12))
                left[rest[again]] = False
            rest = np.flatnonzero(left)
            if len(rest):
                value = own[rest]
                nodes = ((value >> 8) | 256) >> DEPTHS  # a row for each decision: the node, and which way it goes
                spots, ways = nodes + (rest << 8), ((value >> 8) >> (DEPTHS - 1)) & 1
                chances = model.tree.take(spots)
                writer.bits(rest, n, list(ways), list(chances), value & 255)
                model.tree[spots] = NEXT.take(chances + (ways << 12))
            model.learn_ids(at, trust, guess, own)
            before, before2 = own, before
        for i, words in zip(some, writer.words()):
            out[i] = words
    return out


#: Levels that are left below each node of the tree's paths.
DEPTHS = np.arange(8, 0, -1)[:, None]


def decode(words: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    out: list = [None] * len(words)
    for some in _side_by_side(sizes):
        counts = np.array([sizes[i] for i in some])
        ids = np.zeros((int(counts.max(initial=0)), len(some)), np.int64)
        model, reader = Model(len(some)), Reader([words[i] for i in some])
        before = before2 = np.zeros(len(some), np.int64)
        for t, n in _steps(counts):
            at, trust, guess, same, cell, mix = model.look(n, before[:n], before2[:n])
            reader.open(None, n)
            hit = reader.bit(mix[-1])
            model.learn_mix(cell, mix, hit)
            own = guess[0].astype(np.int64)
            left = ~hit
            rest = np.flatnonzero(left & ~same)
            if len(rest):
                spot = cell[1][rest]
                chance = model.hit[2].take(spot)
                reader.open(rest, n)
                again = reader.bit(chance)
                reader.close()
                model.hit[2][spot] = NEXT.take(chance + (again.astype(np.int32) << 12))
                right = rest[again]
                own[right] = guess[1][right]
                left[right] = False
            rest = np.flatnonzero(left)
            if len(rest):
                node, first = np.ones(len(rest), np.int64), rest << 8
                reader.open(rest, n)
                for _ in range(8):
                    spot = first + node
                    chance = model.tree.take(spot)
                    bit = reader.bit(chance).astype(np.int64)
                    model.tree[spot] = NEXT.take(chance + (bit << 12))
                    node = node * 2 + bit
                own[rest] = ((node & 255) << 8) | reader.plain()
                reader.close()
            model.learn_ids(at, trust, guess, own)
            ids[t, :n] = own
            before, before2 = own, before
        for lane, i in enumerate(some):
            out[i] = ids[: counts[lane], lane]
    return out


def packed(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The body of a segment."""
    ids = np.concatenate(documents) if documents else np.empty(0, np.int64)
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    words = encode(blocks)
    parts = [MAGIC, struct.pack("<II", len(documents), len(blocks))]
    parts += [struct.pack("<qQ", -(2**63) if d is None else d, len(x)) for d, x in zip(doc_ids, documents)]
    parts += [struct.pack("<III", len(b), len(w), _checksum(b, w)) for b, w in zip(blocks, words)]
    return b"".join([*parts, *(w.tobytes() for w in words)])


def _checksum(ids: np.ndarray, words: np.ndarray) -> int:
    return zlib.crc32(words.astype("<u2").tobytes(), zlib.crc32(ids.astype("<u4").tobytes()))


def unpacked(body: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The document ids and token ids of a segment; a ValueError if a block is damaged."""
    if body[:4] != MAGIC:
        raise ValueError("no token segment")
    n_docs, n_blocks = struct.unpack_from("<II", body, 4)
    docs = [struct.unpack_from("<qQ", body, 12 + 16 * i) for i in range(n_docs)]
    at = 12 + 16 * n_docs
    heads = [struct.unpack_from("<III", body, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    words = []
    for _, n, _ in heads:
        words.append(np.frombuffer(body, "<u2", n, at).astype(np.int64))
        at += 2 * n
    blocks = decode(words, [h[0] for h in heads])
    for number, (block, head, code) in enumerate(zip(blocks, heads, words)):
        if _checksum(block, code) != head[2]:
            raise ValueError(f"block {number} is damaged")
    ids = np.concatenate(blocks) if blocks else np.empty(0, np.int64)
    cuts = np.cumsum([n for _, n in docs])
    return [None if d == -(2**63) else d for d, _ in docs], np.split(ids, cuts[:-1]) if docs else []


class Tokens:
    """Ids of texts by a tokenizer of the tokenizers library that never joins across blanks or line
    ends: each different stretch between them is encoded once a batch."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.encode = Tokenizer.from_file(path).encode_batch_fast

    def of(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        known = parts.flatten().dictionary_encode()
        words = known.dictionary.to_pylist()
        found, sizes = [], np.empty(len(words), np.int64)
        for i in range(0, len(words), 10_000):
            for j, code in enumerate(self.encode(words[i : i + 10_000], add_special_tokens=False), i):
                ids = code.ids
                sizes[j] = len(ids)
                found += ids
        pool = np.array([*found, end], np.int64)
        first = np.cumsum(sizes) - sizes
        # The end id is one more word after the last one of each text.
        ends = (parts.offsets.to_numpy() - parts.offsets[0].as_py())[1:]
        word = np.insert(known.indices.to_numpy().astype(np.int64), ends, len(words))
        first, sizes = np.r_[first, len(found)][word], np.r_[sizes, 1][word]
        last = np.cumsum(sizes)
        ids = pool[np.repeat(first - last + sizes, sizes) + np.arange(last[-1] if len(last) else 0)]
        return np.split(ids, last[ends + np.arange(len(ends))][:-1]) if len(ends) else []


def write_tokens(df: DataFrame, path: str, tokenizer: str, end: int = END_ID) -> None:
    """Writes the token files of df (doc_id, text) in ascending order of doc_id to a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq = Tokens(tokenizer), TaskContext.get().partitionId(), 0
        for batch in gathered(pieces(batches)):
            documents = tokens.of(column(batch, "text"), end)
            body = packed(column(batch, "doc_id").to_pylist(), documents)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([sum(map(len, documents))], pa.int64()), pa.array([body], pa.binary())],
                ["part", "seq", "n_tokens", "body"],
            )
            seq += 1

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_arrow(ordered, run, "part long, seq long, n_tokens long, body binary").write.parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches joined while their texts stay below a size, so that many blocks are coded side by side."""
    held, total = [], 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read_tokens(spark, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in token files, or ids_crc32 instead of ids."""
    files = spark.read.parquet(path)
    narrow = files.select("part", "seq", "n_tokens")
    parts = narrow.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("before")).alias("first"))
    last, kind = ("ids_crc32", "long") if digests else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body in zip(column(batch, "first").to_pylist(), column(batch, "body")):
                doc_ids, documents = unpacked(body.as_py())
                sizes = np.array([len(d) for d in documents], np.int64)
                if digests:
                    values = pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64())
                else:
                    values = pa.array([d.astype(np.int32) for d in documents], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes), values],
                    ["doc_id", "start", "n_tokens", last],
                )

    return in_arrow(
        files.select("part", "seq", "body").join(starts, ["part", "seq"]), run, f"doc_id long, start long, n_tokens long, {last} {kind}"
    )
