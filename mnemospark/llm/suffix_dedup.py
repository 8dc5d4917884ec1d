"""Removal of long byte strings that occur more than once, by suffix arrays.

Strings of WIDTH bytes are dealt to shards by content: the string's smallest hash of GRAM bytes (its
anchor) decides.  Equal strings have equal anchors at equal places, so only strings of one anchor
need comparing, and a text's neighbouring strings of one anchor form one segment.  Segments whose
anchor occurs once are done; so are segments of which all with that anchor are equal.  What is left
goes, once per distinct segment, to shards: each builds suffix arrays of its anchors, some of them at a time
(Larsson-Sadakane: order by seven bytes, then doubling depths, only unsettled groups again; a suffix ends
with its segment), common prefixes (Kasai, many segments side by side, a word of eight bytes at a step) and
marks strings whose neighbour in the order shares WIDTH bytes.

An anchor with very many distinct segments is split over several shards.  Their strings are merged
afterwards: fingerprints of the strings are dealt by range, each shard's sorted run is looked up in
the others' by binary search, two runs at a time, and strings found in two runs are marked.

Defined results: null texts are empty; texts shorter than WIDTH lose nothing; strings may overlap and
repeat in one document; rows that repeat an id are documents of their own, told apart by id and text
(equal rows are copies of each other); rows with a null id count as all others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import MIX, column, mix64, pieces, written

WIDTH = 200
GRAM = 32
#: Window starts of a text hashed at once, and bytes of texts (or one such stretch more) in a block; a position in
#: the block fits the low bits of a key.
CHUNK = 1 << 21
BLOCK_BYTES = 1 << 16
PLACE_BITS = 22
#: Bytes of the segments of one shard, and distinct segments of one anchor in one shard.
SHARD_BYTES = 2 << 20
ANCHOR_SEGMENTS = 2000
#: Bytes of one suffix array, if no anchor has more: small enough for a core's cache.
PART_BYTES = 1 << 18
#: Bytes by which suffixes are ordered first: with their number, they fill 64 bits.
HEAD = 7
#: Bits of a position of which three fit one sorted integer.
PACKED = 21
#: Strings that one task merges.
RANGE_STRINGS = 200_000
NO_ID = -(2**63)
BYTE_HASHES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(MIX[1]))


def doubled(codes: np.ndarray, times: int, factor: int) -> np.ndarray:
    """Hashes of 2 ** times neighbours."""
    step, f = 1, factor
    for _ in range(times):
        with np.errstate(over="ignore"):
            codes = codes[:-step] * np.uint64(f) + codes[step:]
        f = f * f & (2**64 - 1)
        step *= 2
    return codes


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours."""
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts, of which the offsets cut one text each; offsets); a null text is empty."""
    held = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = held.buffers()
    offsets = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def stretches(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first byte, bytes) of stretches of texts, in blocks of about BLOCK_BYTES: texts that hold a
    string, those of more than CHUNK window starts in several stretches."""
    windows = np.maximum(sizes - (WIDTH - 1), 0)
    parts = -(-windows // CHUNK)
    text = np.repeat(np.arange(len(sizes)), parts)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
    length = np.minimum(windows[text] - begin, CHUNK) + (WIDTH - 1)
    block = np.cumsum(length) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(text)]
    for first, end in zip(cuts, cuts[1:]):
        if end > first:
            yield text[first:end], begin[first:end], length[first:end]


def segments(block: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of window starts, stretch) of each run of windows with one
    anchor in a block of stretches of the lengths."""
    place = np.uint64((1 << PLACE_BITS) - 1)
    hashes = mix64(doubled(BYTE_HASHES[block], GRAM.bit_length() - 1, MIX[0]))
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    windows = lengths - (WIDTH - 1)
    _, at = owned(windows)
    owner = (least(keys, WIDTH - GRAM + 1)[at] & place).astype(np.int64)
    new = np.r_[True, owner[1:] != owner[:-1]]
    border = np.cumsum(windows) - windows
    new[border] = True
    first = np.flatnonzero(new)
    stretch = np.searchsorted(border, first, "right") - 1
    return hashes[owner[first]].view(np.int64), at[first], np.diff(np.r_[first, len(at)]), stretch


def segment_rows(df: DataFrame) -> DataFrame:
    """(anchor, seg, d, t, a, n): runs of windows of each text; d, t name the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = joined(column(batch, "text"))
            d, t = (column(batch, x).to_numpy(zero_copy_only=False) for x in ("d", "t"))
            for text, begin, lengths in stretches(np.diff(offsets)):
                start = offsets[text] + begin
                block = np.concatenate([data[i:j] for i, j in zip(start.tolist(), (start + lengths).tolist())])
                anchors, at, counts, stretch = segments(block, lengths)
                view = memoryview(block)
                seg = b"".join([xxhash.xxh3_64_digest(view[i:j]) for i, j in zip(at.tolist(), (at + counts + (WIDTH - 1)).tolist())])
                row = text[stretch]
                a = begin[stretch] + at - (np.cumsum(lengths) - lengths)[stretch]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchors, np.frombuffer(seg, ">i8").astype(np.int64), d[row], t[row], a, counts.astype(np.int32))],
                    ["anchor", "seg", "d", "t", "a", "n"],
                )

    return df.select("d", "t", "text").mapInArrow(run, "anchor long, seg long, d long, t long, a long, n int")


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer, the first byte lowest; zeros follow the data, for WIDTH places."""
    one = np.r_[data, np.zeros(7 + WIDTH, np.uint8)].astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def suffix_array(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The positions in the order of their suffixes: HEAD bytes first, then twice the depth each round.

    A suffix ends with its segment, left bytes on; of suffixes that are prefixes of each other the
    shorter one comes first, of equal ones that of the lower position.  So a suffix is settled once
    the depth covers what is left of it, and one that still ties goes on beyond the depth.
    """
    n = len(left)
    width = n.bit_length()
    bits, low = np.uint64(width), np.uint64((1 << width) - 1)
    key = words[:n].byteswap() >> np.uint64(8) << np.uint64(8)
    short = np.flatnonzero(left < HEAD)
    cut = ((HEAD + 1 - left[short]) * 8).astype(np.uint64)
    key[short] = key[short] >> cut << cut
    key |= np.minimum(left, HEAD + 1).astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ended = np.flatnonzero((ranked & np.uint64(255)) <= np.uint64(HEAD))
    order[ended] = (np.sort(first[ended].astype(np.uint64) << bits | order[ended].astype(np.uint64)) & low).view(np.int64)
    new[ended], first[ended] = True, ended
    rank = np.empty(n, np.int64)
    rank[order] = first
    at = np.flatnonzero(~(new & np.r_[new[1:], True]))
    depth = HEAD
    while len(at):
        position = order[at]
        key = (rank[position] << width | rank[position + depth]).view(np.uint64)
        if width <= PACKED:
            key = np.sort(key << bits | position.view(np.uint64))
            position = (key & low).view(np.int64)
            key >>= bits
        else:
            inner = np.argsort(key)
            position, key = position[inner], key[inner]
        order[at] = position
        differs = np.r_[True, key[1:] != key[:-1]]
        rank[position] = np.maximum.accumulate(np.where(differs, at, 0))
        at = at[~(differs & np.r_[differs[1:], True])]
        depth *= 2
    return order


def equal_bytes(apart: np.ndarray) -> np.ndarray:
    """Of the eight bytes of two words, as their difference in bits (not 0), the equal ones before the first other one."""
    lowest = (apart & (~apart + np.uint64(1))).astype(np.float64).view(np.int64) >> 52  # a power of two: its exponent
    return (lowest - 1023) >> 3


def common_prefixes(words: np.ndarray, order: np.ndarray, left: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """For each position, the bytes (at most width) that its suffix shares with the one before it in the order.

    Positions are visited from left to right, and a prefix shrinks by one byte at most from one to
    the next; the segments are stretches that advance side by side.  One that goes on for a word of
    eight bytes is compared to the end at once.  Only the first counts positions of each segment are
    visited; the others, with less than width bytes left, have 0.
    """
    n = len(left)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    most = np.where(before < 0, 0, np.minimum(width, left[before]))
    shared = np.zeros(n, np.int64)
    by_count = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_count], counts[by_count]
    ahead = np.arange(8, width, 8)
    held = np.zeros(len(starts), np.int64)
    active = np.searchsorted(-counts, -np.arange(int(counts.max(initial=0))), "left")
    for j, lanes in enumerate(active.tolist()):
        i = starts[:lanes] + j
        room = most[i]
        k = np.minimum(np.maximum(held[:lanes] - 1, 0), room)
        going = np.flatnonzero(k < room)
        if len(going):
            kg = k[going]
            here = i[going] + kg
            there = before[i[going]] + kg
            apart = words[here] ^ words[there]
            k[going] += equal_bytes(apart)
            on = np.flatnonzero(apart == 0)
            if len(on):
                apart = words[here[on, None] + ahead] ^ words[there[on, None] + ahead]
                first = (apart != 0).argmax(1)
                apart = apart[np.arange(len(on)), first]
                k[going[on]] = kg[on] + np.where(apart == 0, width, ahead[first] + equal_bytes(apart))
            k = np.minimum(k, room)
        held[:lanes] = k
        shared[i] = k
    return shared


def owned(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each segment, position of each window start) in the segments' joined bytes."""
    lengths = counts + WIDTH - 1
    starts = np.cumsum(lengths) - lengths
    return starts, np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def marked(contents: list[bytes], counts: np.ndarray) -> np.ndarray:
    """For each window start of the segments, one after another: whether its WIDTH bytes occur at another start."""
    words = words8(np.frombuffer(b"".join(contents), np.uint8))
    lengths = counts + WIDTH - 1
    starts, own = owned(counts)
    left = np.repeat(starts + lengths, lengths) - np.arange(int(lengths.sum()))
    order = suffix_array(words, left)
    # Neighbours that share WIDTH bytes are equal strings; what is shorter is in the order, but no string.
    mine = order[left[order] >= WIDTH]
    linked = common_prefixes(words, order, left, starts, counts, WIDTH)[mine] >= WIDTH
    hit = np.zeros(len(left), bool)
    hit[mine] = linked | np.r_[linked[1:], False]
    return hit[own]


def parts_of(anchors: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of the rows, sorted by anchor: whole anchors, of about PART_BYTES or one anchor."""
    heads = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    before = (np.cumsum(lengths) - lengths)[heads] // PART_BYTES
    cuts = [*heads[np.r_[True, before[1:] != before[:-1]]].tolist(), len(anchors)]
    yield from zip(cuts, cuts[1:])


def runs(hit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last index within it) of each run of true values in a segment."""
    begin = np.cumsum(counts) - counts
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1]
    last[:-1] &= ~hit[1:]
    first[begin] = hit[begin]
    last[begin + counts - 1] = hit[begin + counts - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    segment = np.searchsorted(begin, first, "right") - 1
    return segment, first - begin[segment], last - begin[segment]


SPANS = "d long, t long, lo long, hi long"


def fingerprints(content: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the first n strings."""
    byte = np.frombuffer(content, np.uint8).astype(np.uint64)
    names = []
    for seed in MIX[:2]:
        one = mix64(byte + np.uint64(seed))
        h8, h64, h128 = (doubled(one, k, seed | 1) for k in (3, 6, 7))
        names.append(mix64(mix64(h128[:n]) * np.uint64(3) + mix64(h64[128 : 128 + n]) * np.uint64(5) + h8[192 : 192 + n]).view(np.int64))
    return names[0], names[1]


def sorted_run(parts: list[tuple[np.ndarray, ...]], ranges: int) -> Iterator[tuple[int, bytes]]:
    """The strings (x, y, d, t, start) of a shard as one sorted run, cut into the ranges."""
    x, y, d, t, s = (np.concatenate(v) for v in zip(*parts))
    place = x.view(np.uint64) % np.uint64(ranges)
    order = np.lexsort((y, x, place))
    cuts = np.searchsorted(place[order], np.arange(ranges + 1, dtype=np.uint64))
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield number, np.stack([v[order[a:b]] for v in (x, y, d, t, s)]).tobytes()


def shard_results(contents: DataFrame, ranges: int) -> DataFrame:
    """From each shard's suffix array: spans of repeated strings (body is null), and the sorted run
    of its distinct strings of split anchors, one row for each range."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.take(np.argsort(shard["anchor"].to_numpy(), kind="stable"))
        counts, d, t, a = (shard[x].to_numpy().astype(np.int64) for x in ("n", "d", "t", "a"))
        bodies = shard["content"].to_pylist()
        split = shard["split"].to_numpy()
        hit, strings = [], []
        for first, end in parts_of(shard["anchor"].to_numpy(), counts + WIDTH - 1):
            own = marked(bodies[first:end], counts[first:end])
            hit.append(own)
            rows = first + np.flatnonzero(split[first:end])
            if len(rows):
                n = counts[rows]
                begin, own_at = owned(n)
                x, y = fingerprints(b"".join([bodies[i] for i in rows]), int(begin[-1] + n[-1]))
                start = np.repeat(a[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                chosen = own[np.repeat(split[first:end], counts[first:end])]
                strings.append((x[own_at], y[own_at], np.repeat(d[rows], n), np.repeat(t[rows], n), start, chosen))
        row, low, high = runs(np.concatenate(hit), counts)
        found = [d[row], t[row], a[row] + low, a[row] + high + WIDTH]
        cut = []
        if strings:
            # A string that repeats in this shard is marked already: one stands for all.
            x, y, own = (np.concatenate([s[k] for s in strings]) for k in (0, 1, 5))
            again = np.lexsort((y, x))
            same = np.r_[False, (x[again][1:] == x[again][:-1]) & (y[again][1:] == y[again][:-1])]
            keep = np.ones(len(x), bool)
            keep[again[same & own[again]]] = False
            cut = list(sorted_run([tuple(np.concatenate([s[k] for s in strings])[keep] for k in range(5))], ranges))
        columns = [pa.concat_arrays([pa.array(values, pa.int64()), pa.nulls(len(cut), pa.int64())]) for values in found]
        blank = len(row)
        return pa.table(
            [
                *columns, pa.concat_arrays([pa.nulls(blank, pa.int64()), pa.array([c[0] for c in cut], pa.int64())]),
                pa.concat_arrays([pa.nulls(blank, pa.binary()), pa.array([c[1] for c in cut], pa.binary())]),
            ],
            names=["d", "t", "lo", "hi", "range", "body"],
        )

    return contents.groupBy("shard").applyInArrow(run, f"{SPANS}, range long, body binary")


def looked_up(x: np.ndarray, y: np.ndarray, in_x: np.ndarray, in_y: np.ndarray) -> np.ndarray:
    """Places of the pairs in a sorted run of distinct pairs, by binary search; -1 where missing."""
    if not len(in_x):
        return np.full(len(x), -1)
    low = np.minimum(np.searchsorted(in_x, x, "left"), len(in_x) - 1)
    place = np.where((in_x[low] == x) & (in_y[low] == y), low, -1)
    for i in np.flatnonzero((place < 0) & (in_x[low] == x)):  # two pairs with one x
        high = np.searchsorted(in_x, x[i], "right")
        same = np.flatnonzero(in_y[low[i] : high] == y[i])
        if len(same):
            place[i] = low[i] + same[0]
    return place


def merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(x, y, twice) of two sorted runs as one: a pair that is in both occurs twice."""
    if len(one[0]) < len(two[0]):
        one, two = two, one
    x, y, twice = one[0], one[1], one[2].copy()
    place = looked_up(two[0], two[1], x, y)
    twice[place[place >= 0]] = True
    new = place < 0
    at = np.searchsorted(x, two[0][new], "right")
    return np.insert(x, at, two[0][new]), np.insert(y, at, two[1][new]), np.insert(twice, at, two[2][new])


def merged_spans(sorted_runs: DataFrame) -> DataFrame:
    """(d, t, lo, hi) of strings that two shards of a split anchor share: the sorted runs of a range
    are merged two by two."""

    def run(part: pa.Table) -> pa.Table:
        every = [np.frombuffer(b, np.int64).reshape(5, -1) for b in part["body"].to_pylist()]
        level = [(one[0], one[1], np.zeros(one.shape[1], bool)) for one in every]
        while len(level) > 1:
            level = [merged(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        x, y, twice = level[0]
        whole = np.concatenate(every, axis=1)
        d, t, s = whole[2:, twice[looked_up(whole[0], whole[1], x, y)]]
        order = np.lexsort((s, t, d))
        d, t, s = d[order], t[order], s[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)]) if len(s) else np.empty(0, np.int64)
        last = np.r_[first[1:] - 1, len(s) - 1] if len(s) else first
        return pa.table([pa.array(v) for v in (d[first], t[first], s[first], s[last] + WIDTH)], names=["d", "t", "lo", "hi"])

    return sorted_runs.groupBy("range").applyInArrow(run, SPANS)


def repeated_spans(df: DataFrame) -> DataFrame:
    """(d, t, lo, hi): byte spans of df (d, t, text) covered by strings that occur elsewhere too; spans may overlap."""
    segs = written(segment_rows(df))
    per_anchor = segs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("c"), F.min("seg").alias("low"), F.max("seg").alias("high")
    ).where("c > 1").select("anchor", (F.col("low") == F.col("high")).alias("same"))
    held = written(segs.join(per_anchor, "anchor"))
    whole = F.col("a") + F.col("n") - 1 + WIDTH
    spans = held.where("same").select("d", "t", F.col("a").alias("lo"), whole.alias("hi"))

    mixed = held.where("not same")
    # Any one of equal segments stands for all; first takes the four columns from one row, and is hashed where
    # the least struct would be sorted.
    per_seg = written(
        mixed.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), *(F.first(x).alias(x) for x in ("d", "t", "a", "n")))
    )
    copies = per_seg.where("c > 1").select("anchor", "seg")
    spans = spans.union(mixed.join(copies, ["anchor", "seg"], "left_semi").select("d", "t", F.col("a").alias("lo"), whole.alias("hi")))

    total = per_seg.agg(F.sum(F.col("n") + WIDTH)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    split = (
        per_seg.groupBy("anchor").count().where(F.col("count") > ANCHOR_SEGMENTS)
        .select("anchor", F.ceil(F.col("count") / ANCHOR_SEGMENTS).cast("int").alias("parts"))
    )
    reps = (
        per_seg.join(split, "anchor", "left")
        .withColumn("split", F.col("parts").isNotNull())
        .withColumn("shard", F.pmod(F.xxhash64("anchor", F.when(F.col("split"), F.pmod("seg", F.col("parts"))).otherwise(F.lit(0))), F.lit(shards)))
        .select("d", "t", F.struct("shard", "anchor", "split", "a", "n").alias("r"))
    )
    listed = reps.groupBy("d", "t").agg(F.collect_list("r").alias("rs"))  # at most the segments of one text
    contents = written(segment_contents(df.join(listed, ["d", "t"])))
    ranges = max(1, math.ceil((contents.where("split").agg(F.sum("n")).first()[0] or 0) / RANGE_STRINGS))
    results = written(shard_results(contents, ranges))
    spans = spans.union(results.where("body is null").select("d", "t", "lo", "hi"))
    return spans.union(merged_spans(results.where("body is not null").select("range", "body")))


def segment_contents(df: DataFrame) -> DataFrame:
    """The bytes of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = joined(column(batch, "text"))
            listed = column(batch, "rs")
            row = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
            held = dict(zip([f.name for f in listed.type.value_type], listed.flatten().flatten()))
            start = offsets[row] + held["a"].to_numpy()
            end = start + held["n"].to_numpy() + (WIDTH - 1)
            whole = data.tobytes()
            content = pa.array([whole[i:j] for i, j in zip(start.tolist(), end.tolist())], pa.binary())
            d, t = (column(batch, x).take(pa.array(row)) for x in ("d", "t"))
            yield pa.RecordBatch.from_arrays(
                [held["shard"], held["anchor"], held["split"], d, t, held["a"], held["n"], content],
                ["shard", "anchor", "split", "d", "t", "a", "n", "content"],
            )

    return df.select("d", "t", "text", "rs").mapInArrow(
        run, "shard long, anchor long, split boolean, d long, t long, a long, n int, content binary"
    )


def named(df: DataFrame) -> DataFrame:
    """df with d and t, which name a row by its id and text."""
    return df.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        "t", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    )


def kept_parts(data: bytes, listed: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes that go, runs that go)."""
    parts, at, count, end = [], 0, 0, -1
    for lo, hi in sorted(listed):
        if lo > end:
            count += 1
            parts.append(data[at:lo])
        at = end = max(end, hi)
    parts.append(data[at:])
    kept = b"".join(parts)
    return kept, len(data) - len(kept), count


def with_spans(df: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of each row of df."""
    rows = named(df.select("doc_id", "text"))
    spans = repeated_spans(rows).distinct().groupBy("d", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return rows.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")


def deduplicated(df: DataFrame) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans): text without its repeated strings; broken characters become U+FFFD."""
    return _results(with_spans(df), "text string", lambda kept: kept.decode("utf-8", "replace"))


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of df."""
    return _results(with_spans(df), "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _results(df: DataFrame, last: str, of_kept) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, gone, counts, values = [], [], [], []
            spans = column(batch, "spans")
            lo, hi = (x.to_pylist() for x in spans.flatten().flatten())
            ends = np.cumsum(spans.value_lengths().fill_null(0).to_numpy()).tolist()
            for data, begin, end in zip(column(batch, "text").cast(pa.binary()).to_pylist(), [0, *ends], ends):
                data = data or b""
                kept, removed, n = kept_parts(data, list(zip(lo[begin:end], hi[begin:end]))) if end > begin else (data, 0, 0)
                sizes.append(len(data)), gone.append(removed), counts.append(n), values.append(of_kept(kept))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, counts)), pa.array(values, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]],
            )

    return df.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"
    )
