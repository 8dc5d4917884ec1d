"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles.  Sizes are cut into bands whose ends differ by
the threshold, so that two similar sets lie in one band or in neighbouring ones; a set signs for
its own band and the next.  In a band of sizes up to r, similar sets differ in at most
k = floor(2 r (1 - t) / (1 + t)) elements.  The domain of shingles is dealt into n > k parts and
every non-empty part is one enumerated subset: its content is a signature.  At most k parts can
differ, so a set with m non-empty parts shares m - k signatures with every similar set.

That number is used twice.  A pair is compared only if it shares as many signatures; and signatures
of large groups (common lines, large groups of copies) can be left aside: if q shared signatures
are sure and h of a set's are hot, q - h others are shared, so only sets with h >= q need hot groups.

Inside a hot group each set is compared with one member, the leader (the one with most hot
signatures, which is near the group's middle), and described by its difference to the leader's set.
A leader that is linked with one of more hot signatures leaves its members to that, and the last q - 1
hot signatures of a set are left aside, so that most sets are described once.
Two sets that are not both linked to the leader can be similar only if these differences overlap, by
a number that follows from their sizes; so a prefix of each difference (its elements that are rarest
in the group first) finds the remaining candidates.

Only components are asked for, so pairs within one are of no use.  The members that meet in an element of
their differences form groups again; in each that holds several components one member is compared with
those of other components, a few times over, with components worked out anew after each round.  What is
left is compared pair by pair, but only across components.  Families of near copies grow together in
the first rounds, so groups give a few comparisons for each member and pairs only where families stay apart.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are
their own component; a text with fewer words than a shingle is one shingle; repeated texts are
linked unless empty; rows with a null id get no component; rows that repeat an id count as
one document each and share that id's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import CACHE_WORDS, MIX, column, components, in_arrow, mix64, pieces, written

#: Members of a signature group up to which all its pairs are compared at once.
SMALL_GROUP = 12
#: A tag is a band times TAG, plus the signatures shared at least.
TAG = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, cut at the space and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], n: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; known: word hashes kept so far."""
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > CACHE_WORDS:
        known.clear()
    hashes = []
    for word in words:
        value = known.get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        hashes.append(value)
    codes = np.array(hashes, np.uint64)
    width = min(n, len(codes))
    rows = len(codes) - width + 1
    total = np.full(rows, width, np.uint64)
    for i in range(width):
        total = (total * np.uint64(MIX[0])) ^ codes[i : i + rows]
        total = total * np.uint64(MIX[1])
    return np.unique(mix64(total))


@lru_cache(maxsize=4096)
def band(size: int, threshold: float) -> tuple[int, int]:
    """(index, largest size) of the band that holds the size."""
    low, index = 1, 0
    while True:
        high = int(low / threshold + 1e-9)
        if size <= high:
            return index, high
        low, index = high + 1, index + 1


@lru_cache(maxsize=4096)
def scheme(size: int, threshold: float) -> list[tuple[int, int, int]]:
    """(band, differing elements k, parts n) for the size's own band and the next."""
    index, high = band(size, threshold)
    result = []
    for number, largest in ((index, high), (index + 1, int((high + 1) / threshold + 1e-9))):
        k = int(2 * largest * (1 - threshold) / (1 + threshold) + 1e-9)
        if k:
            result.append((number, k, k + 2 + k // 8))
    return result


def signatures(codes: np.ndarray, threshold: float) -> list[tuple[np.ndarray, int]]:
    """For each band of the set: its signatures, and a tag: the band, and how many of them a similar set shares at least."""
    found = []
    for number, k, n in scheme(len(codes), threshold):
        seed = np.uint64((number + 1) * MIX[2] & (2**64 - 1))
        part = (mix64(codes ^ seed) % np.uint64(n)).astype(np.uint16 if n < 65536 else np.uint32)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sums = np.add.reduceat(mix64(codes[order] * np.uint64(MIX[0])), starts)
        place = ranked[starts].astype(np.uint64) + seed
        signs = mix64(sums ^ mix64(place))
        shared = max(0, len(starts) - k)
        if not shared:  # so few parts have elements: then empty parts count among such sets
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), ranked[starts].astype(np.uint64))
            signs = np.r_[signs, mix64(mix64(empty + seed) * np.uint64(MIX[1]))]
        found.append((signs, number * TAG + shared))
    return found


def profiles(df: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): set size and a 128-bit name of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in pieces(batches):
            sizes, first, second = [], [], []
            for text in column(batch, "text").to_pylist():
                codes = shingle_set(words_of(text), n, known)
                name = xxhash.xxh3_128_intdigest(codes.tobytes())
                sizes.append(len(codes))
                first.append((name >> 64) - 2**63)
                second.append((name & (2**64 - 1)) - 2**63)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                ["doc_id", "n_shingles", "k1", "k2"],
            )

    return in_arrow(df, run, "doc_id long, n_shingles long, k1 long, k2 long")


def signature_rows(df: DataFrame, n: int, threshold: float) -> DataFrame:
    """(sig, doc_id, tag) of each document; copies within a batch sign once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in pieces(batches):
            signs, ids, tags = [], [], []
            seen: set[int] = set()
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                codes = shingle_set(words_of(text), n, known)
                if not len(codes) or doc_id is None:
                    continue
                name = xxhash.xxh3_128_intdigest(codes.tobytes())
                if name in seen:
                    continue
                seen.add(name)
                for values, tag in signatures(codes, threshold):
                    signs.append(values)
                    ids.append(np.full(len(values), doc_id, np.int64))
                    tags.append(np.full(len(values), tag, np.int32))
            if signs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ([s.view(np.int64) for s in signs], ids, tags)],
                    ["sig", "doc_id", "tag"],
                )

    return in_arrow(df.select("doc_id", "text"), run, "sig long, doc_id long, tag int")


def scan_groups(rows: DataFrame) -> DataFrame:
    """From rows sorted by signature: (a, b, ta, tb, sig).

    Groups of up to SMALL_GROUP members give their pairs with both tags (sig is null); larger ones
    give their members (b is null).  A task holds one small group and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig_held, held, hot = None, [], False  # the open group
        out: list[list] = [[], [], [], [], []]

        def put(*row) -> None:
            for value, column_ in zip(row, out):
                column_.append(value)

        def close() -> None:
            if not hot:
                for i, (b, tb) in enumerate(held):
                    for a, ta in held[:i]:
                        put(a, b, ta, tb, None)

        def full() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["a", "b", "ta", "tb", "sig"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            sig, doc, tag = (column(batch, x).to_numpy() for x in ("sig", "doc_id", "tag"))
            if not len(sig):
                continue
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            ends = np.r_[starts[1:], len(sig)]
            look = ends - starts > 1  # others are complete groups of one, but for the first and last
            look[[0, -1]] = True
            for start, end in zip(starts[look].tolist(), ends[look].tolist()):
                if sig[start] != sig_held:
                    close()
                    sig_held, held, hot = sig[start], [], False
                for d, t in zip(doc[start:end].tolist(), tag[start:end].tolist()):
                    if held and d == held[-1][0]:
                        continue
                    held.append((d, t))
                    if hot:
                        put(d, None, t, None, int(sig_held))
                        held = held[-1:]
                    elif len(held) > SMALL_GROUP:
                        hot = True
                        for h, w in held:
                            put(h, None, w, None, int(sig_held))
            if out[0]:
                yield full()
        close()
        if out[0]:
            yield full()

    return in_arrow(rows, run, "a long, b long, ta int, tb int, sig long")


def parity_sketch(codes: np.ndarray) -> np.ndarray:
    """Bits that are the parities of the elements that fall on them.

    Each element in which two sets differ turns one bit, so the sketches of two sets differ in no
    more bits than the sets do in elements.  Sizes are powers of two; halves may be folded.
    """
    bits = 64 << max(0, len(codes).bit_length() - 5)
    place = (codes % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def set_rows(df: DataFrame, n: int) -> DataFrame:
    """(id, codes, size, sketch): the whole set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in pieces(batches):
            sets = [shingle_set(words_of(t), n, known) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                    pa.array([len(x) for x in sets], pa.int32()), pa.array([parity_sketch(x) for x in sets], pa.list_(pa.int64())),
                ],
                ["id", "codes", "size", "sketch"],
            )

    return in_arrow(df.select("doc_id", "text"), run, "id long, codes array<long>, size int, sketch array<long>")


#: Bits of the filter for each id that it holds; a power of two.
FILTER_BITS = 32


def perhaps_among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose doc_id is in the table ids (doc_id), and a few others: one bit of a broadcast bitmap
    tells, so that no text is shuffled to find the few that are wanted."""
    slots = FILTER_BITS << max(0, ids.count().bit_length())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    at = ids.select(slot.alias("_s"))
    bits = at.groupBy(F.bitmap_bucket_number("_s").alias("_n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    place = F.col("_p").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = df.withColumn("_n", F.bitmap_bucket_number(slot)).withColumn("_p", F.bitmap_bit_position(slot))
    found = rows.join(F.broadcast(bits), "_n").where(F.getbit(byte, place % 8) == 1)
    return found.drop("_n", "_p", "_bits")


def sets_of(df: DataFrame, n: int, *pairs: DataFrame) -> DataFrame:
    """The sets of the documents in the pairs (a, b), as one table, with those of a few others."""
    wanted = reduce(DataFrame.union, (p.select(F.explode(F.array("a", "b")).alias("doc_id")) for p in pairs)).distinct()
    return written(set_rows(perhaps_among(df, written(wanted)), n).dropDuplicates(["id"]))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sets x and y."""
    left = sets.select(F.col("id").alias("a"), F.col("codes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("codes").alias("y"))
    return pairs.join(right, "b").join(left, "a")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches do not rule out a link."""
    left = sets.select(F.col("id").alias("a"), F.col("size").alias("sx"), F.col("sketch").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("sy"), F.col("sketch").alias("y"))

    def folded(of: str, other: str) -> F.Column:
        half = F.size(of) / 2
        halves = F.zip_with(F.slice(of, F.lit(1), half.cast("int")), F.slice(of, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(of) > F.size(other), halves).otherwise(F.col(of))

    # Sizes that allow a link are less than a factor of two apart from 60 percent on: one fold is enough.
    apart = F.zip_with(folded("x", "y"), folded("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(apart, F.lit(0), lambda total, c: total + F.coalesce(c, F.lit(0)).cast("int"))
    return (
        pairs.join(right, "b").join(left, "a")
        .where(100 * F.least("sx", "sy") >= percent * F.greatest("sx", "sy"))
        .where((100 + percent) * differ <= (100 - percent) * (F.col("sx") + F.col("sy")))
        .select("a", "b")
    )


def similar(percent: int, shared: str = "shared") -> F.Column:
    """100 * intersection >= percent * union."""
    return 100 * F.col(shared) >= percent * (F.size("x") + F.size("y") - F.col(shared))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; whole sets travel only for pairs that sketches leave."""
    left = written(possible(pairs, sets, percent))
    return with_sets(left, sets).withColumn("shared", F.size(F.array_intersect("x", "y"))).where(similar(percent)).select("a", "b")


#: Words of the sketch of a difference.
SKETCH = 4


def led(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For pairs of a leader a and a member b: whether they are linked, and the difference of their sets.

    For a set of size s, similar sets differ from it in at most s (1 - t) / t elements.  Of the
    difference, ``long`` elements are the prefix, and ``short`` ones the prefix that must meet the
    prefix of a member whose difference is as large or larger.  k0, k1, ... are its parity sketch.
    """
    most = F.floor(F.size("y") * (100 - percent) / percent + 1e-9)
    size = F.col("size")
    sketch = (
        F.expr(
            f"aggregate(filter(apart, e -> (shiftright(e, 6) & {SKETCH - 1}L) = {k}L), 0L, (acc, e) -> acc ^ shiftleft(1L, int(e & 63L)))"
        ).alias(f"k{k}")
        for k in range(SKETCH)
    )
    return (
        with_sets(pairs, sets)
        .withColumn("apart", F.concat(F.array_except("y", "x"), F.array_except("x", "y")))
        .withColumn("size", F.size("apart"))
        .withColumn("shared", ((F.size("x") + F.size("y") - size) / 2).cast("int"))
        .select("a", "b", similar(percent).alias("linked"), "size", "apart", F.size("y").alias("s"),
                (size - F.greatest(F.lit(1), size - F.floor(most / 2)) + 1).cast("int").alias("short"),
                (size - F.greatest(F.lit(1), size - most) + 1).cast("int").alias("long"), *sketch)
    )


def least_hot(hot: DataFrame) -> DataFrame:
    """(sig, a, h): the hot signatures that each document has to be found by, with the number of its hot ones.

    A similar pair that shares no other signature shares q hot ones.  In one order of all signatures the first
    of these has q - 1 behind it in either document, so the last q - 1 of a document's are of no use; those
    of the largest groups come last.
    """
    sizes = hot.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    q = F.greatest(F.lit(1), F.pmod("ta", F.lit(TAG)))
    own = hot.select("sig", "a", "ta").join(sizes, "sig").groupBy("a", "ta").agg(F.array_sort(F.collect_set(F.struct("c", "sig"))).alias("own"))
    kept = own.withColumn("h", F.size("own")).withColumn("keep", F.col("h") - q + 1).where("keep > 0")
    return kept.select(F.explode(F.slice("own", F.lit(1), F.col("keep").cast("int"))).alias("m"), "a", "h").select("m.sig", "a", "h")


def starred(members: DataFrame) -> DataFrame:
    """(a, b): the leader of each signature's members (sig, a, h), and every other member."""
    leader = members.groupBy("sig").agg(F.max_by("a", F.struct("h", -F.col("a"))).alias("l"))
    return members.join(leader, "sig").where("a <> l").select(F.col("l").alias("a"), F.col("a").alias("b")).distinct()


def gathered_stars(members: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stars (a, b) with fewer leaders: one that is linked with a leader of more hot signatures gives its members to that.

    The differences of a group's members may be taken to any one set, if it is the same for all of them; so
    members that meet in many signatures are described once and not for the leader of each.
    """
    rank = members.groupBy("a").agg(F.max("h").alias("h"))
    heads = stars.select(F.col("a").alias("b")).distinct()
    near = verified(stars.join(heads, "b", "left_semi"), sets, percent)
    for name in "ab":
        near = near.join(rank.select(F.col("a").alias(name), F.struct("h", -F.col("a")).alias(f"r{name}")), name)
    up = written(near.where("ra > rb").groupBy("b").agg(F.max_by("a", "ra").alias("up")))
    stars = stars.union(heads.select("b", "b"))  # a leader is a member too
    for _ in range(2):
        stars = stars.join(up.select(F.col("b").alias("a"), "up"), "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
    return stars.where("a <> b").distinct()


#: Rounds in which one member of each group of differences is compared with other components.
STAR_ROUNDS = 2


def with_component(rows: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """The rows with the component of a node, as far as the links tell: its own id without any."""
    found = parts.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return rows.join(found, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def meeting_places(leaders: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, size, s, k0 ..., es): the members of groups that still hold other components than their leader's.

    A pair that matters has a member outside the leader's component, so only elements that such an outsider
    shares with another member can bring it together.  All others come first in the order of a difference
    and are only counted; es holds what is left of the first ``long`` elements, rarest in the group first, and
    whether each is among the first ``short`` ones.
    """
    placed = with_component(with_component(leaders, parts, "b", "c"), parts, "a", "ca").withColumn("outside", F.col("c") != F.col("ca"))
    active = placed.join(placed.where("outside").select("a").distinct(), "a", "left_semi")
    elements = active.select("a", "b", "outside", F.explode("apart").alias("e"))
    often = elements.groupBy("a", "e").agg(F.count(F.lit(1)).alias("c"), F.max("outside").alias("o")).where("c > 1 and o").drop("o")
    common = elements.select("a", "b", "e").join(often, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("es"))
    sketch = [f"k{k}" for k in range(SKETCH)]
    alone = F.col("size") - F.size("es")
    held = F.slice("es", F.lit(1), F.greatest(F.lit(0), F.col("long") - alone).cast("int"))
    return (
        active.drop("apart", "c").join(common, ["a", "b"])
        .withColumn("es", F.transform(held, lambda m, at: F.struct(m["e"].alias("e"), (at + alone < F.col("short")).alias("first"))))
        .where(F.size("es") > 0).select("a", "b", "size", "s", *sketch, "es")
    )


def meetings(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, e, b, size, s, k0 ..., c, first): a row for each member and element, with the member's component."""
    placed = with_component(members, parts, "b", "c")
    return placed.select("*", F.explode("es").alias("m")).select("*", "m.*").drop("m", "es")


def near(percent: int) -> F.Column:
    """Whether sizes and sketches of two members x and y of a group allow a link."""
    differ = sum((F.bit_count(F.col(f"x_k{k}").bitwiseXOR(F.col(f"y_k{k}"))) for k in range(SKETCH)), F.lit(0))
    allowed = (100 - percent) * (F.col("x_s") + F.col("y_s"))
    return ((100 + percent) * F.abs(F.col("y_size") - F.col("x_size")) <= allowed) & ((100 + percent) * differ <= allowed)


def member(name: str) -> list[F.Column]:
    return [F.col(c).alias(f"{name}_{c}") for c in ("b", "size", "s", *(f"k{k}" for k in range(SKETCH)), "c")]


def star_pairs(rows: DataFrame, percent: int, number: int) -> DataFrame:
    """In each group that holds several components: the pairs of one member with members of other components."""
    order = F.struct("size", "b") if number == 0 else F.struct(F.xxhash64("b", F.lit(number)), F.col("b"))
    centre = rows.groupBy("a", "e").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.min_by(F.struct(*member("x")), order).alias("x"))
    centre = centre.where("_low < _high").select("a", "e", "x.*")
    met = rows.select("a", "e", *member("y")).join(centre, ["a", "e"]).where("x_c <> y_c").where(near(percent))
    return met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()


def overlapping(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of members of one leader, of different components, whose differences can overlap enough."""
    x, y = rows.where("first").select("a", "e", *member("x")), rows.select("a", "e", *member("y"))
    return (
        x.join(y, ["a", "e"])
        .where("x_c <> y_c and (x_size < y_size or x_size = y_size and x_b < y_b)")
        .where(near(percent))
        .select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b"))
    )


def jaccard_components(df: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of df (doc_id, text, ...)."""
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(profiles(df, n))
    ids_of = base.where("n_shingles > 0 and doc_id is not null")
    copies = ids_of.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copy_of = written(ids_of.join(copies, ["k1", "k2"]).where("doc_id <> rep").select("doc_id", "rep").distinct())

    def to_reps(pairs: DataFrame, *names: str) -> DataFrame:
        """The ids replaced by the smallest id with the same set."""
        for name in names:
            other = copy_of.select(F.col("doc_id").alias(name), F.col("rep").alias("_rep"))
            pairs = pairs.join(other, name, "left").withColumn(name, F.coalesce("_rep", name)).drop("_rep")
        return pairs

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    rows = signature_rows(df, n, percent / 100).repartition("sig").sortWithinPartitions("sig", "doc_id")
    found = written(scan_groups(rows))

    hot = found.where("b is null")
    hot_of = written(hot.groupBy("a", "ta").agg(F.count(F.lit(1)).alias("h")))
    met = found.where("b is not null").groupBy("a", "b", "ta", "tb").agg(F.count(F.lit(1)).alias("c"))
    for name in "ab":
        other = hot_of.select(F.col("a").alias(name), F.col("ta").alias(f"t{name}"), F.col("h").alias(f"h{name}"))
        met = met.join(other, [name, f"t{name}"], "left")
    sure = [F.pmod(f"t{x}", F.lit(TAG)) - F.coalesce(f"h{x}", F.lit(0)) for x in "ab"]
    pairs = written(ordered(to_reps(met.where(F.col("c") >= F.greatest(*sure)).select("a", "b"), "a", "b")))

    members = written(to_reps(least_hot(hot), "a").groupBy("sig", "a").agg(F.max("h").alias("h")))
    stars = written(starred(members))
    sets = sets_of(df, n, pairs, stars)
    stars = written(gathered_stars(members, stars, sets, percent))
    leaders = written(led(stars.select("a", "b"), sets, percent))
    links = written(verified(pairs, sets, percent).union(leaders.where("linked").select("a", "b")).distinct())
    done = pairs.union(ordered(leaders.select("a", "b")))
    members = None
    for number in range(STAR_ROUNDS + 1):
        parts = written(components(links))
        members = members or written(meeting_places(leaders, parts))
        rows = meetings(members, parts)
        pairs = ordered(overlapping(rows, percent)) if number == STAR_ROUNDS else star_pairs(rows, percent, number)
        new = written(pairs.join(done, ["a", "b"], "left_anti"))
        found = written(verified(new, sets, percent))
        done, links = done.union(new), links.union(found)

    linked = components(links).withColumnRenamed("node", "rep")
    ids = base.join(copy_of.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left").drop("_d")
    ids = ids.withColumn("rep", F.coalesce("rep", "doc_id"))
    return ids.join(linked, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that are the smallest of their component: copies and near copies of them go.

    Rows that repeat an id stay together; rows with a null id stay.
    """
    found = jaccard_components(df, n, percent)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df["doc_id"] == gone["_gone"], "left_anti")
