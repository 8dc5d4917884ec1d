"""Language-model scores of texts by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each of the 255 decisions has a context tree of its own, whose
nodes are the last 0 to DEPTH bytes.  A node estimates its decision by Krichevsky-Trofimov counts and
mixes with its children: Pw = (KT + product of the children's Pw) / 2, at the deepest nodes Pw = KT.
Block probabilities depend on counts alone, so the trees of a whole corpus come from counts of byte
strings (context and byte), however they are summed; the weights that the training texts leave on the
depths then mix the predictions of a path, and a text's code length is the sum over its bytes.

Distribution: texts are dealt into groups of about GROUP_BYTES.  A group counts its own distinct
strings and words once, so what is shuffled are the distinct strings of groups, not positions of texts.
Counts are summed by string.  Subtrees below the last TOP bytes are worked out bucket by bucket, the
few nodes above them by decision from the subtrees' totals, and every string gets its predicted
logarithm; a group then gets back the values of its own strings and adds them up for its texts.  No
table of the corpus is broadcast or sent to the driver.

Texts are bytes with A-Z lower-cased; an end mark (a byte that UTF-8 does not have) closes each text
and also stands before it, so probabilities of all texts add up to one at most.  Word counts of the base model
take the same way.  Words are known by 64-bit hashes.

Defined results: null and empty texts are one end mark (and one token); rows with a null id are
never held out and learn; rows that repeat an id are scored row by row; without training texts all
strings have probability 1/2 per decision; an empty table gives no row.  Only doc_id and text are read.  The
table must give the same partitions when it is read twice, as stored tables do.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import MIX, mix64, written

#: Bytes of context, and how many of them the subtrees of a bucket share.
DEPTH, TOP = 5, 3
MARK = 0xFF
GROUP_BYTES = 20 << 20
#: Bytes of text that are taken apart at once.
PIECE = 1 << 19
STRING, WORD = 0, 1
#: The key of a text's end among the words.
END = 0
LN2 = math.log(2)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: One odd number for each byte, for hashes of words.
CODES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def segments(text: bytes, depth: int) -> Iterator[tuple[bytes, bytes, bool]]:
    """(context, part, whether it is the last): parts of about PIECE bytes, cut behind blanks."""
    start, context = 0, bytes([MARK]) * depth
    while True:
        end = start + PIECE
        while end < len(text) and not BLANK[text[end - 1]]:
            end += 1
        last = end >= len(text)
        yield context, text[start:end], last
        if last:
            return
        context, start = text[end - depth : end], end


class Piece:
    """Parts of texts side by side, and the keys of their strings and words."""

    def __init__(self, parts: list[tuple[int, bytes, bytes, bool]], depth: int):
        mark = bytes([MARK])
        held = b"".join(context + part + mark * last for _, context, part, last in parts)
        data = np.frombuffer(held, np.uint8)
        sizes = np.array([len(part) + last for _, _, part, last in parts], np.int64)
        self.owner = np.array([text for text, *_ in parts], np.int32)
        own = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + depth)
        starts = np.cumsum(sizes + depth) - sizes
        counted = np.ones(len(data), bool)
        counted[(starts[:, None] - np.arange(1, depth + 1)[None, :]).ravel()] = False
        place = np.flatnonzero(counted)
        keys = data[place].astype(np.int64)
        for back in range(1, depth + 1):
            keys |= data[place - back].astype(np.int64) << (8 * (depth + 1 - back))
        self.strings, self.string_of = keys, self.owner[own[place]]

        inside = counted & ~BLANK[data] & (data != MARK)
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        powers, inverse = _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODES[data] * powers[: len(data)], dtype=np.uint64)])
        codes = mix64((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        self.words, self.word_of = codes.view(np.int64), self.owner[own[first]]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64; kept by the task."""
    if not _POWERS or len(_POWERS[0]) < n:
        odd = MIX[0] | 1
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + PIECE // 4, x, np.uint64)]), dtype=np.uint64)
                      for x in (odd, pow(odd, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_key(word: bytes) -> int:
    return int(Piece([(0, b"", word, False)], 0).words[0])


def pieces_of(table: pa.Table, depth: int) -> Iterator[Piece]:
    held, size = [], 0
    for number, text in enumerate(table["text"].cast(pa.binary())):
        text = text.as_buffer().to_pybytes() if text.is_valid else b""
        for context, part, last in segments(text.lower(), depth):
            held.append((number, context, part, last))
            size += len(part) + depth + 1
            if size >= PIECE:
                yield Piece(held, depth)
                held, size = [], 0
    if held:
        yield Piece(held, depth)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys, the place of each key among them)."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, at = distinct(keys)
    return some, np.bincount(at, n, len(some)).astype(np.int64)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(*(np.concatenate(x) for x in zip(*parts)))


def counts_of(table: pa.Table, depth: int) -> pa.Table:
    """(g, kind, key, n) of one group of texts: its distinct strings and words, and how often training texts have them."""
    trains = table["trains"].to_numpy().astype(np.int64)
    none = np.empty(0, np.int64)
    found = {STRING: [(none, none)], WORD: [(np.array([END]), np.array([trains.sum()]))]}
    for piece in pieces_of(table, depth):
        found[STRING].append(summed(piece.strings, trains[piece.string_of]))
        found[WORD].append(summed(piece.words, trains[piece.word_of]))
        for kind, parts in found.items():
            if len(parts) > 4:
                found[kind] = [added(parts)]
    out = []
    for kind, parts in found.items():
        keys, n = added(parts)
        out.append((np.full(len(keys), kind, np.int32), keys, n))
    kind, key, n = (np.concatenate(x) for x in zip(*out))
    return pa.table([np.full(len(key), table["g"][0].as_py(), np.int32), kind, key, n], ["g", "kind", "key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2 (Stirling's series, eight places further on)."""
    z, low = x + 8, np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    inv = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680))) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


class Node:
    """The nodes of one depth and decision level: counts, weight of the own estimate, logarithm of Pw."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.zeros, self.ones = zeros, ones
        own = log_kt(zeros.astype(float), ones.astype(float))
        self.estimate = (ones + 0.5) / (zeros + ones + 1.0)
        self.weight = np.ones(len(own)) if below is None else 1 / (1 + np.exp(np.minimum(below - own, 700)))
        self.total = own if below is None else np.logaddexp(own, below) - LN2


class Subtrees:
    """Depths TOP to depth over distinct strings: nodes bottom up, then each string's predictions."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        order = np.argsort(keys)
        self.keys, n = keys[order], n[order]
        pair, of = self.keys, np.arange(len(keys))  # (context, byte), and each string's pair
        below: list = [None] * 8
        self.seen = np.zeros((8, len(keys)))
        for d in range(depth, top - 1, -1):
            if d < depth:
                # Contexts lose their oldest byte, the one beside the byte itself.
                shorter, up = np.unique((pair >> 16 << 8) | (pair & 255), return_inverse=True)
                n = np.bincount(up, n, len(shorter)).astype(np.int64)
            else:
                shorter, up = pair, np.arange(len(pair))
            of = up[of]
            now = []
            for b in range(8):
                name = shorter >> (8 - b)
                start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                number = np.zeros(len(shorter), np.int64)
                number[start[1:]] = 1
                number = np.cumsum(number)
                ones = np.add.reduceat(n * ((shorter >> (7 - b)) & 1), start)
                zeros = np.add.reduceat(n, start) - ones
                children = below[b]
                node = Node(zeros, ones, None if children is None else np.bincount(number[up[children[0]]], children[1].total, len(start)))
                now.append((start, node, name[start]))
                mine = number[of]
                self.seen[b] = node.weight[mine] * node.estimate[mine] + (1 - node.weight[mine]) * self.seen[b]
            below, pair = now, shorter
        self.roots = below

    def summary(self) -> pa.Table:
        """(m, context, zeros, ones, total) of the nodes of depth TOP; m: the decision, as a heap's index."""
        rows = []
        for b, (_, node, name) in enumerate(self.roots):
            rows.append(((1 << b) | (name & ((1 << b) - 1)), name >> b, node.zeros, node.ones, node.total))
        return pa.table([np.concatenate(x) for x in zip(*rows)], ["m", "context", "zeros", "ones", "total"])


def upper_nodes(table: pa.Table, top: int) -> pa.Table:
    """(m, context, known, rest): above the subtrees of one decision, for each context of TOP - 1 bytes the part of
    the prediction that shorter contexts give, and the weight they leave."""
    context, zeros, ones, total = (table[c].to_numpy() for c in ("context", "zeros", "ones", "total"))
    levels = []
    for _ in range(top):
        context, up = np.unique(context >> 8, return_inverse=True)
        zeros, ones, below = (np.bincount(up, x, len(context)) for x in (zeros, ones, total))
        node = Node(zeros, ones, below)
        total = node.total
        levels.append((context, node))
    known, rest = np.zeros(1), np.ones(1)
    at = np.zeros(1, np.int64)  # contexts of the level above
    for context, node in reversed(levels):
        up = np.searchsorted(at, context >> 8)
        known = known[up] + rest[up] * node.weight * node.estimate
        rest, at = rest[up] * (1 - node.weight), context
    return pa.table([np.full(len(at), table["m"][0].as_py(), np.int64), at, known, rest], ["m", "context", "known", "rest"])


def string_values(strings: pa.Table, upper: pa.Table, depth: int, top: int) -> pa.Table:
    """(kind, key, value): log10 of the predicted probability of each string's byte after its context."""
    trees = Subtrees(strings["key"].to_numpy(), strings["n"].to_numpy(), depth, top)
    name = upper["context"].to_numpy() << 8 | upper["m"].to_numpy()
    order = np.argsort(name)
    name, known, rest = name[order], upper["known"].to_numpy()[order], upper["rest"].to_numpy()[order]
    context = trees.keys >> (8 * (depth + 2 - top))
    value = np.zeros(len(trees.keys))
    for b in range(8):
        at = np.searchsorted(name, context << 8 | (1 << b) | ((trees.keys & 255) >> (8 - b)))
        one = known[at] + rest[at] * trees.seen[b]
        value += np.log10(np.where((trees.keys >> (7 - b)) & 1, one, 1 - one))
    return pa.table([np.full(len(value), STRING, np.int32), trees.keys, value], ["kind", "key", "value"])


def scores_of(texts: pa.Table, values: pa.Table, depth: int, words: int, vocabulary: int) -> pa.Table:
    """The scores of one group's texts from the values of its strings and words."""
    rows = texts.num_rows
    kind, key, value = (values[c].to_numpy() for c in ("kind", "key", "value"))
    looked = {}
    for k in (STRING, WORD):
        keys, found = key[kind == k], value[kind == k]
        order = np.argsort(keys)
        looked[k] = keys[order], found[order]

    def look(k: int, asked: np.ndarray) -> np.ndarray:
        some, at = distinct(asked)
        return looked[k][1][np.searchsorted(looked[k][0], some)][at] if len(some) else np.empty(0)

    score, base = np.zeros(rows), np.zeros(rows)
    tokens, known, sizes = (np.zeros(rows, np.int64) for _ in range(3))
    for piece in pieces_of(texts, depth):
        score += np.bincount(piece.string_of, look(STRING, piece.strings), rows)
        sizes += np.bincount(piece.string_of, minlength=rows)
        count = look(WORD, piece.words)
        base += np.bincount(piece.word_of, np.log10((count + 1) / (words + vocabulary + 1)), rows)
        tokens += np.bincount(piece.word_of, minlength=rows)
        known += np.bincount(piece.word_of, count > 0, rows).astype(np.int64)
    if rows:
        end = look(WORD, np.array([END]))[0]
        base += np.log10((end + 1) / (words + vocabulary + 1))
        tokens, known = tokens + 1, known + int(end > 0)
    return pa.table(
        [texts["doc_id"], texts["held_out"], tokens, known, np.full(rows, words, np.int64), base, score, sizes, -score / math.log10(2) / np.maximum(sizes, 1)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_coded", "bits_per_byte"],
    )


def scores(df: DataFrame, held_out=None, depth: int = DEPTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_coded, bits_per_byte) of each row.

    held_out: condition on doc_id of the rows that the model does not learn from.
    """
    top = min(TOP, depth)
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = df.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    groups = math.ceil((size + 1) / group_bytes)
    texts = df.select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("trains"),
                      F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g"))

    found = written(texts.groupBy("g").applyInArrow(lambda t: counts_of(t, depth), "g int, kind int, key long, n long"))
    totals = written(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, vocabulary = totals.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()

    def bucket(context):
        return F.pmod(F.xxhash64(context), F.lit(groups)).cast("int").alias("bucket")

    root = F.shiftright("key", 8 * (depth + 1 - top))
    strings = totals.where(F.col("kind") == STRING).select("key", "n", bucket(root))
    subtrees = written(strings.groupBy("bucket").applyInArrow(
        lambda t: Subtrees(t["key"].to_numpy(), t["n"].to_numpy(), depth, top).summary(),
        "m long, context long, zeros long, ones long, total double"))
    upper = subtrees.groupBy("m").applyInArrow(lambda t: upper_nodes(t, top), "m long, context long, known double, rest double")
    needed = subtrees.select(bucket(F.col("context")), F.shiftright("context", 8).alias("context"), "m").distinct()
    upper = needed.join(upper, ["context", "m"])
    valued = strings.groupBy("bucket").cogroup(upper.groupBy("bucket")).applyInArrow(
        lambda s, u: string_values(s, u, depth, top), "kind int, key long, value double")
    valued = valued.union(totals.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")))
    asked = written(found.select("g", "kind", "key").join(valued, ["kind", "key"]).select("g", "kind", "key", "value"))
    return texts.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(
        lambda t, v: scores_of(t, v, depth, words, vocabulary),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_coded long, bits_per_byte double",
    )


def document_scores(docs: DataFrame) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    return scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
