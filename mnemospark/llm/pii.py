"""Personal data in texts, disguised or not, with offsets into the text as given.

Plain identifiers are found first, by fixed patterns, leftmost and without overlaps for each kind.
Then small transducers rewrite the text and keep, for each character written, the span it came
from: look-alike letters and digits of other alphabets, digits spelled as words, and words or
brackets that stand for the at sign and the dot.  Identifiers found in the rewritten text are
mapped back; one that no plain span of its kind overlaps is added.  A rewriting counts only where
it makes a whole identifier: a spelled at sign needs a spelled or plain dot and an ending of
letters behind it, and a run of spelled digits and dots, however few, must pass the plain pattern
and check of its kind (parts of an address, Luhn, number of digits).

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive;
kinds are listed as email, ip, card, phone, and spans of a kind by start.  Rows stay rows: repeated
ones repeat their results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import column, in_arrow, pieces

KINDS = ("email", "ip", "card", "phone")

# The plain patterns.  Possessive repeats and look-behinds only spare attempts that cannot match.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")

# Letters and digits that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "・": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "−": "-", "＠": "@", "﹫": "@", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
# Digits in words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
AT = re.compile(r"[ \t]*(?:[\[({<][ \t]*(?:at|@|ät|arroba|arobase)[ \t]*[\])}>])[ \t]*|[ \t]+(?:at|arroba|arobase)[ \t]+", re.I)
DOT = re.compile(r"[ \t]*(?:[\[({<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[\])}>])[ \t]*|[ \t]+(?:dot|punkt|point|punto)[ \t]+", re.I)
#: An address with at least one spelled sign; every part is a single word, and it ends in letters.
PART = r"[A-Za-z0-9_%+-]+"
SIGN_AT = rf"(?:[ \t]?@[ \t]?|{AT.pattern})"
SIGN_DOT = rf"(?:\.|{DOT.pattern})"
SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-]){PART}(?:{SIGN_DOT}{PART}){{0,4}}{SIGN_AT}[A-Za-z0-9-]+(?:{SIGN_DOT}[A-Za-z0-9-]+){{0,4}}{SIGN_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)
NUMBER_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
DOT_WORD = "dot|punkt|point|punto"
DOT_BRACKET = rf"[\[({{<][ \t]*(?:{DOT_WORD}|\.)[ \t]*[\])}}>]"
BREAK = r"(?:[ \t]*+[-.,()][ \t]*+|[ \t]++)"


def spelled_run(dots: str, gap: str) -> re.Pattern:
    """Runs of digits, digit words and the given dots with single separators."""
    return re.compile(rf"(?<!\w)(?:plus[ \t]+|\+[ \t]?)?(?:{NUMBER_WORD}|[0-9]++)(?:{gap}|(?=[\[({{<]))(?:(?:{NUMBER_WORD}|[0-9]++|{dots}){gap}?)+(?!\w)", re.I)


SPELLED_RUN = spelled_run(f"{DOT_WORD}|{DOT_BRACKET}", rf"(?:(?![ \t]*{DOT_BRACKET})[ \t]*+[-.,()][ \t]*+|[ \t]++)")
#: The same, ended by square, curly and angle brackets: an identifier may stand before them.
UNBRACKETED_RUN = spelled_run(DOT_WORD, BREAK)
RUN_TOKEN = re.compile(rf"(plus[ \t]+)|({NUMBER_WORD})|([ \t]*(?:{DOT_WORD}|{DOT_BRACKET})[ \t]*)|([0-9]+)|([ \t]*\.[ \t]*)|((?:(?!{DOT_BRACKET})[^\w])+)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outwards: what the whole pattern finds from the left, in one pass."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return spans


def addresses(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or 0) <= 255

    return [m.span() for m in IP.finditer(text) if all(small(p) for p in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    found = ((m.span(), only_digits(m.group())) for m in CARD.finditer(text))
    return [span for span, digits in found if 13 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}
HAS_DIGIT = re.compile(r"[0-9]")


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind in the text as it is."""
    digits = HAS_DIGIT.search(text) is not None
    return {kind: find(text) if (kind == "email" or digits) else [] for kind, find in FINDERS.items()}


class Rewritten:
    """A text and, for each of its characters, the source span that it came from."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Edits (start, end, new text), ascending; each new character spans all it replaces."""
        out = Rewritten("")
        out.starts, out.ends = [], []
        parts, at = [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            parts.append(self.text[at:start])
            out.starts += self.starts[at:start]
            out.ends += self.ends[at:start]
            if new:
                parts.append(new)
                first, last = (self.starts[start], self.ends[end - 1]) if end > start else (self.starts[at], self.starts[at])
                out.starts += [first] * len(new)
                out.ends += [last] * len(new)
            at = end
        out.text = "".join(parts)
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], max(self.ends[start:end])


ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff①-⑳]")


def look_alike(text: Rewritten) -> Rewritten:
    edits = []
    for m in ODD.finditer(text.text):
        c = m.group()
        new = "" if c in INVISIBLE else LOOKALIKES.get(c)
        if new is None:
            digit = unicodedata.digit(c, None)
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if new != c and new.isascii():
            edits.append((m.start(), m.end(), new))
    return text.replaced(edits) if edits else text


LOOSE_AT = re.compile(r"[ \t]?@[ \t]?")


def signs(text: Rewritten) -> Rewritten:
    """Spelled at signs and dots, inside what then reads as one address.

    A bare word for the at sign counts only with a spelled dot behind it: "see you at example.org"
    is no address.
    """
    edits = []
    for m in SPELLED.finditer(text.text):
        inner = [(x.start(), x.end(), "@") for x in AT.finditer(text.text, m.start(), m.end())]
        dots = [(x.start(), x.end(), ".") for x in DOT.finditer(text.text, m.start(), m.end())]
        if inner and not re.match(r"[ \t]*[\[({<]", text.text[inner[0][0] : inner[0][1]]) and not any(d[0] >= inner[0][1] for d in dots):
            continue
        inner += dots
        loose = [(x.start(), x.end(), "@") for x in LOOSE_AT.finditer(text.text, m.start(), m.end())]
        inner += [x for x in loose if not any(a < x[1] and x[0] < b for a, b, _ in inner)]
        inner.sort()
        if all(x[1] <= y[0] for x, y in zip(inner, inner[1:])):
            edits += inner
    return text.replaced(edits) if edits else text


def digits(text: Rewritten, joined: bool, run: re.Pattern = SPELLED_RUN) -> Rewritten:
    """Runs with a spelled part, in digits and dots.

    Joined: runs with digit words, without the separators inside them.  Else the separators stay, so
    that they end identifiers as in plain text.
    """
    edits = []
    for m in run.finditer(text.text):
        parts, words, spelled = [], 0, 0
        for x in RUN_TOKEN.finditer(text.text, m.start(), m.end()):
            plus, word, dot, number, point, _ = x.groups()
            new = x.group()
            if word:
                new = DIGIT_WORDS[word.lower()]
                words += 1
            elif plus or dot:
                new = "+" if plus else "."
                spelled += 1
            elif "+" in new:
                new = "+"
            elif joined and point:
                new = "."
            elif joined and not number and x.end() < m.end():
                new = ""
            parts.append((x.start(), x.end(), new))
        if words or (spelled and not joined):
            edits += [x for x in parts if text.text[x[0] : x[1]] != x[2]]
    return text.replaced(edits) if edits else text


TOKENS = re.compile(r"[^\W\d_]+|[0-9]+")
BRACKETED = re.compile(r"[\[({<][ \t]*(?:at|@|ät|arroba|arobase|dot|punkt|point|punto|\.)[ \t]*[\])}>]", re.I)
#: Two neighbours of a run, one of them spelled.
NEIGHBOURS = re.compile("[1.+][1d.]|[1d][1.]")
WORDS = re.compile(rf"(?:{NUMBER_WORD}|{DOT_WORD})+")


@lru_cache(1 << 16)
def mark(token: str) -> str:
    """1 for digit words, also several in one, . and + for words of these signs, d for digits, else 0."""
    if token in DIGIT_WORDS:
        return "1"
    if WORDS.fullmatch(token):
        return "." if token in ("dot", "punkt", "point", "punto") else "1.1"
    return "+" if token == "plus" else "d" if "0" <= token[0] <= "9" else "0"


AT_BLANK = re.compile(r"[ \t]@|@[ \t]")


def cues(text: str) -> tuple[bool, bool]:
    """Whether an address, and whether a number, can be spelled out in the text: False only where signs() or digits() change nothing."""
    marks = "".join(map(mark, TOKENS.findall(text.lower())))
    bracketed = BRACKETED.search(text) is not None
    return "." in marks or bracketed or AT_BLANK.search(text) is not None, bracketed or NEIGHBOURS.search(marks) is not None


def added_spans(text: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows; none overlaps a plain span of its kind."""
    base = Rewritten(text) if text.isascii() or not ODD.search(text) else look_alike(Rewritten(text))
    signed, worded = cues(base.text)
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    versions = []
    if signed:
        versions.append(signs(base))
    if worded:
        versions += [digits(base, False), digits(base, True), digits(base, True, UNBRACKETED_RUN)]
    versions = [v for v in versions if v is not base]
    if base.text != text:
        versions.append(base)
    for version in versions:
        for kind, spans in plain_spans(version.text).items():
            for start, end in spans:
                a, b = version.source(start, end)
                if all(b <= x or y <= a for x, y in plain[kind] + found[kind]):
                    found[kind].append((a, b))
    return found


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_spans(df: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans as strings kind:start:end, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, added = [], []
            for text in column(batch, "text").to_pylist():
                plain = plain_spans(text or "")
                base.append(listed(plain))
                added.append(listed(added_spans(text or "", plain)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(base, pa.string()), pa.array(added, pa.string())], ["doc_id", "base", "added"]
            )

    return in_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, base string, added string")


def sorted_spans(text: str) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    items = [(order[k], int(a), int(b), k) for k, a, b in (x.split(":") for x in text.split(",") if x)]
    return ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(items))


def report(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of the plain spans, base_sha256, spans, n_added) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = column(batch, "base").to_pylist()
            added = column(batch, "added").to_pylist()
            counts = [[sum(x.startswith(f"{kind}:") for x in b.split(",")) for b in base] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
                    pa.array([sorted_spans(f"{b},{a}") if a else b for b, a in zip(base, added)], pa.string()),
                    pa.array([len(a.split(",")) if a else 0 for a in added], pa.int64()),
                ],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return in_arrow(
        find_spans(df), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def masked(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in angle brackets."""
    if not text:
        return text
    plain = plain_spans(text)
    added = added_spans(text, plain)
    spans = sorted((a, -b, kind) for kind in KINDS for a, b in plain[kind] + added[kind])
    if not spans:
        return text
    parts, at = [], 0
    for a, minus, kind in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -minus)
    return "".join([*parts, text[at:]])


def without_pii(df: DataFrame) -> DataFrame:
    """The same rows and columns with identifiers masked in text; n_chars, if there, counts the new text."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([masked(t) for t in columns[at].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = in_arrow(df, run, df.schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(df.schema["n_chars"].dataType), F.col("n_chars")))
    return out
