"""Personal data with source offsets, seen through disguises.

Four kinds (email, ip, card, phone) are found by plain patterns in the text itself: the base spans. Then the text runs through
transducers that undo homoglyphs and invisible characters, spelled digits, and at / dot disguises, each remembering what it
replaced; the same patterns run over the normalised text, and spans that owe something to a replacement are mapped back to the
source characters and added. Base spans always stay, an added span never overlaps one of its kind.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind only spares attempts inside a run of digits, which can't match where its start didn't.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str, wanted: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; works outward from each @, so that it is linear in the text.

    After an address that isn't wanted, by its start and end, the search goes on behind its @.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m and wanted and not wanted(start, m.end()):
            m = None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups())]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_FINDERS = (emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    return [f(text) for f in _FINDERS]


# ---- transducers

_DIGIT = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAMES = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_GLYPHS = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅ", "aeopcyxijshdqwlABEKMHOPCTXYIJS", strict=True)) | dict(zip("οανικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikpuABEZHIKMNOPTYX", strict=True))
_GLYPHS |= {"﹫": "@", "․": ".", "﹒": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹣": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ", "﹢": "+", "℮": "e", "ⅼ": "l", "ı": "i"}
for _base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # digits of other scripts and of mathematics
    _GLYPHS |= {chr(_base + i): str(i) for i in range(10)}
_GLYPHS |= {chr(0x2460 + i): str(i + 1) for i in range(9)} | {"⓪": "0"}
for _base, _first in ((0x1D400, "A"), (0x1D41A, "a"), (0x1D5A0, "A"), (0x1D5BA, "a"), (0x1D5D4, "A"), (0x1D5EE, "a"), (0x1D670, "A"), (0x1D68A, "a")):
    _GLYPHS |= {chr(_base + i): chr(ord(_first) + i) for i in range(26)}
_INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile(f"[{''.join(map(re.escape, _GLYPHS))}{_INVISIBLE}]")
_AT, _DOT = r"(?:at|ät|arroba|@)", r"(?:dot|d0t|punkt|punto|point|\.)"


def _tokens(at: str) -> re.Pattern:
    return re.compile(
        rf"(?P<odd>(?-i:[{''.join(map(re.escape, _GLYPHS))}{_INVISIBLE}]))"
        rf"|(?P<bat>[\x20\t]{{0,4}}[\[({{<]\s{{0,4}}{_AT}\s{{0,4}}[\])}}>][\x20\t]{{0,4}})|(?P<bdot>[\x20\t]{{0,4}}[\[({{<]\s{{0,4}}{_DOT}\s{{0,4}}[\])}}>][\x20\t]{{0,4}})"
        rf"{at}|(?P<dot>\x20{{1,4}}(?:dot|punkt|punto)\x20{{1,4}})"
        rf"|(?P<plus>(?<![^\W_])plus\x20{{1,4}}(?=[0-9]|(?:{_NAMES})\b))"
        rf"|(?P<num>(?<![^\W_])(?:{_NAMES})(?:(?:\x20|-|,\x20)(?:{_NAMES}))*(?![^\W_]))",
        re.IGNORECASE,
    )


#: Without and with the bare word for @.
_TOKEN, _TOKEN_AT = _tokens(""), _tokens(r"|(?P<at>\x20{1,4}(?:at|arroba)\x20{1,4})")
_NUM = re.compile(_NAMES, re.IGNORECASE)
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,4}}(?:{_AT}|{_DOT})\s{{0,4}}[\])}}>]")
_PLUS = re.compile(rf"plus\x20{{1,4}}(?:[0-9]|{_NAMES})")
#: What ignoring case takes for an ASCII letter besides its two cases.
_FOLDED = {"ſ": "s", "ı": "i", "İ": "i", "\u212a": "k"}


def _folded(text: str) -> str:
    if not text.isascii():
        for odd, plain in _FOLDED.items():
            text = text.replace(odd, plain)
    return text.lower()


def _has_word(text: str, word: str) -> bool:
    at = text.find(word)
    while at >= 0:
        if not text[at - 1 : at].isalnum() and not text[at + len(word) : at + len(word) + 1].isalnum():
            return True
        at = text.find(word, at + 1)
    return False


def suspicious(text: str) -> bool:
    """Whether the text holds any replacement but a bare word for @, which alone never makes a span.

    A superset of what _TOKEN matches, by tests that are cheap on plain texts.
    """
    if not text.isascii() and _ODD.search(text):
        return True
    low = _folded(text)
    if " dot " in low or " punkt " in low or " punto " in low or any(_has_word(low, x) for x in _DIGIT):
        return True
    return bool(_BRACKETED.search(low)) or ("plus " in low and bool(_PLUS.search(low)))


def normalise(text: str, bare_at: bool = True) -> tuple[str, list[tuple[int, int, int, int, str]]]:
    """The normalised text and its replacements (start and end in it, start and end in the source, rule).

    bare_at: whether the word ``at`` alone is one.
    """
    out, edits, size, last = [], [], 0, 0
    for m in (_TOKEN_AT if bare_at else _TOKEN).finditer(text):
        rule = m.lastgroup
        if rule == "odd":
            new = _GLYPHS.get(m[0], "")
        elif rule == "num":
            names = _NUM.findall(m[0])
            new = "".join(_DIGIT[_folded(x)] for x in names)
        else:
            new = {"bat": "@", "at": "@", "bdot": ".", "dot": ".", "plus": "+"}[rule]
        s, e = m.span()
        out += [text[last:s], new]
        size += s - last
        edits.append((size, size + len(new), s, e, rule))
        size += len(new)
        last = e
    out.append(text[last:])
    return "".join(out), edits


class _Normalised:
    """A normalised text whose offsets lead back to the source."""

    def __init__(self, text: str, bare_at: bool) -> None:
        self.text, self.edits = normalise(text, bare_at)
        self.starts, self.ends = [e[0] for e in self.edits], [e[1] for e in self.edits]

    def rules(self, s: int, e: int) -> set[str]:
        """The rules of the replacements that a span owes something to."""
        return {x[4] for x in self.edits[bisect.bisect_left(self.ends, s + 1) : bisect.bisect_left(self.starts, e)]}

    def offset(self, i: int, end: bool) -> int:
        """Where the normalised offset i lies; inside a replacement, at its near or far edge."""
        edits = self.edits
        j = bisect.bisect_left(self.starts, i) - 1  # the last edit that begins before i
        if j >= 0 and i < self.ends[j]:
            return edits[j][3] if end else edits[j][2]
        if not end and (k := bisect.bisect_right(self.starts, i) - 1) >= 0 and edits[k][0] <= i < edits[k][1]:
            return edits[k][2]
        return i if j < 0 else edits[j][3] + i - self.ends[j]

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.offset(s, False), self.offset(e, True)


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Which of some ascending spans that lie apart overlap a .. b."""
    lo, hi = bisect.bisect_left(spans, (a,)), bisect.bisect_left(spans, (b,))
    if lo and spans[lo - 1][1] > a:
        lo -= 1
    return spans[lo:hi]


def added_spans(text: str, base: list[list[tuple[int, int]]], gate: bool = True) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Spans by kind that only show in the normalised text, as source offsets; and those that a base span of the kind lies in, which only redaction needs.

    Bare words for @ are undone last, for addresses in what is left: a word before a disguised address isn't its local part (``me at john.doe (at)
    example (dot) com``). An address joined by one needs a disguised dot too (``look at example.com`` is prose, ``ann at example dot com`` is not), and of
    two that share their middle the second is taken if its domain has one (``me at ann dot lee at example dot com``). gate: pass texts over that ``suspicious``
    clears, which changes no result.
    """
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    wider: list[list[tuple[int, int]]] = [[], [], [], []]
    if gate and not suspicious(text):
        return found, wider

    def free(kind: int, a: int, b: int) -> bool:
        return not _overlaps(found[kind], a, b) and not _overlaps(base[kind], a, b)

    norm = _Normalised(text, False)
    for kind, finder in enumerate(_FINDERS):
        for s, e in finder(norm.text):
            if norm.rules(s, e):
                a, b = norm.source(s, e)
                if free(kind, a, b):
                    found[kind].append((a, b))
                elif any(a <= x and y <= b for x, y in _overlaps(base[kind], a, b)):
                    wider[kind].append((a, b))
    dots = {"dot", "bdot"}
    if not any(x[4] in dots for x in norm.edits):
        return found, wider
    norm = _Normalised(text, True)

    def wanted(s: int, e: int) -> bool:
        rules = norm.rules(s, e)
        if "at" not in rules or not rules & dots or not free(0, *norm.source(s, e)):
            return False
        after = _DOMAIN.match(norm.text, e)
        return not (after and norm.rules(*after.span()) & dots)

    more = [norm.source(s, e) for s, e in emails(norm.text, wanted)]
    found[0] = sorted(found[0] + more)
    return found, wider


def scan(text: str | None) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans and all spans, by kind, ascending."""
    base, every, _ = _scan(text or "")
    return base, every


def _scan(text: str) -> tuple[list[list[tuple[int, int]]], ...]:
    base = base_spans(text)
    extra, wider = added_spans(text, base)
    return base, [sorted(b + x) if x else b for b, x in zip(base, extra, strict=True)], wider


def cleaned(text: str | None) -> str | None:
    """The text without personal data: all spans, and of a base span in a wider disguised one (``ann (dot) lee@example.com``) that one, give way to their kinds."""
    if text is None:
        return None
    _, every, wider = _scan(text)
    return redact(text, [sorted(a + b) if b else a for a, b in zip(every, wider, strict=True)])


def listed(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans, strict=True) for s, e in own)


def redact(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the earlier, then the longer one names it."""
    flat = sorted((s, -e, k) for k, own in zip(KINDS, spans, strict=True) for s, e in own)
    out, last = [], 0
    for s, e, k in flat:
        e = -e
        if s >= last:
            out += [text[last:s], f"<{k.upper()}>"]
        last = max(last, e)
    out.append(text[last:])
    return "".join(out)


def detect(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row; with_text adds redacted.

    The counts and spans are of all spans, base_sha256 is of the base ones. Offsets are code points, ends exclusive. Narrow: one pass
    of Arrow batches, no shuffle. A null text counts as empty; rows that repeat an id stand for themselves; other columns aren't
    read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, sha, spans, texts = [[], [], [], []], [], [], []
            for t in b.column(1).to_pylist():
                base, every, wider = _scan(t or "")
                for c, own in zip(counts, every, strict=True):
                    c.append(len(own))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
                if with_text:
                    texts.append(None if t is None else redact(t, [sorted(a + w) for a, w in zip(every, wider, strict=True)]))
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and rows, personal data in the text replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>``, ``<PHONE>``; null stays null."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(t: pa.Array) -> pa.Array:
        return pa.array([cleaned(x) for x in t.to_pylist()], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))
