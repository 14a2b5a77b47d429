"""Line-first cleaning: rules for punctuation, navigation and boilerplate judge each line, failing lines go, and a document that
loses too much of its text goes with them.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = ("all rights reserved", "cookie", "javascript", "lorem ipsum", "privacy policy", "terms of use", "terms of service", "sign in", "log in", "subscribe", "click here", "read more", "skip to content")
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
_SYMBOL, _END, _BOILER = re.compile(f"[{re.escape(SYMBOLS)}]"), re.compile(r"[.!?…。！？]"), re.compile("|".join(map(re.escape, BOILERPLATE)))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space. str.split() knows more kinds of it, so those are only used where there are none."""
    return text.split() if text.isascii() and not _ODD.search(text) else _WORD.findall(text)


_ODD = re.compile("[\x1c-\x1f]")


def line_fails(line: str, n: int) -> str:
    """The rule that a line of n words breaks, or an empty string.

    symbols: over one of ``#*$%&|<>`` in ten words, three at least. navigation: three words or fewer and no sentence end.
    shouting: eight words or more, and over half of the letters are capitals. boilerplate: a known phrase in a line of at most 20 words.
    punctuation: no sentence end anywhere in the line. A line without a word breaks none.
    """
    if not n:
        return ""
    symbols = len(_SYMBOL.findall(line))
    if symbols >= 3 and 10 * symbols > n:
        return "symbols"
    ended = _END.search(line)
    if not ended:
        return "navigation" if n <= 3 else "punctuation"
    if n <= 20 and _BOILER.search(line.lower()):
        return "boilerplate"
    if n >= 8 and not line.islower():
        upper = sum(map(str.isupper, line))
        if 4 * upper > len(line) and 2 * upper > sum(map(str.isalpha, line)):
            return "shouting"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, upto = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judge(text: str | None) -> dict:
    """All figures of one document, its cleaned text and the verdict."""
    text = text or ""
    lines = text.split("\n")
    seen: set[str] = set()
    words: list[str] = []
    good: list[str] = []
    dup = left = 0
    for line in lines:
        own = words_of(line)
        words += own
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
        if not line_fails(line, len(own)):
            good.append(line)
            left += len(own)
    n = len(words)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed,
        "kept": not failed and 100 * (n - left) <= MAX_LOST_PERCENT * n, "n_kept_words": left, "cleaned": "\n".join(good) if len(good) < len(lines) else text,
    }


_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_kept_words": pa.int64(), "cleaned": pa.string()}
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_kept_words long"


def assess(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the figures of ``judge`` for every row; with_text adds cleaned, the text without the failing lines.

    Narrow: no shuffle, one pass of Arrow batches. A null text counts as empty, which fails (fewer than 50 words); rows that
    repeat an id are judged each by itself; null ids stay null; other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = [x for x in _FIELDS if with_text or x != "cleaned"]

    def run(batches):
        for b in batches:
            rows = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[x] for r in rows], _FIELDS[x]) for x in names)], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, {_DDL}" + ", cleaned string" * with_text)


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept; their texts stay whole (``assess`` has cleaned ones).

    Decided in one pass by an Arrow UDF over the text, so nothing is joined or shuffled.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def verdict(t: pa.Array) -> pa.Array:
        return pa.array([judge(x)["kept"] for x in t.to_pylist()], pa.bool_())

    return docs.where(verdict(F.col(text_col)))
