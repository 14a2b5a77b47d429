"""Regular expressions of the PCRE kind as Spark's, matched at the start of a key."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r"\h", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w"}
_REFUSED = ((r"\\K", r"\K"), (r"\(\?R\)|\(\?[+-]?\d+\)|\(\?&|\(\?P>", "recursion"), (r"\(\*", "a verb"), (r"\(\?\(", "a condition"), (r"\(\?\|", "a branch reset"))


class PatternError(ValueError):
    """A pattern that can't be compiled."""


def translate(pattern: str) -> str:
    """The same pattern in Spark's dialect; PatternError for what that lacks."""
    bare = re.sub(r"\\Q.*?(?:\\E|\Z)", "", pattern, flags=re.DOTALL)
    bare = re.sub(r"\\\\", "", bare)
    for p, what in _REFUSED:
        if re.search(rf"(?<!\\){p}" if not p.startswith(r"\\") else p, bare):
            raise PatternError(f"pattern not supported: {what}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif inside and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
            if m[2] not in _POSIX:
                raise PatternError(f"unknown class name [:{m[2]}:]")
            own = _POSIX[m[2]]
            out.append((own.replace(r"\p", r"\P") if own.startswith(r"\p") else own.upper()) if m[1] else own)
            i += m.end()
        elif inside:
            inside = pattern[i] != "]" or out[-1] in ("[", "[^")
            if not inside:
                out.append("]")
            else:
                out.append("\\" + pattern[i] if pattern[i] in "[]" or pattern[i : i + 2] == "&&" else pattern[i])
            i += 1
        elif pattern[i] == "[":
            inside = True
            out.append("[^" if pattern[i + 1 : i + 2] == "^" else "[")
            i += len(out[-1])
        elif m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
            out.append(f"(?<{m[1]}>")
            i += m.end()
        elif m := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(rf"\k<{m[1]}>")
            i += m.end()
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def literal_prefix(pattern: str) -> str:
    """Characters that every match begins with; a filter on them reaches the Parquet scan."""
    if "|" in pattern or "\\Q" in pattern or "(?" in pattern:
        return ""
    m = re.match(r"[^\\.^$*+?()\[\]{}|]*", pattern)
    head, rest = m[0], pattern[m.end() :]
    return head[:-1] if rest[:1] in ("*", "?", "{") else head


def compile_pattern(spark: SparkSession, pattern: str) -> str:
    """The checked expression that a key must match at its start; PatternError if there is none."""
    own = translate(pattern)
    try:
        spark.sql("SELECT rlike('', :p)", args={"p": own}).collect()  # alone, so that an odd bracket can't close the group below
    except Exception as e:
        raise PatternError(f"pattern compilation failed: {str(e).splitlines()[0]}") from None
    return rf"\A(?dU:{own})"


def matches_at_start(key: Column, pattern: str, compiled: str) -> Column:
    hit = F.rlike(key, F.lit(compiled))
    head = literal_prefix(pattern)
    return F.startswith(key, F.lit(head)) & hit if head else hit
