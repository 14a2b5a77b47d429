"""Point lookups over entries(dict, entry_no, key, value). names=None stands for every dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_whitespace
from ..plans.durable import materialize, numbered

LINK = "@@@LINK="


def chosen(entries: DataFrame, names: list[str] | None) -> DataFrame:
    """The dictionaries of those names; unknown ones are passed over."""
    return entries if names is None else entries.where(F.col("dict").isin(list(names)))


def contains(entries: DataFrame, word: str, names: list[str] | None = None) -> bool:
    """Whether a word is a key; never for the empty word. The filter is pushed and stops at the first hit."""
    return bool(word) and bool(chosen(entries, names).where(F.col("key") == word).select(F.lit(1)).head(1))


def exact_match(entries: DataFrame, word: str, names: list[str] | None = None) -> DataFrame:
    """dict, entry_no, value of a key, in stored order."""
    return chosen(entries, names).where(F.col("key") == word).select("dict", "entry_no", "value").orderBy("dict", "entry_no")


def exact_match_lists(entries: DataFrame, word: str, names: list[str] | None = None) -> DataFrame:
    """dict, values of the dictionaries that have the key."""
    hits = chosen(entries, names).where(F.col("key") == word)
    return hits.groupBy("dict").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "value"))), lambda x: x["value"]).alias("values"))


def value_at(entries: DataFrame, word: str, name: str) -> str:
    """The first value of a key; KeyError without one."""
    got = exact_match(entries, word, [name]).head(1)
    if not got:
        raise KeyError(word)
    return got[0].value


def key_codes(entries: DataFrame) -> DataFrame:
    """dict, key, first_index, dup_count, code: duplicates of a key folded to the position of the first and how many follow.

    first_index is the place in (key, entry_no) order of the dictionary; code = dup_count * 2^32 + first_index.
    """
    runs = entries.groupBy("dict", "key").agg(F.count("*").alias("n"), F.min("entry_no").alias("first_entry"))
    order = numbered(runs, "dict", "key", name="_no", first=0)
    # entries before a key in its dictionary: a running sum, made from the sums of blocks of a thousand keys
    order = materialize(order.withColumn("_block", F.floor(F.col("_no") / 1000)), "runs")
    blocks = order.groupBy("dict", "_block").agg(F.sum("n").alias("s"))
    w = Window.partitionBy("dict").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("dict", "_block", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    own = Window.partitionBy("dict", "_block").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    d = order.join(before, ["dict", "_block"]).withColumn("first_index", (F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0))).cast("long"))
    dup = (F.col("n") - 1).cast("long")
    return d.select("dict", "key", "first_index", dup.alias("dup_count"), (dup * F.lit(1 << 32) + F.col("first_index")).alias("code"))


# ---- batch forms: one join for a table of words


def contains_many(entries: DataFrame, words: DataFrame, names: list[str] | None = None, word: str = "word") -> DataFrame:
    """The rows of ``words`` whose word is a key."""
    keys = chosen(entries, names).select(F.col("key").alias("_key"))
    return words.where(F.col(word) != "").join(keys, F.col(word) == F.col("_key"), "left_semi")


def missing(entries: DataFrame, words: DataFrame, names: list[str] | None = None, word: str = "word") -> DataFrame:
    """The rows of ``words`` whose word is no key."""
    keys = chosen(entries, names).select(F.col("key").alias("_key"))
    return words.join(keys, F.col(word) == F.col("_key"), "left_anti")


def exact_match_many(entries: DataFrame, words: DataFrame, names: list[str] | None = None, word: str = "word") -> DataFrame:
    """Each row of ``words`` with dict, entry_no and value of its key."""
    e = chosen(entries, names).select(F.col("key").alias("_key"), "dict", "entry_no", "value")
    return words.join(e, F.col(word) == F.col("_key")).drop("_key")


# ---- redirects


def _targets(hits: DataFrame) -> DataFrame:
    link = F.split(F.col("value"), LINK, -1)
    return hits.where(F.contains("value", F.lit(LINK))).select("dict", "start", trim_whitespace(F.get(link, F.lit(1))).alias("key")).distinct()


def resolve(entries: DataFrame, starts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """dict, start, key, entry_no, value: all values a word leads to in each dictionary, redirects followed there and left out.

    starts: a column ``start`` of words. A value with the marker redirects to what stands after its first one, up to the next. Each
    round joins the new words of all dictionaries at once; a word is visited once for a start, so cycles end.
    """
    e = chosen(entries, names)
    # a start that is no key of a dictionary leads nowhere in it, so the first round is an equi-join too
    own = starts.select("start").distinct()
    front = materialize(own.join(e.select("dict", "key").distinct(), F.col("start") == F.col("key")).select("dict", "start", "key"), "front")
    seen, hits = front, None
    while True:
        found = materialize(front.join(e, ["dict", "key"]).select("dict", "start", "key", "entry_no", "value"), "hits")
        hits = found if hits is None else hits.unionByName(found)
        front = materialize(_targets(found).join(seen, ["dict", "start", "key"], "left_anti"), "front")
        if not front.head(1):
            return hits.where(~F.contains("value", F.lit(LINK)))
        seen = seen.unionByName(front)


def lookup(entries: DataFrame, word: str, names: list[str] | None = None) -> dict[str, list[str]]:
    """dictionary -> values of one word with redirects replaced, in place, by what they lead to (depth first, each word once)."""
    e = chosen(entries, names)
    front, seen = {word}, {word}
    values: dict[tuple[str, str], list[str]] = {}
    while front:  # the closure of one word, a round a depth
        got = e.where(F.col("key").isin(sorted(front))).select("dict", "key", "entry_no", "value").orderBy("dict", "key", "entry_no").collect()
        for r in got:
            values.setdefault((r.dict, r.key), []).append(r.value)
        front = {r.value.split(LINK)[1].strip() for r in got if LINK in r.value} - seen
        seen |= front
    out: dict[str, list[str]] = {}
    for name in sorted({d for d, k in values if k == word}):
        shown, result = [word], []
        stack = [iter(values[name, word])]
        while stack:
            v = next(stack[-1], None)
            if v is None:
                stack.pop()
            elif LINK not in v:
                result.append(v)
            elif (to := v.split(LINK)[1].strip()) not in shown:
                shown.append(to)
                stack.append(iter(values.get((name, to), [])))
        out[name] = result
    return out
