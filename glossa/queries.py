"""The registered queries: every operator over dictionaries made of the driver's tables, with DuckDB SQL for each that has some.

``words``: language -> each run of letters in the lower-cased documents; ``parts``: type -> part name, with its brand as the value;
``links``: nation -> a redirect to its region, region -> a text; ``files``: page url -> html.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import common_prefix_bytes
from .operators import batch, lookup, search
from .plans.durable import numbered, shared_dir
from .sources.records import from_table

LANGUAGES = ["en", "de", "es", "fr"]
SUFFIXES = ["ing", "tion", "ed", "er", "ment", "ción"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries whose keys are the distinct words of each language (one entry a word: its smallest document)."""
    d = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("key"))
    d = d.groupBy("lang", "key").agg(F.min("doc_id").alias("doc_id"))
    return from_table(d, F.col("lang"), F.col("key"), F.col("doc_id").cast("string"), F.col("doc_id"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "part")
    return from_table(d, F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_partkey"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations lead to regions; each region has a text, and one that leads back to itself."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    d = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("no"), F.col("n_name").alias("k"), F.concat(F.lit(lookup.LINK), F.col("r_name")).alias("v"))
    d = d.unionByName(r.select((F.col("r_regionkey") + 1000).cast("long").alias("no"), F.col("r_name").alias("k"), F.concat(F.lit("region "), F.lower("r_name")).alias("v")))
    d = d.unionByName(r.select((F.col("r_regionkey") + 2000).cast("long").alias("no"), F.col("r_name").alias("k"), F.concat(F.lit(lookup.LINK), F.col("r_name")).alias("v")))
    return from_table(d, F.lit("geo"), F.col("k"), F.col("v"), F.col("no"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select(F.lit("web").alias("dict"), F.lit("pages").alias("archive"), F.col("url").alias("path"), F.encode("html", "utf-8").alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def _placed(d: DataFrame, *order) -> DataFrame:
    return numbered(d, *(order or ("key",)))


def _query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts: a table of queries."""
    b = _table(spark, sf_dir, "benchmark")
    return b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WORDS = r"words AS (SELECT lang AS dict, key, min(doc_id) AS entry_no FROM (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS key FROM documents) GROUP BY lang, key)"
_QUERY_WORDS = r"q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark)"
_POS = "CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS pos"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_WORDS} SELECT key, {_POS} FROM (SELECT DISTINCT key FROM words WHERE dict IN ('en', 'de') AND starts_with(key, 'th'))")
def predictive_search(spark, sf_dir):
    return _placed(search.predictive_search(words(spark, sf_dir), "th", ["en", "de"]))


@query(f"WITH {_WORDS} SELECT key, {_POS} FROM (SELECT DISTINCT key FROM words WHERE starts_with('thereisonerer', key))")
def common_prefix_search(spark, sf_dir):
    return _placed(search.common_prefix_search(words(spark, sf_dir), "thereisonerer", LANGUAGES))


def _longest_sql(q: str) -> str:
    hexed = q.encode().hex().upper()
    cases = " + ".join(f"(CASE WHEN starts_with(h, '{hexed[: 2 * i]}') THEN 1 ELSE 0 END)" for i in range(1, len(q.encode()) + 1))
    return f"WITH {_WORDS}, h AS (SELECT dict, hex(encode(key)) AS h FROM words) SELECT dict, CAST(max({cases}) AS BIGINT) AS longest FROM h GROUP BY dict"


@query(_longest_sql("éreauxtion"))
def longest_prefix_len(spark, sf_dir):
    """In each dictionary: the keys just before and after the query decide, in one aggregate."""
    k, q = F.col("key"), "éreauxtion"
    d = words(spark, sf_dir).groupBy("dict").agg(F.max(F.when(k <= q, k)).alias("a"), F.min(F.when(k >= q, k)).alias("b"))
    shared = lambda c: F.coalesce(common_prefix_bytes(F.col(c), F.lit(q)), F.lit(0))
    return d.select("dict", F.greatest(shared("a"), shared("b")).cast("long").alias("longest"))


def _indel_ctes(q: str, insert: int = 1, delete: int = 1, replace: int = 2) -> str:
    """d(key, distance): the distance table unrolled to a column a letter of the query, over the letters of each word."""
    n = len(q)
    start = ", ".join(f"{i} AS d{i}" for i in range(n + 1))
    lit = [c.replace("'", "''") for c in q]
    source = ", ".join(f"d{i}" for i in range(n + 1))
    steps = f"SELECT key, i + 1 AS i, substr(key, i + 1, 1) AS c, {source}, d0 + 1 AS e0 FROM dp WHERE i < length(key)"
    for j in range(1, n + 1):
        steps = f"SELECT *, least(e{j - 1} + {insert}, d{j} + {delete}, d{j - 1} + CASE WHEN c = '{lit[j - 1]}' THEN 0 ELSE {replace} END) AS e{j} FROM ({steps})"
    out = ", ".join(f"e{i} AS d{i}" for i in range(n + 1))
    return f"dp AS (SELECT key, 0 AS i, {start} FROM cand UNION ALL SELECT key, i, {out} FROM ({steps})), d AS (SELECT key, d{n} AS distance FROM dp WHERE i = length(key))"


def _edit_sql(q: str, k: int, names: str = "") -> str:
    return f"WITH RECURSIVE {_WORDS}, cand AS (SELECT DISTINCT key FROM words WHERE length(key) BETWEEN {len(q) - k} AND {len(q) + k} {names}), {_indel_ctes(q)} SELECT key, {_POS} FROM d WHERE distance <= {k}"


@query(_edit_sql("thereing", 3))
def edit_distance_search(spark, sf_dir):
    return _placed(search.edit_distance_search(words(spark, sf_dir), "thereing", 3, LANGUAGES))


@query(_edit_sql("there", 1, "AND dict IN ('en', 'de')"))
def edit_distance_search_1(spark, sf_dir):
    return _placed(search.edit_distance_search(words(spark, sf_dir), "there", 1, ["en", "de", "unknown"]))


def _prefix_distance_sql(q: str, m: int) -> str:
    cp = " + ".join(f"(CASE WHEN starts_with(key, '{q[:i]}') THEN 1 ELSE 0 END)" for i in range(1, len(q) + 1))
    by = sorted(enumerate(SUFFIXES), key=lambda x: (-len(x[1].encode()), x[0]))
    rank = "CASE " + " ".join(f"WHEN suffix(key, '{s}') THEN {r}" for r, s in by) + " END"
    size = "CASE " + " ".join(f"WHEN suffix(key, '{s}') THEN {len(s)}" for _, s in by) + " ELSE 0 END"
    return f"""WITH {_WORDS}, c AS (SELECT key, {cp} AS c FROM (SELECT DISTINCT key FROM words WHERE dict IN ('en', 'fr'))),
l AS (SELECT max(c) AS m FROM c), r AS (SELECT key, length(key) - c AS p, l.m - c + length(key) - c AS real FROM c, l WHERE c >= 1),
x AS (SELECT key, CAST(CASE WHEN p = 0 THEN real ELSE greatest(0, real - {size}) END AS INTEGER) AS distance, CAST({rank} AS INTEGER) AS suffix_rank FROM r)
SELECT key, distance, suffix_rank, CAST(row_number() OVER (ORDER BY distance, suffix_rank NULLS LAST, strlen(key) DESC, key) AS BIGINT) AS pos FROM x WHERE distance <= {m}"""


@query(_prefix_distance_sql("thereonly", 3))
def prefix_distance_search(spark, sf_dir):
    d = search.prefix_distance_search(words(spark, sf_dir), "thereonly", 3, ["en", "fr"], SUFFIXES)
    return _placed(d, "distance", F.col("suffix_rank").asc_nulls_last(), F.octet_length("key").desc(), "key")


@query(f"WITH {_WORDS} SELECT key, {_POS} FROM (SELECT DISTINCT key FROM words WHERE regexp_matches(key, '^(?:th.*ing(ly)?$)'))")
def regex_search(spark, sf_dir):
    return _placed(search.regex_search(words(spark, sf_dir), "th.*ing(ly)?$", LANGUAGES)[0])


@query(f"WITH {_WORDS} SELECT key, {_POS} FROM (SELECT DISTINCT key FROM words WHERE regexp_matches(key, '^(?:[a-d]{{2}}.*é)'))")
def regex_search_prefix(spark, sf_dir):
    return _placed(search.regex_search(words(spark, sf_dir), "[a-d]{2}.*é", LANGUAGES)[0])


def _score_ctes(q: str, source: str) -> str:
    """jaro, jaro_winkler, sound and score of each key of a relation against a word, byte by byte: tables unrolled to a column a byte of the word."""
    h = [f"{b:02X}" for b in q.encode()]
    n = len(h)
    a = "[" + ", ".join(f"'{x}'" for x in h) + "]"
    alike = {frozenset(p) for p in ("ao", "ae", "iy", "ou")}
    pairs = {(x, y) for x, y in (("ir", "er"), ("ur", "er"), ("ir", "ur"), ("er", "ar"))} | {(y, x) for x, y in (("ir", "er"), ("ur", "er"), ("ir", "ur"), ("er", "ar"))}
    hexed = lambda t: t.encode().hex().upper()
    steps = f"SELECT *, i + 1 AS ni, b[i + 1] AS c, b[i + 2] AS c2, CASE WHEN i + 2 <= len(b) AND b[i + 1] = b[i + 2] THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS g, d0 + 1 AS e0 FROM sd WHERE i < len(b)"
    for j in range(n):
        shrink = "0.5::DOUBLE" if j + 1 < n and h[j] == h[j + 1] else "1.0::DOUBLE"
        near = [hexed(next(iter(p - {chr(int(h[j], 16))}))) for p in alike if chr(int(h[j], 16)) in p]
        swap = f"CASE WHEN c = '{h[j]}' THEN 0.0::DOUBLE"
        if near:
            swap += f" WHEN c IN ({', '.join(repr(x) for x in near)}) THEN 0.25::DOUBLE"
        if j + 1 < n:
            turned = [h[j + 1] + h[j]] + [hexed(y) for x, y in pairs if hexed(x) == h[j] + h[j + 1]]
            swap += f" WHEN c2 IS NOT NULL AND c || c2 IN ({', '.join(repr(x) for x in turned)}) THEN 0.0::DOUBLE"
        steps = f"SELECT *, least(e{j} + g, d{j + 1} + {shrink}, d{j} + {swap} ELSE 1.0::DOUBLE END) AS e{j + 1} FROM ({steps})"
    start, out = ", ".join(f"{j}.0::DOUBLE AS d{j}" for j in range(n + 1)), ", ".join(f"e{j} AS d{j}" for j in range(n + 1))
    reach = f"greatest(greatest({n}, len(b)) // 2 - 1, 0)"
    same = " + ".join(f"(CASE WHEN starts_with(h, '{''.join(h[:j])}') THEN 1 ELSE 0 END)" for j in range(1, n + 1))
    return f"""hx AS (SELECT key, hex(encode(key)) AS h FROM {source}),
bt AS (SELECT key, h, list_transform(range(1, length(h), 2), lambda i: substr(h, CAST(i AS INTEGER), 2)) AS b FROM hx),
sd AS (SELECT key, b, 0 AS i, {start} FROM bt UNION ALL SELECT key, b, ni, {out} FROM ({steps})),
snd AS (SELECT key, 1.0::DOUBLE - d{n} / greatest({n}, len(b)) AS sound FROM sd WHERE i = len(b)),
sh AS (SELECT key, h, b, list_filter({a}, lambda x, i: list_contains(b[CAST(greatest(1, i - {reach}) AS BIGINT) : CAST(i + {reach} AS BIGINT)], x)) AS p,
       list_filter(b, lambda x, i: list_contains({a}[CAST(greatest(1, i - {reach}) AS BIGINT) : CAST(i + {reach} AS BIGINT)], x)) AS r, {same} AS same FROM bt),
ja AS (SELECT key, same, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0::DOUBLE ELSE (CAST(len(p) AS DOUBLE) / {n} + CAST(len(p) AS DOUBLE) / len(b)
       + (CAST(len(p) AS DOUBLE) - len(list_filter(range(1, least(len(p), len(r)) + 1), lambda i: p[i] <> r[i])) / 2.0::DOUBLE) / CAST(len(p) AS DOUBLE)) / 3 END AS jaro FROM sh),
jw AS (SELECT key, jaro, CASE WHEN jaro = 0 THEN 0.0::DOUBLE ELSE jaro + same * 0.1::DOUBLE * (1.0::DOUBLE - jaro) END AS jaro_winkler FROM ja),
sc AS (SELECT key, jaro, jaro_winkler, sound, CASE WHEN key = '{q}' THEN 1.0::DOUBLE ELSE jaro_winkler * sound END AS score FROM jw JOIN snd USING (key))"""


def _suggest_sql(q: str, names: str, select: str) -> str:
    """Words of each dictionary at its least tier, scored."""
    return f"""WITH RECURSIVE {_WORDS}, cand AS (SELECT DISTINCT key FROM words WHERE length(key) BETWEEN {len(q) - 3} AND {len(q) + 3} {names}), {_indel_ctes(q)},
ti AS (SELECT dict, key, greatest(distance, 2) AS tier FROM d JOIN words USING (key) WHERE distance <= 3 {names}),
bst AS (SELECT DISTINCT key FROM ti JOIN (SELECT dict, min(tier) AS tier FROM ti GROUP BY dict) USING (dict, tier)), {_score_ctes(q, "bst")} {select}"""


_SUGGESTED = "SELECT key, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, key) AS BIGINT) AS pos FROM sc"


@query(_suggest_sql("thereng", "", _SUGGESTED))
def suggest(spark, sf_dir):
    d = search.suggestions(words(spark, sf_dir), "thereng", LANGUAGES)
    return _placed(d.withColumn("score", F.round("score", 9)), F.desc("score"), "key")


@query(_suggest_sql("oneringly", "AND dict IN ('en')", "SELECT key, score FROM sc ORDER BY score DESC, key LIMIT 10"))
def spellcheck_word(spark, sf_dir):
    return search.spellcheck(words(spark, sf_dir), "oneringly", 10, ["en"])


@query(f"WITH {_WORDS}, {_QUERY_WORDS} SELECT word FROM q WHERE word IN (SELECT key FROM words WHERE dict IN ('en', 'fr'))")
def contains_many(spark, sf_dir):
    return lookup.contains_many(words(spark, sf_dir), _query_words(spark, sf_dir), ["en", "fr"])


@query(f"WITH {_WORDS}, {_QUERY_WORDS} SELECT word FROM q WHERE word NOT IN (SELECT key FROM words WHERE dict IN ('es'))")
def missing_words(spark, sf_dir):
    return lookup.missing(words(spark, sf_dir), _query_words(spark, sf_dir), ["es"])


@query(f"WITH {_WORDS}, {_QUERY_WORDS} SELECT word, dict, entry_no, CAST(entry_no AS VARCHAR) AS value FROM q JOIN words ON key = word")
def exact_match_many(spark, sf_dir):
    return lookup.exact_match_many(words(spark, sf_dir), _query_words(spark, sf_dir))


@query(f"WITH {_WORDS}, {_QUERY_WORDS}, p AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, CAST(i AS INTEGER)))) AS key FROM q) SELECT DISTINCT word, key FROM p JOIN words USING (key)")
def common_prefix_join(spark, sf_dir):
    return batch.common_prefix_join(words(spark, sf_dir), _query_words(spark, sf_dir))


@query("WITH q AS (SELECT DISTINCT r_name AS word FROM region UNION SELECT DISTINCT substr(n_name, 1, 2) FROM nation) SELECT DISTINCT word, n_name AS key FROM q JOIN (SELECT n_name FROM nation UNION SELECT r_name FROM region) ON word <> '' AND starts_with(n_name, word)")
def predictive_join(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    q = r.select(F.col("r_name").alias("word")).union(n.select(F.substring("n_name", 1, 2)))
    return batch.predictive_join(links(spark, sf_dir), q)


def _cut(table: str, word: str) -> str:
    """Each word with what is left of it after at most one deletion."""
    return f"(SELECT {word}, {word} AS v, 0 AS n FROM {table} UNION SELECT {word}, substr({word}, 1, CAST(i AS INTEGER) - 1) || substr({word}, CAST(i AS INTEGER) + 1), 1 FROM (SELECT {word}, unnest(range(1, length({word}) + 1)) AS i FROM {table}))"


@query(f"WITH {_WORDS}, {_QUERY_WORDS}, k AS (SELECT DISTINCT key FROM words WHERE dict = 'en'), a AS {_cut('q', 'word')}, b AS {_cut('k', 'key')} SELECT word, key, CAST(min(a.n + b.n) AS INTEGER) AS distance FROM a JOIN b USING (v) WHERE a.n + b.n <= 1 GROUP BY word, key")
def edit_distance_join(spark, sf_dir):
    return batch.edit_distance_join(words(spark, sf_dir), _query_words(spark, sf_dir), 1, ["en"])


@query("SELECT p_type AS dict, list(p_brand ORDER BY p_partkey) AS \"values\" FROM part WHERE p_name = (SELECT min(p_name) FROM part) GROUP BY p_type")
def exact_match_lists(spark, sf_dir):
    p = parts(spark, sf_dir)
    word = p.agg(F.min("key")).first()[0]
    return lookup.exact_match_lists(p, word)


@query("SELECT p_type AS dict, CAST(p_partkey AS BIGINT) AS entry_no, p_brand AS value FROM part WHERE p_name = (SELECT max(p_name) FROM part)")
def exact_match(spark, sf_dir):
    p = parts(spark, sf_dir)
    return lookup.exact_match(p, p.agg(F.max("key")).first()[0])


@query("""WITH n AS (SELECT p_type AS dict, p_name AS key, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) - 1 AS i FROM part)
SELECT dict, key, CAST(min(i) AS BIGINT) AS first_index, CAST(count(*) - 1 AS BIGINT) AS dup_count, CAST((count(*) - 1) * 4294967296 + min(i) AS BIGINT) AS code FROM n GROUP BY dict, key""")
def key_codes(spark, sf_dir):
    return lookup.key_codes(parts(spark, sf_dir))


@query("SELECT p_type AS dict, CAST(row_number() OVER (ORDER BY p_type, p_name, p_partkey) AS BIGINT) AS pos, p_name AS key, p_brand AS value FROM part")
def extract_entries(spark, sf_dir):
    return numbered(parts(spark, sf_dir), "dict", "key", "entry_no").select("dict", "pos", "key", "value")


@query("SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT (p_type, p_name)) AS BIGINT) AS keys FROM part")
def key_sizes(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("dict", "key").count().agg(F.sum("count").alias("entries"), F.count("*").alias("keys"))


@query("""WITH RECURSIVE e AS (SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS entry_no, '@@@LINK=' || r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, CAST(r_regionkey + 1000 AS BIGINT), 'region ' || lower(r_name) FROM region UNION ALL SELECT r_name, CAST(r_regionkey + 2000 AS BIGINT), '@@@LINK=' || r_name FROM region),
w AS (SELECT DISTINCT key AS start, key FROM e UNION SELECT start, trim(string_split(value, '@@@LINK=')[2]) FROM w JOIN e USING (key) WHERE contains(value, '@@@LINK='))
SELECT 'geo' AS dict, start, key, entry_no, value FROM w JOIN e USING (key) WHERE NOT contains(value, '@@@LINK=')""")
def resolve_links(spark, sf_dir):
    e = links(spark, sf_dir)
    return lookup.resolve(e, e.select(F.col("key").alias("start")).distinct())


@query("SELECT url AS path, CAST(row_number() OVER (ORDER BY url) AS BIGINT) AS pos FROM pages")
def archive_keys(spark, sf_dir):
    return numbered(files(spark, sf_dir).select("path"), "path")


@query("SELECT 'pages' AS archive, url AS path, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS sha FROM pages")
def archive_files(spark, sf_dir):
    """Compiled to Parquet in the shared folder and read back."""
    from .plans.archive import write_files

    a = write_files(spark, files(spark, sf_dir), shared_dir(spark, "web") + ".gfiles")
    return a.files.select("archive", "path", "length", F.sha2("content", 256).alias("sha"))


@query("SELECT p_name AS key, p_brand AS value, p_type AS dict FROM part")
def compiled_dictionary(spark, sf_dir):
    """Compiled to sorted Parquet and read back."""
    from .plans.dictionary import write_entries

    path = shared_dir(spark, "parts") + ".gdict"
    write_entries(parts(spark, sf_dir), path)
    return spark.read.parquet(path).select("dict", "key", "value")


@query("SELECT p_name AS key, p_brand AS value FROM part")
def text_round_trip(spark, sf_dir):
    """One raw text per type, parsed again."""
    from .sources.records import parse_text

    p = parts(spark, sf_dir)
    records = F.concat_ws("\n", "key", "value", F.lit("</>"))
    # texts of a hundred part numbers each, so that none grows with the table
    texts = p.groupBy("dict", F.floor(F.col("entry_no") / 100).alias("b")).agg(F.concat(F.array_join(F.collect_list(records), "\n"), F.lit("\n")).alias("value"))
    return parse_text(texts).select("key", "value")


@query("SELECT event_type AS path, count(*) AS n FROM events GROUP BY event_type")
def streamed_events(spark, sf_dir):
    """Rows that a stream appended, counted."""
    from .streaming.ingest import append_to

    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    out = shared_dir(spark, "stream")
    append_to(source.select(F.col("event_type").alias("path")), f"{out}/data", f"{out}/offsets").awaitTermination()
    return spark.read.schema("path string").parquet(f"{out}/data").groupBy("path").agg(F.count("*").alias("n"))


# ---- compiled dictionaries, archives, the catalog and the command line, as their callers use them


def _compiled(spark, sf_dir, entries: DataFrame, name: str, **how):
    from .plans import metadata
    from .plans.dictionary import Dictionary, write_entries

    path = f"{shared_dir(spark, name)}/{name}.gdict"
    write_entries(entries, path, **how)
    metadata.save(path, metadata.stamp(metadata.merge({"Title": name}, metadata.DICTIONARY), spark.read.parquet(path).count(), how.get("level", 5), True))
    return Dictionary(spark, path)


def _rows(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_PROBES = ["there", "thereing", "notaword", ""]


@query(f"WITH {_WORDS} SELECT w AS word, w <> '' AND EXISTS (SELECT 1 FROM words WHERE key = w) AS found FROM (SELECT unnest({_PROBES}) AS w)")
def contains_word(spark, sf_dir):
    e = words(spark, sf_dir)
    return _rows(spark, [(w, lookup.contains(e, w)) for w in _PROBES], "word string, found boolean")


@query("SELECT p_type AS dict, arg_min(p_brand, p_partkey) AS value FROM part WHERE p_name = (SELECT max(p_name) FROM part) GROUP BY p_type")
def first_values(spark, sf_dir):
    e = parts(spark, sf_dir)
    word = e.agg(F.max("key")).first()[0]
    names = [r["dict"] for r in lookup.exact_match_lists(e, word).collect()]
    return _rows(spark, [(n, lookup.value_at(e, word, n)) for n in names], "dict string, value string")


@query("SELECT 'geo' AS dict, ['region ' || lower(r_name)] AS \"values\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def lookup_word(spark, sf_dir):
    """One word with its redirects replaced in place."""
    e = links(spark, sf_dir)
    word = _table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return _rows(spark, list(lookup.lookup(e, word).items()), "dict string, values array<string>")


@query(_longest_sql("thereonlyx"))
def longest_prefix_of_dictionaries(spark, sf_dir):
    e = words(spark, sf_dir)
    return _rows(spark, [(n, search.longest_prefix_len(e, "thereonlyx", [n])) for n in LANGUAGES], "dict string, longest long")


@query(f"WITH {_WORDS} SELECT dict, CAST(coalesce(max(strlen(key)) FILTER (starts_with('thereisonerer', key)), 0) AS BIGINT) AS longest FROM words GROUP BY dict")
def longest_key_prefix_len(spark, sf_dir):
    e = words(spark, sf_dir)
    return _rows(spark, [(n, search.longest_key_prefix_len(e, "thereisonerer", [n])) for n in LANGUAGES], "dict string, longest long")


@query(f"WITH RECURSIVE {_WORDS}, cand AS (SELECT DISTINCT key FROM words WHERE length(key) BETWEEN 2 AND 8), {_indel_ctes('there', 2, 1, 2)} SELECT key, {_POS} FROM d WHERE distance <= 3")
def weighted_edit_distance_search(spark, sf_dir):
    return _placed(search.edit_distance_search(words(spark, sf_dir), "there", 3, LANGUAGES, 2, 1, 2))


@query(f"WITH RECURSIVE {_WORDS}, k AS (SELECT DISTINCT key FROM words WHERE dict = 'de'), {_score_ctes('ersteine', 'k')} SELECT key, round(jaro, 9) AS jaro, round(jaro_winkler, 9) AS jaro_winkler, round(sound, 9) AS sound, round(score, 9) AS score FROM sc")
def spelling_scores(spark, sf_dir):
    d = search.scores(words(spark, sf_dir), "ersteine", ["de"])
    return d.select("key", *(F.round(c, 9).alias(c) for c in ("jaro", "jaro_winkler", "sound", "score")))


@query(f"WITH RECURSIVE {_WORDS}, q AS (SELECT 'thereng' AS w), cand AS (SELECT DISTINCT key FROM words WHERE length(key) BETWEEN 4 AND 10), {_indel_ctes('thereng')}, ti AS (SELECT dict, key, greatest(distance, 2) AS tier FROM d JOIN words USING (key) WHERE distance <= 3), bst AS (SELECT DISTINCT key FROM ti JOIN (SELECT dict, min(tier) AS tier FROM ti GROUP BY dict) USING (dict, tier)), {_score_ctes('thereng', 'bst')} SELECT 'thereng' AS word, key, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, key) AS INTEGER) AS rank FROM sc ORDER BY score DESC, key LIMIT 10")
def suggest_join(spark, sf_dir):
    """The table form, for a table of one word: what it gives is what the single search gives."""
    d = batch.suggest_join(words(spark, sf_dir), _rows(spark, [("thereng",)], "word string"))
    return d.withColumn("score", F.round("score", 9))


@query(r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS codepoints, CAST(strlen(text) AS INTEGER) AS bytes, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS trimmed,
md5(replace(text, chr(10), chr(13) || chr(10))) AS crlf, ends_with(text, '.') AS ended, CASE WHEN starts_with(text, 'Th') THEN 2 WHEN starts_with(text, 'T') THEN 1 ELSE 0 END AS shared FROM documents WHERE text IS NOT NULL""")
def text_functions(spark, sf_dir):
    from .functions import text as T

    t = F.col("text")
    d = _table(spark, sf_dir, "documents").where(t.isNotNull())
    return d.select("doc_id", T.codepoint_count(t).alias("codepoints"), T.byte_count(t).alias("bytes"), F.md5(T.trim_whitespace(t)).alias("trimmed"), F.md5(T.lf_to_crlf(t)).alias("crlf"), T.ends_with(t, ".").alias("ended"), T.common_prefix(t, "Th").alias("shared"))


@query("SELECT p_partkey, string_split(p_name, '') AS letters FROM part WHERE p_name <> ''")
def letters_of_names(spark, sf_dir):
    from .functions.text import codepoints

    return _table(spark, sf_dir, "part").where("p_name <> ''").select("p_partkey", codepoints(F.col("p_name")).alias("letters"))


@query("SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT p_name) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS record, 'parts' AS title FROM part")
def dictionary_header(spark, sf_dir):
    """Sizes and metadata of a compiled dictionary."""
    h = _compiled(spark, sf_dir, parts(spark, sf_dir), "parts").header()
    return _rows(spark, [(h["entries"], h["keys"], h["meta"]["Record"], h["meta"]["Title"])], "entries long, keys long, record long, title string")


@query("SELECT CAST(row_number() OVER (ORDER BY p_name, p_partkey) AS BIGINT) AS pos, p_name AS key, p_brand AS value FROM part")
def dictionary_keys_and_values(spark, sf_dir):
    """The keys and the values of a compiled dictionary, each in stored order, put side by side by their places."""
    one = parts(spark, sf_dir).withColumn("dict", F.lit("all"))
    d = _compiled(spark, sf_dir, one, "all")
    placed = lambda x, c: numbered(x.select(c).withColumn("_n", F.monotonically_increasing_id()), "_n").select("pos", c)
    return placed(d.keys(), "key").join(placed(d.values(), "value"), "pos")


@query("WITH n AS (SELECT p_name AS key, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS i FROM part) SELECT key, CAST(min(i) AS BIGINT) AS first_index, CAST(count(*) - 1 AS BIGINT) AS dup_count, CAST((count(*) - 1) * 4294967296 + min(i) AS BIGINT) AS code FROM n GROUP BY key")
def dictionary_enumerated(spark, sf_dir):
    return _compiled(spark, sf_dir, parts(spark, sf_dir).withColumn("dict", F.lit("all")), "all").enumerate_keys()


@query("SELECT p_name AS key, p_brand AS value FROM part")
def recompiled_dictionary(spark, sf_dir):
    from .plans.dictionary import recompile

    d = _compiled(spark, sf_dir, parts(spark, sf_dir).withColumn("dict", F.lit("all")), "all")
    return recompile(spark, d.path, f"{shared_dir(spark, 'again')}/again.gdict", {"Description": "again"}, 4, 9).entries.select("key", "value")


@query("SELECT p_name AS key, p_brand AS value FROM part")
def extracted_text(spark, sf_dir):
    """A compiled dictionary written as one raw text with CRLF, and that scanned again."""
    from .plans.durable import filesystem
    from .sources.records import read_text

    d = _compiled(spark, sf_dir, parts(spark, sf_dir).withColumn("dict", F.lit("all")), "all")
    folder = shared_dir(spark, "text")
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    d.extract(f"{folder}/all.txt", crlf=True)
    return read_text(spark, f"{folder}/all.txt", "all").select("key", "value")


@query("SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([p_name, p_brand, '</>']) AS line FROM part) GROUP BY line")
def extracted_text_files(spark, sf_dir):
    """The same by many tasks: how often each line occurs in the files."""
    folder = shared_dir(spark, "texts")
    _compiled(spark, sf_dir, parts(spark, sf_dir), "parts").write_text(folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("""SELECT 'whole' AS entries, count(*) FILTER (p_name IS NULL OR p_name = '') = 0 AS valid FROM part
UNION ALL SELECT 'one empty', false UNION ALL SELECT 'sorted', true
UNION ALL SELECT 'unsorted', count(*) FILTER (n < p_name) = 0 FROM (SELECT p_name, lead(p_name) OVER (ORDER BY p_partkey) AS n FROM part)""")
def checked_entries(spark, sf_dir):
    from .plans.dictionary import check_entries
    from .sources.records import InvalidDictionary

    e = parts(spark, sf_dir).withColumn("dict", F.lit("all"))
    first = e.agg(F.min("entry_no")).first()[0]
    order = numbered(e.drop("entry_no"), "key", "value", name="entry_no")
    cases = {"whole": (e, False), "one empty": (e.withColumn("key", F.when(F.col("entry_no") == first, "").otherwise(F.col("key"))), False), "sorted": (order, True), "unsorted": (e, True)}

    def valid(d: DataFrame, already_sorted: bool) -> bool:
        try:
            check_entries(d, already_sorted)
        except InvalidDictionary:
            return False
        return True

    return _rows(spark, [(k, valid(*c)) for k, c in cases.items()], "entries string, valid boolean")


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def entries_of_lists(spark, sf_dir):
    """Parallel lists of a table of 25 rows, compiled."""
    from .plans.dictionary import compile_lists

    n = _table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string")).collect()
    return compile_lists(spark, f"{shared_dir(spark, 'lists')}/lists.gdict", [r[0] for r in n], [r[1] for r in n]).entries.select("key", "value")


def _site(spark, sf_dir) -> DataFrame:
    """Pages as files of a tree."""
    p = _table(spark, sf_dir, "pages")
    return p.select(F.lit("web").alias("dict"), F.lit("site").alias("archive"), F.format_string("site/%d/%d.html", F.pmod("page_id", F.lit(10)), "page_id").alias("path"), F.encode("html", "utf-8").alias("content")).withColumn("length", F.octet_length("content").cast("long"))


_PATH = "'site/' || (page_id % 10) || '/' || page_id || '.html'"


@query(f"SELECT {_PATH} AS path, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS sha FROM pages")
def extracted_files(spark, sf_dir):
    """An archive extracted into a folder, and that read as a tree."""
    from .plans.archive import write_files
    from .sources.trees import read_tree

    folder = shared_dir(spark, "tree")
    if not write_files(spark, _site(spark, sf_dir), f"{shared_dir(spark, 'site')}/site.gfiles").extract_all(folder):
        raise ValueError("a file was not written")
    return read_tree(spark, folder, "site", "web").select("path", "length", F.sha2("content", 256).alias("sha"))


@query(f"SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS pos FROM (SELECT {_PATH} AS path FROM pages)")
def compiled_tree(spark, sf_dir):
    """A folder compiled to an archive, and its keys in order."""
    from .plans.archive import compile_tree, extract_files, keys

    folder = shared_dir(spark, "tree")
    extract_files(_site(spark, sf_dir), folder).count()
    return numbered(keys(compile_tree(spark, folder, f"{shared_dir(spark, 'site')}/site.gfiles").files), "path")


@query("SELECT n_name || '.txt' AS path, CAST(strlen(n_name) AS BIGINT) AS length, sha256(lower(n_name)) AS sha FROM nation")
def pushed_files(spark, sf_dir):
    """Files that a producer pushes, a thread filling the inbox while it is emptied."""
    from threading import Thread

    from .plans.archive import compile_pushed
    from .sources.trees import Inbox

    rows = _table(spark, sf_dir, "nation").select("n_name", F.lower("n_name").alias("text")).collect()
    inbox = Inbox()
    pushing = Thread(target=lambda: [inbox.push(f"{r.n_name}.txt", r.text.encode()) for r in rows], daemon=True)
    pushing.start()
    a = compile_pushed(spark, inbox, len(rows), f"{shared_dir(spark, 'pushed')}/pushed.gfiles")
    return a.files.select("path", "length", F.sha2("content", 256).alias("sha"))


def _library(spark, sf_dir):
    """Two dictionaries in one folder with an archive beside them."""
    from .plans.archive import write_files
    from .plans.catalog import Library
    from .plans.dictionary import write_entries

    folder = shared_dir(spark, "library")
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    write_entries(from_table(n, F.lit("nations"), F.col("n_name"), F.lower("n_name"), F.col("n_nationkey")), f"{folder}/nations.gdict")
    write_entries(from_table(r, F.lit("regions"), F.col("r_name"), F.lower("r_name"), F.col("r_regionkey")), f"{folder}/regions.gdict")
    write_files(spark, _site(spark, sf_dir), f"{folder}/site.gfiles")
    lib = Library(spark)
    if not (lib.insert("nations", f"{folder}/nations.gdict") and lib.insert_if_not_exists("regions", f"{folder}/regions.gdict")) or lib.insert("nations", f"{folder}/regions.gdict"):
        raise ValueError("the catalog took a wrong dictionary, or not a right one")
    return lib, folder


@query("SELECT 'nations' AS dict, n_name AS key, lower(n_name) AS value FROM nation UNION ALL SELECT 'regions', r_name, lower(r_name) FROM region")
def catalog_entries(spark, sf_dir):
    """Saved, loaded, a dictionary erased and inserted again: what is searched."""
    from .plans.catalog import Library

    lib, folder = _library(spark, sf_dir)
    lib.save_to_disk(f"{folder}/catalog.json")
    again = Library(spark, f"{folder}/catalog.json")
    again.erase("regions")
    again.insert("regions", f"{folder}/regions.gdict")
    if not again.is_valid() or again.names() != ["nations", "regions"]:
        raise ValueError("the catalog did not come back")
    return again.entries().select("dict", "key", "value")


_SHARED = " + ".join(f"(CASE WHEN starts_with(key, '{'NATION_2'[:i]}') THEN 1 ELSE 0 END)" for i in range(1, 9))


@query(f"""WITH k AS (SELECT n_name AS key FROM nation UNION SELECT r_name FROM region), c AS (SELECT key, {_SHARED} AS c FROM k), l AS (SELECT max(c) AS m FROM c),
r AS (SELECT key, length(key) - c AS p, m - c + length(key) - c AS d, CASE WHEN suffix(key, '14') THEN 2 WHEN suffix(key, '0') THEN 1 ELSE 0 END AS n, CASE WHEN suffix(key, '14') THEN 1 WHEN suffix(key, '0') THEN 0 END AS rank FROM c, l WHERE c >= 1),
x AS (SELECT key, rank, CASE WHEN p = 0 THEN d ELSE greatest(0, d - n) END AS distance FROM r) SELECT key, CAST(row_number() OVER (ORDER BY distance, rank NULLS LAST, strlen(key) DESC, key) AS BIGINT) AS pos FROM x WHERE distance <= 2""")
def catalog_prefix_distance_search(spark, sf_dir):
    """Over all dictionaries, with prior suffixes of the catalog that count as the end of a word."""
    lib, _ = _library(spark, sf_dir)
    lib.insert_prior_suffix(["X"])
    lib.remove_all_prior_suffix()
    lib.insert_prior_suffix(["0", "14", "0"])
    return _rows(spark, [(k, i) for i, k in enumerate(lib.prefix_distance_search("NATION_2", None, 2), 1)], "key string, pos long")


@query(f"SELECT p AS path, EXISTS (SELECT 1 FROM pages WHERE {_PATH} = p) AS found, EXISTS (SELECT 1 FROM pages WHERE {_PATH} = p) AS written FROM (SELECT min({_PATH}) AS p FROM pages UNION ALL SELECT max({_PATH}) FROM pages UNION ALL SELECT 'site/none.html' UNION ALL SELECT '../up.html')")
def catalog_files(spark, sf_dir):
    """Files of the archives beside a dictionary: asked for, and extracted one by one."""
    lib, folder = _library(spark, sf_dir)
    lo, hi = _site(spark, sf_dir).agg(F.min("path"), F.max("path")).first()
    return _rows(spark, [(p, lib.contains_file(p, "nations"), lib.extract_if_exists("nations", p, f"{folder}/out")) for p in (lo, hi, "site/none.html", "../up.html")], "path string, found boolean, written boolean")


@query("SELECT n_name AS line, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS pos FROM nation WHERE starts_with(n_name, 'NATION_1')")
def command_line_search(spark, sf_dir):
    from . import cli

    _, folder = _library(spark, sf_dir)
    a = cli.parser().parse_args(["search", "NATION_1", "-p", "-f", f"{folder}/nations.gdict"])
    return _rows(spark, [(x, i) for i, x in enumerate(cli.run_search(spark, a), 1)], "line string, pos long")
