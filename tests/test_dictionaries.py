import json
import os
import queue
import time

import pytest

from glossa import cli
from glossa.plans import archive, catalog, dictionary, metadata
from glossa.sources import records, trees
from glossa.streaming import ingest

TEXT = "Ab\nThe definition\r\n line2 </> mid\n</>\n  Key two \r\n\n </> \r\nK3\nv\n\n</>\ntail ignored\n"
ROWS = [(0, "Ab", "The definition\n line2 </> mid"), (1, "Key two", ""), (2, "K3", "v\n")]


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def rows(d):
    return sorted((r.entry_no, r.key, r.value) for r in d.collect())


def test_text_scan(spark, tmp_path):
    assert rows(records.read_text(spark, write(tmp_path / "t.txt", TEXT), "t")) == ROWS
    with pytest.raises(records.InvalidDictionary):
        records.read_text(spark, write(tmp_path / "none.txt", "K\nv\n"), "t").collect()
    with pytest.raises(Exception, match="no key and value lines"):
        records.read_text(spark, write(tmp_path / "short.txt", "K\nv\n</>\nK\n</>\n"), "t").collect()
    with pytest.raises(records.InvalidDictionary, match="empty key"):
        dictionary.compile_text(spark, write(tmp_path / "empty.txt", " \nv\n</>\n"), str(tmp_path / "e.gdict"))


def test_compile_search_recompile_extract(spark, tmp_path):
    d = dictionary.compile_text(spark, write(tmp_path / "t.txt", TEXT + "Ab\nagain\n</>\n".replace("tail", "")), str(tmp_path / "t.gdict"), {"Title": "T", "Unknown": 1})
    assert d and d.is_valid() and not dictionary.Dictionary(spark, str(tmp_path / "nope"))
    assert d.meta()["Title"] == "T" and d.meta()["Record"] == d.key_size() == 4 and "Unknown" not in d.meta() and d.meta()["Stripkey"] is True
    assert d.distinct_key_size() == 4 and d.header()["keys"] == 4
    assert d.contains("Ab") and d.exact_match_search("K3") == ["v\n"] and d.exact_match_search("nope") == []
    assert [r.key for r in d.keys().collect()] == sorted(r.key for r in d.entries.collect())
    out = str(tmp_path / "out.txt")
    d.extract(out)
    back = records.read_text(spark, out, "t")
    assert sorted((r.key, r.value) for r in back.collect()) == sorted((r.key, r.value) for r in d.entries.collect())
    again = dictionary.recompile(spark, str(tmp_path / "t.gdict"), str(tmp_path / "u.gdict"), {"Description": "D"}, 4, 22)
    assert again.meta()["Title"] == "T" and again.meta()["Description"] == "D" and again.meta()["Compressionlevel"] == 22
    assert rows(again.entries) == rows(d.entries)
    d.write_text(str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts")).count() > 4


def test_lists_keep_the_order_of_duplicates(spark, tmp_path):
    d = dictionary.compile_lists(spark, str(tmp_path / "l.gdict"), ["b", "a", "b", "ab"], ["1", "2", "3", "4"])
    assert d.exact_match_search("b") == ["1", "3"] and [r.value for r in d.values().collect()] == ["2", "4", "1", "3"]
    assert [(r.key, r.first_index, r.dup_count) for r in d.enumerate_keys().collect()] == [("a", 0, 0), ("ab", 1, 0), ("b", 2, 1)]
    assert d.common_prefix_search("abc") == ["a", "ab"] and d.longest_prefix_len("abx") == 2 and d.predictive_search("a") == ["a", "ab"]
    assert d.edit_distance_search("ac") == ["a"] and d.prefix_distance_search("abx", 1) == [["ab"], ["a"]]
    assert d.suggest("ab")[0] == (1.0, "ab") and d.spellcheck_word("ab", 1) == ["ab"] and d.regex_search("a.*", 4) == (["a", "ab"], "") and d.regex_search("(")[1]
    with pytest.raises(records.InvalidDictionary, match="unsorted"):
        dictionary.compile_lists(spark, str(tmp_path / "s.gdict"), ["b", "a"], ["1", "2"], already_sorted=True)
    with pytest.raises(records.InvalidDictionary):
        records.from_lists(spark, ["a"], [], "x")


def test_metadata_kinds():
    assert metadata.merge('{"Title": "x"}', metadata.ARCHIVE)["Title"] == "x" and metadata.merge(None, metadata.ARCHIVE) == metadata.ARCHIVE
    for bad in ({"Title": 1}, {"Record": "1"}, {"Stripkey": 1}, [], "nope"):
        with pytest.raises(metadata.InvalidMetadata):
            metadata.merge(bad, metadata.DICTIONARY)


def tree(root):
    (root / "sub dir").mkdir(parents=True)
    own = {"a.bin": b"\0" * 700_000 + b"x", "sub dir/b+c%.txt": "é".encode(), "empty": b"", "_hidden": b"h"}
    for k, v in own.items():
        (root / k).write_bytes(v)
    return own


def test_archive(spark, tmp_path):
    own = tree(tmp_path / "in")
    a = archive.compile_tree(spark, str(tmp_path / "in"), str(tmp_path / "x.gfiles"), {"Title": "A"})
    assert a and a.meta()["Record"] == 4 and a.extract_all_key() == sorted(own) and a.contains("empty") and not a.contains("in/empty")
    assert a.extract_all(str(tmp_path / "out")) and all((tmp_path / "out" / k).read_bytes() == v for k, v in own.items())
    assert a.extract("a.bin", str(tmp_path / "one")) and not a.extract("nope", str(tmp_path / "one")) and not a.extract_if_exists("nope", str(tmp_path / "one"))
    assert sorted(os.listdir(tmp_path / "one")) == ["a.bin"]
    bad = archive.compile_items(spark, [("../evil", b"x"), ("/abs", b"x"), ("ok/f", b"y")], str(tmp_path / "bad.gfiles"))
    assert not bad.extract_all(str(tmp_path / "safe" / "in")) and os.listdir(tmp_path / "safe" / "in") == ["ok"] and not (tmp_path / "safe" / "evil").exists()
    assert not archive.Archive(spark, str(tmp_path / "nope")) and a.header()["files"] == 4
    box = trees.Inbox()
    box.push("p", b"1")
    with pytest.raises(ValueError, match="wanted"):
        box.take(2, 0.1)
    assert box.take(1) == [("p", b"1")]
    for i in range(trees.WAITING):
        box.push(f"p{i}", b"", 1)
    with pytest.raises(queue.Full):  # the producer waits
        box.push("more", b"", 0.1)
    assert [len(x) for x in box.batches(8, 3, 1)] == [3, 3, 2]


def test_catalog(spark, tmp_path):
    home = tmp_path / "d1"
    home.mkdir()
    dictionary.compile_lists(spark, str(home / "d1.gdict"), ["diction", "dictionary", "ant"], ["x", "y", "z"])
    archive.compile_items(spark, [("css/a.css", b"body")], str(home / "d1.gfiles"))
    dictionary.compile_lists(spark, str(tmp_path / "d2.gdict"), ["dictionary", "anthem"], ["2y", "2z"])
    lib = catalog.Library(spark)
    assert lib.insert("one", str(home / "d1.gdict")) and not lib.insert("one", str(home / "d1.gdict")) and not lib.insert("bad", str(tmp_path / "bad")) and lib.insert_if_not_exists("one", "whatever")
    assert lib.insert("two", str(tmp_path / "d2.gdict"))
    both = ["one", "two", "unknown", "one"]
    assert lib.contains("ant", both) and not lib.contains("ant", ["two"])
    assert lib.exact_match_search("dictionary", both) == {"one": ["y"], "two": ["2y"]} and lib.exact_match_search("dictionary", "two") == ["2y"] and lib.exact_match_search("q", "unknown") == []
    assert lib.predictive_search("dict", both) == ["diction", "dictionary"] and lib.common_prefix_search("anthems") == ["ant", "anthem"] and lib.longest_prefix_len("anthz", both) == 4
    assert lib.edit_distance_search("dictionar", both) == ["dictionary"] and lib.suggest("dictionry", both) == ["dictionary", "diction"]
    assert lib.regex_search("dict.*y$", both) == (["dictionary"], "") and lib.regex_search("(", both)[1] and lib.regex_search("(", ["unknown"]) == ([], "")
    lib.insert_prior_suffix(["ary", "ion", "ary"])
    assert lib.prior_suffixes == ["ary", "ion"] and lib.prefix_distance_search("dictiox", both, 2) == ["diction", "dictionary"]
    lib.remove_all_prior_suffix()
    assert lib.prior_suffixes == []
    assert lib.contains_file("css/a.css", "one") and not lib.contains_file("css/a.css", "two")
    assert lib.extract("one", "css/a.css") and (home / "data" / "css" / "a.css").read_bytes() == b"body" and not lib.extract("zzz", "x") and not lib.extract_if_exists("one", "zz", str(tmp_path / "q"))
    assert lib.lookup("ant") == {"one": ["z"]}
    saved = tmp_path / "cat.json"
    lib.save_to_disk(str(saved))
    saved.write_text(json.dumps(json.loads(saved.read_text()) | {"prior_suffix": {"b": ["y"], "a": ["x"]}}))
    again = catalog.Library(spark, str(saved), 2)
    assert again and again.names() == ["one", "two"] and again.prior_suffixes == ["x", "y"]
    again.save_to_disk(str(tmp_path / "cat2.json"))
    assert json.loads((tmp_path / "cat2.json").read_text()) == json.loads(saved.read_text())
    again.erase("one")
    again.resize_thread_pool(3)
    assert again.names() == ["two"] and not catalog.Library(spark, str(tmp_path / "none.json")) and catalog.get_version()
    again.insert_entries("mem", records.from_lists(spark, ["k"], ["v"], "q"))
    assert again.exact_match_search("k") == {"mem": ["v"]}


def test_command_line(spark, tmp_path, capsys):
    text = write(tmp_path / "t.txt", "dictionary\nv1\n</>\ndonary\nv2\n</>\nant\nv3\n</>\n")
    d = str(tmp_path / "t.gdict")
    assert cli.main(["write", "-f", text, "-o", d, "-t", "Title"], spark) == 0

    def run(*args):
        code = cli.main(["search", "-f", d, *args], spark)
        return code, capsys.readouterr().out.split("\n")[:-1]

    assert run("ant") == (0, ["v3"]) and run("zzz")[0] == 1 and run("-p", "d")[1] == ["dictionary", "donary"] and run("-r", "d.*y$")[1] == ["dictionary", "donary"]
    assert run("-e", "1", "dictionar")[1] == ["dictionary"] and run("-c", "ant")[1] == ["true"] and run("--longest-prefix", "dicx")[1] == ["3"]
    assert "Title" in run("-m")[1][0] and len(run("-u")[1]) == 3 and run("-g", "dictionry")[1][0].endswith("dictionary") and run("-s", "donari")[0] == 0 and run("-P", "3", "dictionx")[1] and run("--common-prefix", "ants")[1] == ["ant"]
    out = str(tmp_path / "back.txt")
    assert cli.main(["extract", d, "-o", out], spark) == 0 and "donary\nv2\n</>\n" in open(out).read()
    tree(tmp_path / "in")
    a = str(tmp_path / "x.gfiles")
    assert cli.main(["write", "-f", str(tmp_path / "in"), "-o", a], spark) == 0 and cli.main(["extract", a, "-o", str(tmp_path / "files")], spark) == 0
    assert cli.main(["search", "-f", a, "-c", "empty"], spark) == 0 and cli.main(["write", "-f", str(tmp_path / "missing.txt"), "-o", d + "x"], spark) == 1


def test_streaming(spark, tmp_path):
    own = tree(tmp_path / "in")
    s = ingest.file_stream(spark, str(tmp_path / "in"), "arc", "n", 1)
    ingest.append_to(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.path: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: v for k, v in own.items() if v and k[0] != "_"}  # Spark's streaming source passes empty and hidden files over
    spark.createDataFrame([("the Cat the", "2024-01-01 00:00:00")], "text string, ts string").selectExpr("text", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "texts"))
    src = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "texts"))
    ingest.append_to(ingest.word_stream(src, "n", at="ts"), str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "w")).collect()) == ["cat", "the"]


def test_text_scan_in_many_splits(spark, tmp_path):
    text = "".join(f"key {i}\nline \u0001\n second é {i * 7}\n</>\n" for i in range(60)) + "k\nv\u0001\n </> \ntail"
    path = write(tmp_path / "many.txt", text)
    want = [(i, f"key {i}", f"line \u0001\n second é {i * 7}") for i in range(60)] + [(60, "k", "v\u0001")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert rows(records.read_text(spark, path, "m")) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = spark.createDataFrame([("m", text)], "dict string, value string")
    assert rows(records.parse_text(whole)) == want
    with pytest.raises(Exception, match="no key and value lines in record 1"):
        records.read_text(spark, write(tmp_path / "two.txt", "K\nv\n</>\n</>\n"), "t").collect()


def test_whole_texts_are_parsed_in_linear_time(spark):
    texts = ["", "no delimiter\n", "</", " k \r\nv\r\n\t</> \r\nk2\n\n w \n</>", "k\n</>x\n </> y\n</>\n</ >\n", "k\r\n\n</>\r\n\r\nv\n</>\n</>z", None]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "dict string, value string")
    got = sorted((r["dict"], r.entry_no, r.key, r.value) for r in records.parse_text(d).collect())
    assert got == [("3", 0, "k", "v"), ("3", 1, "k2", "\n w "), ("4", 0, "k", "</>x\n </> y"), ("5", 0, "k", ""), ("5", 1, "", "v")]
    for bad, at in (("</>\n", 0), ("\n</>", 0), ("k\nv\n</>\n</>\n", 1), ("k\nv\n</>\nk\n</>\n", 1)):
        with pytest.raises(Exception, match=f"no key and value lines in record {at} of m"):
            records.parse_text(spark.createDataFrame([("m", bad)], "dict string, value string")).collect()
    # each record used to split the whole text again for each of its lines: minutes for 250 records, a cube of the length
    for n in (250, 20000):
        long = spark.createDataFrame([("m", "".join(f"key {i}\nvalue {i}\n</>\n" for i in range(n)))], "dict string, value string")
        began = time.monotonic()
        assert [r.value for r in records.parse_text(long).orderBy("entry_no").collect()] == [f"value {i}" for i in range(n)]
        assert time.monotonic() - began < 30
