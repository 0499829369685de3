import json

import pytest
from pyspark.sql import functions as F

from stratalog.operators import audit, chunk
from stratalog.sources import export, writers


def test_inputs_are_found_once_and_an_explicit_path_wins(spark, tmp_path):
    for n in ("conversations-2.json", "conversations-1.json", "b.zip", "notes.txt", "conversations.csv"):
        (tmp_path / n).write_text("[]")
    names = [p.rsplit("/", 1)[-1] for p in export.discover_inputs(spark, str(tmp_path))]
    assert names == ["b.zip", "conversations-1.json", "conversations-2.json"]
    assert export.discover_inputs(spark, str(tmp_path), str(tmp_path / "b.zip"))[0].endswith("b.zip")
    with pytest.raises(ValueError):
        export.discover_inputs(spark, str(tmp_path), str(tmp_path / "notes.txt"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        export.discover_inputs(spark, str(tmp_path / "none"))


def test_asset_names_and_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file-1": "photo.PNG", "file-2": 7, "file-3": {"x": "y"}, "file-4": "b \"q\".txt"}))
    assert {tuple(r) for r in export.asset_names(spark, str(tmp_path / "a.json")).collect()} == {("file-1", "photo.PNG"), ("file-4", 'b "q".txt')}
    (tmp_path / "p1.json").write_text(json.dumps({"schema_version": "x", "probes": [{"probe_id": "a", "query": "q", "query_language": "en"}]}))
    (tmp_path / "p2.json").write_text(json.dumps([{"id": "b", "query": "r"}]))
    got = [tuple(export.probe_manifest(spark, str(tmp_path / f)).select("probe_id", "query_language", "category").first()) for f in ("p1.json", "p2.json")]
    assert got == [("a", "en", "unspecified"), ("b", "unknown", "unspecified")]
    lib = spark.createDataFrame([("f1", "c1"), ("f2", "cx"), ("f3", None)], "file_id string, origination_thread_id string")
    conv = spark.createDataFrame([("c1", None, "Trip"), (None, "c2", "Old")], "id string, conversation_id string, title string")
    assert {(r["file_id"], r["thread_title"]) for r in export.library_threads(lib, conv).collect()} == {("f1", "Trip"), ("f2", None), ("f3", None)}


def test_attachments_pages_and_reports(spark, tmp_path):
    f = spark.createDataFrame([("d", "a.txt", "1"), ("d", "a.txt", "2"), ("d", "a.txt", "1"), ("e", "a.txt", "3"), ("d", "none", "4"), ("d", "none", "5")], "d string, n string, asset string")
    assert sorted(r["target"] for r in writers.attachment_names(f, "d", "n").where("d = 'd'").collect()) == ["a.txt", "a_2.txt", "none", "none_2"]
    chats = spark.createDataFrame([("Pinned", "b.md", "B", 3), ("Pinned", "a.md", None, None), ("Common", "c.md", "C", 1)], "group string, file_name string, title string, message_count int")
    pages = {(r["folder"], r["name"]): r["text"] for r in writers.index_pages(chats, spark.createDataFrame([("x.PNG",), ("y.png",), ("z",)], "name string")).collect()}
    assert pages["Pinned", "INDEX.md"] == "# Pinned\n\n- [a.md](a.md) — 0 messages\n- [B](b.md) — 3 messages"
    assert pages[".", "SUMMARY.md"].splitlines()[2:] == ["- Common: 1 chats, 1 messages", "- Pinned: 2 chats, 3 messages"]
    assert pages[".", "ATTACHMENTS.md"].splitlines()[4:] == ["- `.png`: `2`", "- `[no-ext]`: `1`"]
    writers.report(spark.createDataFrame([("b", 2), ("a", None)], "k string, v int"), "Runs", str(tmp_path))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/markdown").collect()] == ["# Runs", "", "| k | v |", "| --- | --- |", "| a |  |", "| b | 2 |"]
    m = spark.createDataFrame([("c", 2, "assistant", "y"), ("c", 1, "user", "x")], "conversation_id string, ordinal long, role string, raw_text string").withColumn("message_id", F.lit(None).cast("string")).withColumn("time_utc", F.lit(None).cast("string"))
    assert [x["raw_text"] for x in json.loads(writers.chat_json(m, "conversation_id").first()["json"])["messages"]] == ["x", "y"]
    old = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "d string, n int")
    assert {tuple(r) for r in writers.replace_group(old, spark.createDataFrame([("d1", 9)], "d string, n int"), "d").collect()} == {("d1", 9), ("d2", 1)}


def test_chunks_of_the_strictest_tokenizer_and_their_faults(spark):
    class Letters:
        def spans(self, text):
            return [(k, k + 1) for k, c in enumerate(text) if c.isalpha()]

    both = chunk.Strictest(chunk.Words(), Letters())
    assert both.count("ab cde") == 5 and not both.fits("ab cde", 4) and both.end("ab cde", 4) == 5
    text = "one two three four five six seven eight nine ten " * 4
    b = spark.createDataFrame([("b", 0, len(text), text)], "block_id string, char_start long, char_end long, text string")
    c = chunk.build(b, "block_id", "text", "char_start", chunk.policy([64], content=60), tokenizer=chunk.Words)
    assert audit.chunk_faults(c, b, 64).count() == 0 and audit.chunk_faults(c, b, 64, strict=True).count() == 0
    bad = c.where("ordinal = 1").withColumn("text", F.lit("other"))
    one = b.withColumn("char_end", F.col("char_end") + 100)
    assert {r["fault"] for r in audit.chunk_faults(bad, one, 1).collect()} == {"gap", "inexact text", "limit"}
    with pytest.raises(ValueError, match="gap"):
        audit.chunk_faults(bad.where("false"), b, 64, strict=True)
