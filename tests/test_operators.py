import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import assemble, audit, chunk, distill, embed, evaluate, graph, lineage, retrieve
from stratalog.sources import export, markdown, writers
from stratalog.streaming import ingest


def test_exact_neighbours_match_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8))
    df = spark.createDataFrame([(f"c{k:02d}", "s", [float(v) for v in x[k]]) for k in range(60)] + [("bad", "s", None), ("nan", "s", [float("nan")] * 8)], "id string, space string, vector array<float>")
    got = retrieve.exact_neighbours(df.where("id < 'c10'"), df, "id", "vector", "space", 3, block=16).collect()
    u = (x.astype(np.float32).astype(float).T / np.linalg.norm(x.astype(np.float32).astype(float), axis=1)).T
    for k in range(10):
        s = u @ u[k]
        s[k] = -9
        assert [g["id"] for g in sorted((g for g in got if g["query"] == f"c{k:02d}"), key=lambda g: g["place"])] == [f"c{j:02d}" for j in np.argsort(-s)[:3]]


def test_sparse_scores_count_unknown_terms_in_the_norm(spark):
    q = spark.createDataFrame([("q", "alpha", 1.0), ("q", "unknown", 1.0)], "q string, term string, weight double")
    p = spark.createDataFrame([("c", "alpha", 1.0)], "c string, term string, weight double")
    assert abs(retrieve.sparse_scores(q, p, "q", "c").first()["score"] - 0.5**0.5) < 1e-12


def test_hybrid_takes_both_branches_and_breaks_ties_by_id(spark):
    d = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5)], "q string, c string, score double")
    s = spark.createDataFrame([("q", "c", 0.9), ("q", "z", 0.0)], "q string, c string, score double")
    rows = [(r["c"], r["reason"]) for r in retrieve.hybrid(d, s, "q", "c").orderBy("place").collect()]
    assert rows == [("a", "dense"), ("b", "dense"), ("c", "sparse")]
    with pytest.raises(ValueError):
        retrieve.hybrid(d, s, "q", "c", 0, 0)


def test_ndcg_is_one_for_the_ideal_order(spark):
    df = spark.createDataFrame([("q", 3, 1, "a"), ("q", 1, 2, "b")], "q string, rel int, rk int, k string")
    assert evaluate.ndcg(df, "q", "rel", "rk", "k", 10).first()["ndcg"] == 1.0


@pytest.mark.parametrize("version", ["1", "2"])
def test_chunks_cover_every_character(spark, version):
    p = chunk.policy([16], version=version)
    for t in ("word " * 80, "x" * 500, "One. Two three four. " * 9, "a\n\nb\n\n" * 30, "é😀 слово " * 40):
        parts = chunk.cut(t, p)
        assert parts[0][0] == 0 and parts[-1][1] == len(t)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(parts, parts[1:]))
        assert all(c <= p.content for _, _, c, _, _ in parts)


def test_chunk_policy_errors():
    with pytest.raises(ValueError):
        chunk.policy([4])
    with pytest.raises(ValueError):
        chunk.policy([64], version="3")
    assert chunk.policy([64]).id == "canonical_token_chunks:2;limit=64;content=60;fallback_overlap=3;reserve=4"


def test_blocks_of_open_fences_and_offsets(spark):
    t = "intro 😀\n\n```py\nx = 1\n```\n- a\n- b\n\n```mermaid\ngraph"
    rows = markdown.blocks(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("id", "ordinal").collect()
    assert [(r["block_type"], r["language"]) for r in rows] == [("prose", None), ("code", "py"), ("list", None), ("mermaid", "mermaid")]
    assert all(t[r["char_start"] : r["char_end"]] == r["block_text"] for r in rows)


def test_markdown_round_trip(spark):
    m = spark.createDataFrame([("c", 1, "user", "2024", "m1", "Hello\n\n```\n### 9. USER\n```"), ("c", 2, "assistant", None, None, "Yes")], "conversation_id string, ordinal long, role string, time_utc string, message_id string, raw_text string")
    doc = markdown.render(m.withColumn("title", F.lit(" T ")), "conversation_id", F.col("title"))
    back = markdown.messages(doc, "conversation_id", "markdown").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["role"], r["body"]) for r in back] == [(1, "user", "Hello\n\n```\n### 9. USER\n```"), (2, "assistant", "Yes")]
    assert {r["name"]: r["value"] for r in markdown.metadata(doc, "conversation_id", "markdown").collect()} == {"id": "c", "message_count": "2"}


def test_export_json_and_zip(spark, tmp_path):
    conv = {"id": "c1", "title": "T", "create_time": 1.0, "mapping": {
        "b": {"message": {"id": "m2", "author": {"role": "Assistant"}, "create_time": 2.5, "content": {"parts": ["yes", " "]}, "metadata": {"attachments": [{"id": "f1"}, {"id": "f1"}]}}},
        "a": {"message": {"id": "m1", "author": {"role": "user"}, "create_time": 1.5, "content": {"parts": ["hi", {"k": 1}]}}}, "r": {"message": None}, "e": {"message": {"id": "m0", "content": {"parts": []}}}}}
    (tmp_path / "conversations-001.json").write_text(json.dumps([conv]))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "conversations-001.json", "in/conversations-001.json")
    for path in (str(tmp_path), str(tmp_path / "x.zip")):
        raw = export.conversations(spark, path)
        rows = export.flatten(raw).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["role"], r["message_id"]) for r in rows] == [(1, "user", "m1"), (2, "assistant", "m2")]
        assert rows[0]["raw_text"].startswith("hi\n\n{")
        assert [r["attachment_id"] for r in export.attachment_ids(raw).collect()] == ["f1"]


def test_attachments_and_tree(spark, tmp_path):
    at = tmp_path / "Projects" / "p" / "attachments"
    at.mkdir(parents=True)
    (at / "note.txt").write_text("some text")
    (at / "image.png").write_bytes(b"x")
    (at / "broken.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(at / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    got = {(r["path"].rsplit("/", 1)[-1], r["status"], r["ordinal"], r["text"]) for r in export.attachments(spark, str(tmp_path)).collect()}
    assert got == {("note.txt", "extracted", 1, "some text"), ("image.png", "unsupported", None, None), ("broken.docx", "failed", None, None), ("w.docx", "extracted", 1, "one"), ("w.docx", "extracted", 2, "two")}
    tree = export.file_tree(spark, str(tmp_path)).collect()
    assert {(r["relative_path"], r["folder_kind"], r["file_kind"]) for r in tree if "note" in r["relative_path"]} == {("Projects/p/attachments/note.txt", "project", "attachment")}


def test_orphans_duplicates_one_sided(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (3, "y")], "id int, p string")
    b = spark.createDataFrame([("x",)], "p string")
    assert [r["id"] for r in audit.orphans(a, b, "p", "p").distinct().collect()] == [3]
    assert [(r["id"], r["rows"]) for r in audit.duplicates(a, ["id"]).collect()] == [(3, 2)]
    assert {(r["p"], r["side"]) for r in audit.one_sided(a.where("p is not null"), b, "p").collect()} == {("y", "left")}


def test_covered_merges_ranges(spark):
    df = spark.createDataFrame([("g", 0, 5), ("g", 3, 8), ("g", 10, 12), ("g", 11, 12)], "g string, a int, b int")
    assert audit.covered(df, ["g"], "a", "b").first()["covered"] == 10


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(1, "a"), (2, None)]
    f = lambda r: audit.fingerprint(spark.createDataFrame(r, "id int, t string"), ["id", "t"]).first()["fingerprint"]
    assert f(rows) == f(rows[::-1]) != f([(1, "a"), (2, "")])


def test_revisions_and_publishing(spark, tmp_path):
    o, n = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, r string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, r string")
    assert {(r["id"], r["state"]) for r in lineage.compare_revisions(o, n, "id", "r").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "absent"), ("d", "new")}
    assert lineage.current(spark, str(tmp_path)) is None
    lineage.publish(spark, str(tmp_path), "g1", {"t": o})
    lineage.publish(spark, str(tmp_path), "g2", {"t": n})
    assert spark.read.parquet(lineage.current(spark, str(tmp_path)) + "/t.parquet").count() == 3
    with pytest.raises(Exception):
        lineage.publish(spark, str(tmp_path), "g2", {"t": n})


def test_graph_pieces(spark):
    v = spark.createDataFrame([("g", "a", [1.0, 0.0]), ("g", "b", [0.0, 1.0]), ("h", "c", [1.0])], "g string, k string, v array<float>")
    m = {r["g"]: r["mean"] for r in graph.mean_vectors(v, ["g"], "v").collect()}
    assert abs(m["g"][0] - 0.5**0.5) < 1e-12 and m["h"] == [1.0]
    members = v.select("g", "k").where("g = 'g'")
    vectors = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "s", [0.6, 0.8])], "k string, space string, vector array<float>")
    e = graph.member_edges(members, vectors, spark.createDataFrame([], "k string, terms array<string>"), ["g"], "k").collect()
    assert {(r["src"], r["dst"], r["edge_kind"]) for r in e} == {("a", "b", "dense_sim"), ("a", "b", "hybrid_sim")}
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.9)], "src string, dst string, score double")
    assert [(r["neighbour"], r["score"]) for r in graph.neighbours(edges, spark.createDataFrame([("b",)], "s string"), "s").orderBy("place").collect()] == [("c", 0.9), ("a", 0.5)]


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", "a", 3.0, 60), ("q", "b", 2.0, 50), ("q", "c", 1.0, 40), ("p", "z", 1.0, 900)], "q string, k string, s double, t int")
    assert {(r["q"], r["k"]) for r in graph.within_budget(df, "q", "k", "s", "t", 100).collect()} == {("q", "a"), ("q", "c"), ("p", "z")}


def test_project_names(spark):
    t = spark.createDataFrame([("g", "Vector index plan"), ("g", "vector index notes"), ("h", "Garden one"), ("h", "garden two"), ("i", "Single")], "g string, t string")
    assert {r["g"]: (r["name"], r["confidence"]) for r in distill.project_names(t, "g", "t").collect()} == {"g": ("Vector Index", "high"), "h": ("Garden", "medium"), "i": (None, "none")}


def test_rerank_groups_and_focus(spark):
    row = lambda c, m, text, f, **k: {"query": "q", "query_text": "vector index", "chunk_id": c, "message_id": m, "conversation_id": "v", "block_id": c, "project_id": "p", "char_start": 0, "char_end": 5, "text": text, "fused": f} | k
    long = "the vector index answers queries about neighbouring chunks"
    rows = [row("a", "m1", long, 0.5), row("b", "m1", long + " again", 0.4), row("c", "m2", "Да.", 0.45), row("d", "m3", "another paragraph on completely different garden matters", 0.3)]
    out = assemble.focused(assemble.rerank(spark.createDataFrame(rows)), "query").orderBy("place").collect()
    assert [(r["chunk_id"], r["chunks"]) for r in out] == [("a", 2), ("d", 1)]
    with pytest.raises(ValueError):
        assemble.archive_filter(spark.createDataFrame([("user", "")], "role string, time_utc string"), roles=["boss"])


def test_length_batches_and_vectors(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(10)], "id int, n int")
    got = embed.length_batches(df, "id", "n", 4).orderBy("n", "id").collect()
    assert [r["batch"] for r in got] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    good, bad = writers.checked_vectors(spark.createDataFrame([(1, [1.0], 1), (2, [], 1), (3, None, 1), (4, [0.0], 1)], "id int, v array<float>, d int"), "v", "d")
    assert good.count() == 1 and {r["reason"] for r in bad.collect()} == {"empty", "null", "zero"}


def test_streaming_import_appends_each_revision_once(spark, tmp_path):
    schema = "id string, role string, raw_text string"
    land, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "user", "x"), ("a", "user", "x"), ("b", "user", None)], schema).write.parquet(land)
    ingest.ingest(spark, land, store, str(tmp_path / "p"), schema).awaitTermination()
    spark.createDataFrame([("a", "user", "x"), ("a", "user", "y")], schema).write.mode("append").parquet(land)
    ingest.ingest(spark, land, store, str(tmp_path / "p"), schema).awaitTermination()
    assert sorted((r["id"], r["raw_text"] or "") for r in spark.read.parquet(store).collect()) == [("a", "x"), ("a", "y"), ("b", "")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, g string, t string, n long, v array<float>")
    assert markdown.blocks(e, "id", "t").count() == 0
    assert graph.mean_vectors(e, ["g"], "v").count() == 0
    assert retrieve.exact_neighbours(e, e, "id", "v", "g").count() == 0
    assert audit.covered(e.withColumn("m", F.col("n")), ["g"], "n", "m").count() == 0
