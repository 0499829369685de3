import math

import pytest

from stratalog.plans import catalogue

CONV = "id string, title string, project_id string, update_time_utc string"
MSGS = "id string, conversation_id string, ordinal long, role string, message_id string, time_utc string, raw_text string"
BLKS = "id string, message_id string, ordinal long, block_type string"
CHKS = "id string, block_id string, ordinal long, source_char_start long, source_char_end long, token_count long, text string"
VECS = "rowid long, chunk_id string, embedding_space_id string, dim long, vector array<float>"


def _folder(spark, path, chunks, vectors, conversation=lambda c: "v"):
    """A folder of tables: chunks (id, text), each with its own block and message, and vectors (rowid, chunk, space, vector)."""
    convs = sorted({conversation(c) for c, _ in chunks})
    tables = {
        "conversations": ([(v, "t", "p", "") for v in convs], CONV),
        "messages": ([(f"m{c}", conversation(c), n, "user", None, "", x) for n, (c, x) in enumerate(chunks)], MSGS),
        "blocks": ([(f"b{c}", f"m{c}", 0, "text") for c, _ in chunks], BLKS),
        "retrieval_chunks": ([(c, f"b{c}", 0, 0, len(x), len(x.split()), x) for c, x in chunks], CHKS),
        "dense_native_metadata": ([(r, c, s, len(v), v) for r, c, s, v in vectors], VECS),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _sql(path, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("conversations", "messages", "blocks", "retrieval_chunks", "dense_native_metadata"):
        con.execute(f"CREATE VIEW {t} AS FROM '{path}/{t}.parquet/*.parquet'")
    return sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())


def test_hybrid_search_fuses_what_stands_below_rank_50_of_both_branches(spark, tmp_path):
    at = lambda c: [c, math.sqrt(1 - c * c)]
    chunks = [("query", "alpha beta gamma delta"), ("target", "alpha beta gamma delta one two three")]
    chunks += [(f"d{k:02d}", f"other{k} words{k}") for k in range(60)] + [(f"s{k:02d}", f"alpha beta gamma delta extra{k}") for k in range(60)]
    vectors = [(100, "query", "s", at(1.0)), (1, "target", "s", at(0.8))] + [(2 + k, f"d{k:02d}", "s", at(0.81)) for k in range(60)]
    path = _folder(spark, tmp_path, chunks, vectors)
    got = catalogue.queries()["hybrid_search"](spark, path).collect()
    assert [r["chunk_id"] for r in got if r["place"] == 1] == ["target"]
    assert sorted(tuple(r) for r in got) == _sql(path, "hybrid_search")


def test_edges_and_means_keep_chunks_without_a_vector_of_the_larger_space(spark, tmp_path):
    at = lambda c: [c, math.sqrt(1 - c * c)]
    chunks = [("bare1", "alpha beta gamma"), ("bare2", "alpha beta delta"), ("m1", "red one"), ("m2", "red two"), ("s1", "green"), ("s2", "green too"), ("...", "."), ("far", "alpha beta gamma")]
    vectors = [(1, "m1", "meridian-embed-m", at(0.8)), (2, "m2", "meridian-embed-m", at(0.9)), (3, "s1", "meridian-embed-s", [1.0, 0.0, 0.0]), (4, "s2", "meridian-embed-s", [0.6, 0.8, 0.0])]
    path = _folder(spark, tmp_path, chunks, vectors, lambda c: "other" if c == "far" else "v")
    got = catalogue.queries()["similarity_edges"](spark, path).collect()
    kinds = {}
    for r in got:
        kinds.setdefault((r["group_type"], r["src"], r["dst"]), set()).add(r["edge_kind"])
    assert kinds["conversation", "bare1", "bare2"] == {"sparse_overlap", "hybrid_sim"} and kinds["project", "bare1", "far"] == {"sparse_overlap", "hybrid_sim"}
    assert kinds["conversation", "m1", "m2"] == kinds["conversation", "s1", "s2"] == {"dense_sim", "sparse_overlap", "hybrid_sim"}
    assert not any("..." in (r["src"], r["dst"]) for r in got) and sorted(tuple(r) for r in got) == _sql(path, "similarity_edges")
    means = catalogue.queries()["mean_pool_centroid"](spark, path).collect()
    assert {(r["space"], r["group_type"]) for r in means} == {(f"meridian-embed-{s}", g) for s in "ms" for g in ("conversation", "project")}
    assert sorted(tuple(r) for r in means) == _sql(path, "mean_pool_centroid")
