from pyspark.sql import functions as F

from stratalog.functions import ids, text, vectors


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).first()["y"]


def test_clip_keeps_short_texts_and_ends_long_ones(spark):
    assert one(spark, text.clip(F.col("x"), 5), "abcd") == "abcd"
    assert one(spark, text.clip(F.col("x"), 5), "abc  def") == "abc…"
    assert one(spark, text.clip(F.col("x"), 5), None) is None


def test_information_score(spark):
    score = lambda s: one(spark, text.information_score(F.col("x")), s)
    assert score("") == 0 and score("Да.") == 0 and score("BGP:") == 0
    assert score("short text") == 0.15
    assert 0.4 < score("a longer sentence about nearest neighbours and their posting lists") < 1
    assert score(None) is None


def test_terms_drop_numbers_and_repeats(spark):
    assert one(spark, text.meaningful_terms(F.col("x")), "Chunk chunk 123 ab файл v2.1") == ["chunk", "файл", "v2.1"]


def test_block_kind(spark):
    kind = lambda s: one(spark, text.block_kind(F.col("x")), s)
    assert [kind(s) for s in ("|a|\n|b|", "> q", "- a\n2. b", "# h", "plain\n- a")] == ["table", "quote", "list", "heading", "prose"]


def test_phrases_and_display(spark):
    assert one(spark, text.phrases(F.col("x"), 2), ["a", "b", "c"], "array<string>") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.phrases(F.col("x"), 3), [], "array<string>") == []
    assert one(spark, text.display_phrase(F.col("x")), "api vector") == "API Vector"


def test_slug_and_file_name(spark):
    assert one(spark, text.slug(F.col("x"), "id-1"), " Новый План: v2 ") == "новый_план_v2"
    assert one(spark, text.slug(F.col("x"), "id-1"), "???") == "id-1"
    assert one(spark, text.safe_file_name(F.col("x"), "f"), " a/b: c. ") == "a_b_ c"


def test_language_rules(spark):
    assert one(spark, text.script_language(F.col("x")), "привет мир hello") == "mixed"
    assert one(spark, text.language_mismatch(F.col("x"), F.lit("ru")), "what is the best way to do it") == "english sentence"
    assert one(spark, text.language_mismatch(F.col("x"), F.lit("en")), "как это сделать") == "russian sentence"


def test_stable_id_treats_null_as_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "p string, q string").select(ids.stable_id("m", F.col("p"), F.col("q")).alias("i"))
    rows = [r["i"] for r in df.collect()]
    assert rows[0] == rows[1] and rows[0].startswith("m_") and len(rows[0]) == 34


def test_canonical_text(spark):
    assert one(spark, ids.canonical_text(F.col("x")), "\r\n é  \r\nb\t\n\n") == " é\nb"


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_iso_time(spark):
    assert one(spark, text.iso_time(F.col("x")), 0.5, "double") == "1970-01-01T00:00:00.500000+00:00"
    assert one(spark, text.iso_time(F.col("x")), 60.0, "double") == "1970-01-01T00:01:00+00:00"
    assert one(spark, text.iso_time(F.col("x")), None, "double") == ""
