import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import borda, conversations, encoding, langid, mixing, neardup, pii, pii_labels, pii_model, pii_train, postings, residue, topn

# --------------------------------------------------------------------------- 1 conversations

MSG = "id string, conversation_id string, ordinal long, role string, message_id string, time_utc string, raw_text string, metadata_json string, bucket string"


def _messages():
    r = lambda i, c, o, role, text, t="2024-01-01T00:00:00Z": (i, c, o, role, None, t, text, None, "clash")
    return [
        r("a1", "ok", 1, " User", "hi"), r("a2", "ok", 2, "BOT", "hello", None), r("a2", "ok", 2, "BOT", "hello", "1704067200"),
        r("b1", "gap", 1, "user", "x"), r("b2", "gap", 3, "assistant", "y"),
        r("c1", "role", 1, "user", "x"), r("c2", "role", 2, "author", "y"),
        r("d1", "twice", 1, "user", "x"), r("d2", "twice", 1, "assistant", "y"), r("d3", "twice", 2, "assistant", "y"),
        r("e1", "open", 1, "user", "x"), r("e2", "open", 2, "tool", "t"),
        r("f1", "blank", 1, "user", " ​ "), r("f2", "blank", 2, "assistant", None),
        r("g1", "nullord", None, "user", "x"), r("h1", None, 1, "user", "x"),
        r("i1", "two", 1, "user", "x"), r("i2", "two", 2, "user", "y"), r("i3", "two", 3, "assistant", "z"),
        r("j1", "late", 2, "assistant", "z" * 50_000, "nonsense"), r("j2", "late", 1, "human", "q"),
    ]


@pytest.mark.parametrize("slices,idle_ms", [(None, conversations.IDLE_MS), (7, 0)])
def test_conversations(spark, tmp_path, slices, idle_ms):
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame(_messages(), MSG).repartition(3).write.parquet(path)
    closed = conversations.replay(spark, path, slices=slices, idle_ms=idle_ms)
    ids = spark.createDataFrame([(x,) for x in ("ok", "gap", "role", "twice", "open", "blank", "nullord", "two", "late", "none")], "id string")
    bad = {r[0] for r in conversations.unreadable(ids, closed).collect()}
    assert bad == {"gap", "role", "twice", "open", "blank", "nullord", "two", "none"}
    turns = [(r["conversation_id"], r["turn"], r["role"], len(r["text"])) for r in conversations.rebuilt(closed).orderBy("conversation_id", "turn").collect()]
    assert turns == [("late", 1, "user", 1), ("late", 2, "assistant", 50_000), ("ok", 1, "user", 2), ("ok", 2, "assistant", 5)]


def test_conversations_are_closed_while_the_archive_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BUCKET_BYTES", 20)  # about a state for each conversation
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}T00:00:00Z"
    rows = [(f"{c}-{k}", f"c{c:03d}", k + 1, "user" if k % 2 == 0 else "assistant", None, day(c) if k else None, f"text {k}", None, "") for c in range(300) for k in range(2)]
    rows += [("0-2", "c000", 3, "user", None, day(200), "again", None, ""), ("0-3", "c000", 4, "assistant", None, day(201), "yes", None, ""), ("0-0", "c000", 1, "user", None, day(250), "text 0", None, "")]
    spark.createDataFrame(rows, MSG).write.parquet(str(tmp_path / "m.parquet"))
    progress = []
    closed = conversations.replay(spark, str(tmp_path / "m.parquet"), slices=10, progress=progress).cache()
    early = closed.where("kind = 'block' and closed_at < '2025-01-01'")
    assert early.select("conversation_id").distinct().count() > 200  # long before the control row
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress) < 100
    assert closed.where("conversation_id = 'c000' and kind = 'block'").count() >= 3  # it goes on after it was closed, and a row comes again
    v = {r["conversation_id"]: (r["readable"], r["messages"]) for r in conversations.verdicts(closed).collect()}
    assert v.pop("c000") == (True, 4) and len(v) == 299 and set(v.values()) == {(True, 2)}
    assert [r["text"] for r in conversations.rebuilt(closed).where("conversation_id = 'c000'").orderBy("turn").collect()] == ["text 0", "text 1", "again", "yes"]


def test_conflicting_rows_of_one_message_are_settled_alike(spark, tmp_path):
    rows = [("m1", "c", 1, "user", None, None, t, None, "") for t in ("beta", "alpha", "gamma")] + [("m2", "c", 2, "assistant", None, None, "\x1f", None, "")]
    for k in range(2):
        spark.createDataFrame(rows[:: 1 - 2 * k], MSG).coalesce(1).write.parquet(str(tmp_path / f"{k}.parquet"))
        got = conversations.rebuilt(conversations.replay(spark, str(tmp_path / f"{k}.parquet"))).orderBy("turn").collect()
        assert [r["text"] for r in got] == ["alpha", "\x1f"]


def test_conversations_over_many_blocks(spark, tmp_path):
    n = conversations.BLOCK * 2 + 3
    rows = [(f"m{k}", "long", k + 1, "user" if k % 2 == 0 else "assistant", None, None, "t", None, "") for k in range(n + 1)]
    spark.createDataFrame(rows, MSG).write.parquet(str(tmp_path / "m.parquet"))
    v = conversations.verdicts(conversations.replay(spark, str(tmp_path / "m.parquet"), with_text=False)).first()
    assert v["readable"] and v["messages"] == n + 1


# --------------------------------------------------------------------------- 2 and 7 rankings


def _borda_plain(rows, missing):
    out = {}
    for g in {r[0] for r in rows}:
        items = {r[1]: r[2:] for r in rows if r[0] == g}
        n = len(items)
        for i in items:
            p = 0.0
            for k in (0, 1):
                v = items[i][k]
                if v is None:
                    p += (n - (n + 1) / 2) if missing == "mid" else 0
                    continue
                more = sum(1 for j in items if items[j][k] is not None and items[j][k] > v)
                same = sum(1 for j in items if items[j][k] == v)
                p += n - (more + (same + 1) / 2)
            out[g, i] = p
    return out


@pytest.mark.parametrize("missing", ["mid", "none"])
@pytest.mark.parametrize("hot", [borda.HOT, 20])
def test_borda_matches_brute_force(spark, missing, hot):
    r = random.Random(3)
    rows = [("g", f"i{k:03d}", r.choice([None, 0.0, -0.0, 1.5, r.random()]), r.choice([None, -1.0, r.randint(0, 4) / 1.0])) for k in range(150)] + [("h", "x", None, 2.0)]
    df = spark.createDataFrame(rows + rows[:9] + [(None, "x", 1.0, 1.0), ("g", None, 1.0, 1.0), ("h", "y", float("nan"), float("inf"))], "g string, i string, a double, b double").withColumn("kind", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {(x["g"], x["i"]): x["points"] for x in borda.combine(df, "g", "i", ["a", "b"], missing, hot=hot).collect()}
    want = _borda_plain([*rows, ("h", "y", None, None)], missing)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("hot", [borda.HOT, 2])
def test_borda_weights_and_members(spark, hot):
    rows = [("g", "a", 3.0, None, True), ("g", "a", None, 1.0, None), ("g", "b", 2.0, 9.0, True), ("g", "c", 9.0, 9.9, False), ("g", "c", 9.0, 9.9, None)]
    df = spark.createDataFrame(rows, "g string, i string, a double, b double, own boolean")
    got = {x["i"]: (x["points"], x["n"]) for x in borda.combine(df, "g", "i", ["a", "b"], weights=[2.0, 0.5], member="own", hot=hot).collect()}
    assert got == {"a": (2.0, 2), "b": (0.5, 2)}
    with pytest.raises(ValueError):
        borda.combine(df, "g", "i", ["a", "b"], weights=[1.0])


def test_borda_empty_and_bad_argument(spark):
    e = spark.createDataFrame([], "g string, i string, a double")
    assert borda.combine(e, "g", "i", ["a"]).count() == 0
    with pytest.raises(ValueError):
        borda.combine(e, "g", "i", ["a"], missing="worst")


def test_top_n_ties_repeats_and_unusable_scores(spark):
    rows = [("g", f"c{k:04d}", float(k % 7)) for k in range(2_000)] + [("g", "c0003", 9.0), ("g", "c0003", 1.0), ("h", "a", None), ("h", "b", float("nan")), ("h", "c", float("inf")), (None, "a", 1.0), ("k", "b", 1.0), ("k", "a", 1.0)]
    df = spark.createDataFrame(rows, "g string, c string, s double").withColumn("salt", F.lit("clash"))
    got = [(r["g"], r["c"], r["place"]) for r in topn.top_n(df, "g", "c", "s", 3, salts=5).orderBy("g", "place").collect()]
    assert got == [("g", "c0003", 1), ("g", "c0006", 2), ("g", "c0013", 3), ("k", "a", 1), ("k", "b", 2)]
    assert topn.top_n(df.where("false"), "g", "c", "s").count() == 0


# --------------------------------------------------------------------------- 3 near-duplicates


def _brute_pairs(texts, t, k, least):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\W_]+", x.lower())
        if len(w) >= least:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("often", [neardup.RARE, 2])
@pytest.mark.parametrize("t,k,least,size", [(0.6, 3, 40, 60), (0.8, 5, 5, 14), (0.6, 3, 3, 8), (0.7, 3, 40, 300)])
def test_near_pairs_match_brute_force(spark, monkeypatch, t, k, least, size, often):
    monkeypatch.setattr(neardup, "RARE", often)  # 2: most tokens are frequent
    monkeypatch.setattr(neardup, "FEW", 10**6 if often == 2 else 0)
    r = random.Random(size)
    vocab = [f"w{j}" for j in range(60)]
    texts = []
    for n in range(40):
        base = [r.choice(vocab) for _ in range(size + r.randint(0, size // 3))]
        for m in range(3):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 8))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append((f"t{n:02d}{m}", " ".join(w)))
    texts += [("copy", texts[0][1].upper() + "!"), ("null", None), ("empty", ""), ("blank", " \n")]
    df = spark.createDataFrame(texts + texts[:3] + [(None, "x " * 50)], "id string, text string").withColumn("c", F.lit(1)).withColumn("sh", F.lit("clash"))
    got = {(x["id_a"], x["id_b"]) for x in neardup.near_pairs(df, "id", "text", t, k, least).collect()}
    assert got == _brute_pairs([x for x in texts if x[1]], t, k, least)


def test_sets_that_share_only_neighbouring_prefix_tokens_have_a_key():
    r = np.random.default_rng(0)
    for _ in range(300):
        tok = r.choice(2**31 - 1, 100, replace=False)
        common, passage, own = tok[:43], tok[43:60], tok[60:]
        a, b = np.concatenate([common, passage]), np.concatenate([passage, common, own])
        heavy = np.sort(np.concatenate([common, passage]) if r.random() < 0.5 else common)
        d, keys = neardup.signatures(np.concatenate([a, b]), np.array([60, 100]), np.zeros(2, np.int64), heavy, np.arange(1, len(heavy) + 1), 0.6)
        assert set(keys[d == 0]) & set(keys[d == 1])


def test_classes_keep_copies_together(spark):
    w = " ".join(f"word{j}" for j in range(50))
    df = spark.createDataFrame([("a", w), ("b", w), ("c", w + " more words here"), ("d", " ".join(f"other{j}" for j in range(50))), ("e", None)], "id string, text string")
    rows = {r["id"]: (r["class"], r["links"]) for r in neardup.classes(df, "id", "text", 0.8, 5).collect()}
    assert rows["a"][0] == rows["b"][0] == rows["c"][0] != rows["d"][0] and rows.keys() == {"a", "b", "c", "d"}
    assert rows["a"][1] == 1 and rows["d"][1] == 0


def test_components_say_when_the_rounds_run_out(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    assert {r["root"] for r in neardup.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        neardup.components(chain, rounds=1)


def test_near_pairs_of_nothing(spark):
    assert neardup.near_pairs(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0


# --------------------------------------------------------------------------- 4 neighbours


@pytest.mark.parametrize("block", [postings.BLOCK, 300])
def test_posting_lists_reach_the_recall(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)  # 300: lists are cut into blocks
    r = np.random.default_rng(1)
    c = r.normal(size=(40, 16))
    x = (c[r.integers(0, 40, 3_000)] + 0.3 * r.normal(size=(3_000, 16))).astype(np.float32)
    rows = [(k, f"c{k:04d}", "s", 16, [float(v) for v in x[k]]) for k in range(3_000)]
    odd = [(9001, "null", "s", 16, None), (9002, "short", "s", 16, [1.0]), (9003, "zero", "s", 16, [0.0] * 16), (9004, "nan", "s", 16, [float("nan")] * 16), (9005, "alone", "t", 2, [1.0, 0.0]), (9006, None, "s", 16, rows[0][4])]
    df = spark.createDataFrame(rows + odd + [(9010, *rows[5][1:])], "r long, i string, s string, d long, x array<float>").withColumn("v", F.lit("clash"))
    got = postings.neighbours(df, "i", "s", "x", "d", "r", 5, sample=1_000).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1)[:, :5]
    by = got.groupby("i")["other"].apply(set)
    assert np.mean([f"c{j:04d}" in by[f"c{k:04d}"] for k in range(3_000) for j in top[k]]) >= 0.9
    assert got.groupby("i").size().max() == 5 and not set(got["i"]) & {"null", "short", "zero", "nan", "alone"}


def test_equal_vectors_are_each_others_nearest(spark):
    df = spark.createDataFrame([(k, f"c{k}", "s", 2, [1.0, 1.0]) for k in range(9)] + [(9, "far", "s", 2, [1.0, 0.9])], "r long, i string, s string, d long, x array<float>")
    rows = {}
    for r in postings.neighbours(df, "i", "s", "x", "d", "r", 3).collect():
        rows.setdefault(r["i"], []).append((r["place"], r["other"]))
    assert sorted(rows["c0"]) == [(1, "c1"), (2, "c2"), (3, "c3")] and sorted(rows["far"]) == [(1, "c0"), (2, "c1"), (3, "c2")]
    assert postings.neighbours(df.where("false"), "i", "s", "x", "d", "r").count() == 0


def test_vectors_that_were_replaced_take_no_places(spark):
    rows = [(k, f"c{k}", "s", 2, [1.0, 0.1 * k]) for k in range(6)] + [(10 + k, f"c{k}", "s", 2, [1.0, 0.001 * k]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "r long, i string, s string, d long, x array<float>")
    got = [(r["place"], r["other"]) for r in postings.neighbours(df, "i", "s", "x", "d", "r", 3).where("i = 'c0'").collect()]
    assert sorted(got) == [(1, "c1"), (2, "c2"), (3, "c3")]


# --------------------------------------------------------------------------- 5 languages

SEED = {
    "en": "the weather was cold and the children walked slowly to the old school where their teacher waited with a book of stories about ships",
    "de": "das wetter war kalt und die kinder gingen langsam zur alten schule wo ihr lehrer mit einem buch voller geschichten über schiffe wartete",
    "es": "el tiempo estaba frío y los niños caminaban despacio hacia la vieja escuela donde su maestro esperaba con un libro de historias sobre barcos",
    "fr": "le temps était froid et les enfants marchaient lentement vers la vieille école où leur maître attendait avec un livre plein de récits de bateaux",
    "ru": "погода была холодная и дети медленно шли к старой школе где их учитель ждал с книгой рассказов о кораблях и далёких странах",
    "uk": "погода була холодна і діти повільно йшли до старої школи де їхній учитель чекав із книжкою оповідань про кораблі та далекі країни",
}


def _documents(spark):
    rows = [(n, f"{s.capitalize()}. {' '.join(s.split()[::-1])}. {s}.", lang, "x") for n, (lang, s) in enumerate(SEED.items())] + [(99, SEED["en"] + ". " + SEED["en"], "French", "x"), (98, None, "de", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_an_accepted_sentence_keeps_its_language_between_others():
    class Fixed(langid.Classifier):
        def best(self, segment):
            return {"W": ("en", 0.18), "O": (None, 0.0), "Я": ("ru", 0.1)}.get(segment.strip()[0], ("uk", 0.5))

    uk = "Погода була холодна і діти повільно йшли до старої школи."
    text = f"{uk} What hapepns when the retry queue joins the night train? {uk} Ok then. {uk} Я тут. {uk}"
    assert [r[0] for r in Fixed({}).runs(text)] == ["uk", "en", "uk", None, "uk"]


def test_languages_of_mixed_texts(spark):
    dicts = langid.dictionaries(_documents(spark))
    assert dicts.keys() == set(SEED)
    en, ru, fr = SEED["en"].capitalize() + ".", SEED["ru"].capitalize() + ".", SEED["fr"].capitalize() + "."
    df = spark.createDataFrame([("a", f"{en}\n\n{ru}\n```\ndas ist code und die kinder\n```"), ("b", fr), ("c", ""), ("d", None), ("e", "``` never closed " + en), ("f", "12 34"), ("g", (en + " ") * 400)], "id string, t string").withColumn("nth", F.lit("clash"))
    rows = langid.runs(df, "id", "t", dicts).collect()
    assert [(r["id"], r["lang"]) for r in sorted(rows, key=lambda r: (r["id"], r["nth"])) if r["lang"]] == [("a", "en"), ("a", "ru"), ("b", "fr"), ("g", "en")]
    main = {r["id"]: (r["lang"], r["langs"]) for r in langid.languages(df, "id", "t", dicts).collect()}
    assert main["a"][1] == ["en", "ru"] or main["a"][1] == ["ru", "en"]
    labels = spark.createDataFrame([("1", en, "EN-gb"), ("2", en, "?"), ("3", en + " / " + ru, "mixed"), ("4", en + " / " + ru, "en"), ("5", fr, "mixed"), ("6", fr, None)], "p string, q string, l string")
    assert {(r["p"], r["lang"]) for r in langid.wrong_labels(labels, "p", "q", "l", dicts).collect()} == {("2", "en"), ("4", "en"), ("4", "ru"), ("5", "fr"), ("6", "fr")}


# --------------------------------------------------------------------------- 6 personal information


def test_decoding_of_stretches_equals_decoding_of_whole_texts():
    r = np.random.default_rng(4)
    p = {"trans": np.where(np.eye(6) > 0, 2.0, -1.5).astype(np.float32) + r.normal(0, 0.2, (6, 6)).astype(np.float32)}
    sizes = r.integers(1, 90, 300)
    em = r.normal(0, 1.2, (6, sizes.sum())).astype(np.float32)
    em[0] += 1.5
    starts = np.cumsum(sizes) - sizes
    got = pii_model.decode(p, em, starts, most=500)
    want = np.concatenate([pii_model.viterbi(p, np.ascontiguousarray(em[:, a : a + n].T[:, :, None]), np.array([n]))[0] for a, n in zip(starts, sizes)])
    assert (got == want).all() and 0 < (want > 0).mean() < 0.9


def test_tagger_finds_and_redacts(spark):
    texts = [
        ("1", "Please ask Nora Velkorin about the keys. Call me on +44 7700 900123 after six."),
        ("2", "--\nTimur Quillester\n14 Hobbin Lane, Flat 3\ntimur.quillester@post.example.org"),
        ("3", "Версия 3.14.1, хост 192.0.2.81, 2024-01-12 18:48:06, sha 960695858fa502c4a327."),
        ("4", None), ("5", ""), ("6", "I pasted my SSN by mistake: 946-74-8959."),
        ("7", "The parser repairs the travel sheet quite often. " * 300 + "Write to nora+list [at] mail.example before Friday."),
    ]
    df = spark.createDataFrame(texts, "id string, t string").withColumn("nth", F.lit("clash"))
    got = {(r["id"], r["pii_type"], r["nth"]) for r in pii.find(df, "id", "t").collect()}
    assert {("1", "name", 1), ("1", "phone", 1), ("2", "address", 1), ("2", "email", 1), ("2", "name", 1), ("6", "id_number", 1), ("7", "email", 1)} <= got
    assert not [x for x in got if x[0] in "345"]
    out = {r["id"]: r["text"] for r in pii.redact(df, "id", "t").collect()}
    assert out["4"] is None and out["5"] == "" and "[ADDRESS]" in out["2"] and "Hobbin" not in out["2"] and out["7"].endswith("Write to [EMAIL] before Friday.")
    assert pii.find(df.where("false"), "id", "t").count() == 0


def test_training_learns_and_gradients_hold():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii_model.init_params(3, 3, 2).items()}
    ids, lens, y = r.integers(2, 60, (2, 6)), np.array([6, 4]), r.integers(0, 6, (2, 6))
    ids[1, 4:] = 0
    _, g = pii_model.loss_and_grads(p, ids, lens, y)
    for k in ("U", "Wx", "b", "Wo", "trans"):
        at = tuple(r.integers(0, s) for s in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        slope = (pii_model.loss_and_grads(up, ids, lens, y)[0] - pii_model.loss_and_grads(down, ids, lens, y)[0]) / 2e-2
        assert abs(slope - g[k][at]) < 1e-4
    texts = [f"call +44 7700 9001{k:02d} now" for k in range(40)] + ["nothing to see here"] * 10
    names = pii_labels.name_pattern(set())
    q = pii_model.train(pii_train.batches(texts, names, random.Random(1), size=24, length=32), hidden=8, emb=8, steps=150, rate=0.03)
    tags = pii_model.tag_texts(q, ["call +44 7700 900177 now", "nothing to see here"])
    assert (tags[0][5:20] == pii_model.TAGS.index("phone")).mean() > 0.8 and not tags[1].any()


def test_windows_cover_and_agree():
    for n in (1, 320, 321, 5_000):
        w = pii_model.cut(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b[0] < a[1] for a, b in zip(w, w[1:]))


# --------------------------------------------------------------------------- 8 encoding


def test_ids_equal_the_published_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = encoding.load_ranks(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world, it's 2024!", "Привет, мир 😀é", "<|endoftext|>", " \n\n\t x", "1" * 3_000, "", None, "aaaa" * 500, "中文 été"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("ids", F.lit("clash"))
    got = {r["k"]: r["ids"] for r in encoding.encode(df, "k", "t").collect()}
    assert all(got[k] == (ref.encode_ordinary(t) if t else []) for k, t in enumerate(texts))
    assert all(b"".join(next(b for b, i in ranks.items() if i == x) for x in got[k]).decode() == (t or "") for k, t in enumerate(texts[:3]))


def test_prefix_states_equal_plain_merging():
    ranks = encoding.load_ranks(f"{encoding.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    enc, r = encoding.TrieEncoder(ranks), random.Random(2)
    words = {bytes(r.choice(b"abcehilnorst ") for _ in range(r.randint(1, 14))) for _ in range(800)}
    assert all(ids == enc.merge(w) for w, ids in enc.encode_words(words).items())


# --------------------------------------------------------------------------- 9 mixing


def test_flight_keeps_totals():
    r = np.random.default_rng(4)
    x, p = r.integers(1, 900, 500).astype(float), r.random(500)
    q = mixing.flight(p, x, r)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and abs((q * x).sum() - (p * x).sum()) < 1e-6 and abs(q.sum() - p.sum()) < 1e-6
    assert set(np.unique(mixing.land(q, x))) <= {0.0, 1.0}


@pytest.mark.parametrize("block", [50, 5_000])
def test_mixture_meets_targets(spark, block):
    r = random.Random(5)
    rows = [(k, s, r.randint(5, 300)) for k, s in enumerate(["big"] * 3_000 + ["mid"] * 400 + ["small"] * 60)] + [(9001, None, 5), (9002, "big", 0), (9003, "other", 5), (None, "big", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("p", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sizes, targets, block=block)
    got = {x["source"]: x for x in mixing.shares(m, targets).collect()}
    assert all(abs(got[s]["share"] - t) < 0.01 for s, t in (("big", 0.6), ("mid", 0.3), ("small", 0.1)))
    assert got["small"]["most_copies"] == 3 and got["big"]["most_copies"] == 1 and m.count() == m.select("doc_id").distinct().count()
    assert mixing.mix(sizes.where("false"), targets).count() == 0


# --------------------------------------------------------------------------- 10 residue


def test_residue(spark):
    texts = [
        (1, "Dear {{first_name}},\nwe met on Monday."), (2, "The importer answers 404 when a chunk is missing, and the client tries again."), (3, "In the guide a field is written as `{{ name }}` here."),
        (4, "```\n<%= user %>\n```\nplain text"), (5, "404 | Not Found"), (6, "Please enable JavaScript to continue using this site."), (7, "I switched JavaScript off in the reader and the page still opened."),
        (8, "Lorem ipsum dolor sit amet. Tempora velit porta cursus amet."), (9, None), (10, ""), (11, " \n"), (12, "Сводка подготовлена для undefined."), (13, "Traceback (most recent call last):\n  x"),
        (14, "Formula: \\frac{x}{n+1}, which the notebook prints."), (15, ("ordinary words again " * 20 + ".\n") * 300 + "Your text here"), (1, "Dear {{first_name}},\nwe met on Monday."),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    assert {r["doc_id"] for r in residue.score(df, "doc_id", "text").collect()} == {1, 5, 6, 8, 12, 13, 15}
    assert {r["doc_id"] for r in residue.without_residue(df, "doc_id", "text").collect()} == {2, 3, 4, 7, 9, 10, 11, 14}
    assert residue.score(df.where("false"), "doc_id", "text").count() == 0


def test_every_kind_of_residue_has_a_containment(spark):
    rows = [
        (1, "Hello {{ user }}, the notes of the trip are ready."), (2, "Bonjour undefined, pour être clair, le rayon est vide."),
        (3, '{"code": 503, "message": "Service Unavailable", "trace": "k1"}'), (4, "asdf asdf asdf asdf asdf asdf"), (5, "Lorem ipsum dolor sit amet, consectetur adipiscing elit."),
        (6, "Please enable JavaScript to continue using this site."), (7, "This shared link has expired or was removed."),
        (8, "The text was a text about another text, he said."), (9, "We wrote `{{ user }}` into the guide."), (10, "The value may be undefined when the key is null."),
    ]
    got = {r["doc_id"]: (r["kind"], r["containment"]) for r in residue.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "field", 2: "field", 3: "error", 4: "filler", 5: "lorem", 6: "scripts", 7: "error"}
    assert all(0 < c <= 1 for _, c in got.values())
