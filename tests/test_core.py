import datetime
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens import providers, queries, schema, session, timeq
from chronolens.agent import Library, RetrievalOnly, ask
from chronolens.functions import numbers, text
from chronolens.operators import catalog, described, evaluation, folds, hybrid, joins, lexical, mentions, views, vision, windows
from chronolens.operators.text_index import TextIndex
from chronolens.plans import jobs, planner
from chronolens.sources import questions, sampling, subtitles
from chronolens.streaming import live


def test_time():
    T = timeq.Timestamp
    assert T(1, 2) == T(2, 4) and hash(T(1, 2)) == hash(T(2, 4)) and T(1, 3) < T(1, 2)
    assert T(1, 3).rescale(10) == T(3, 10) and T(-1, 2).rescale(1).num == -1
    assert T(1, 2) + T(1, 3) == T(5, 6) and str(T(-3723500, 1000)) == "-01:02:03.500"
    assert timeq.duration_secs("1h30m") == 5400 and timeq.duration_secs("250ms") == 0.25
    with pytest.raises(ValueError):
        timeq.duration_secs("1x")
    assert timeq.merge_windows([(5, 9), (0, 5), (20, 30)], 2) == [(0, 9), (20, 30)]
    with pytest.raises(ValueError):
        timeq.merge_windows([(0, 1), (2, 3)], 1)


def test_query_strings():
    assert text.free_text_query("the cat and dog") == '"cat" OR "dog"*'
    assert text.free_text_query("what is it") == '"what" OR "is" OR "it"*'
    assert text.free_text_query("...") is None
    assert text.phrase_query('say "hi" there') == '"say hi there"' and text.phrase_query("new yor", True) == '"new yor"*'
    assert text.phrase_query("--") is None


def test_bm25_agrees_with_fts5(spark):
    docs = ["the cat sat", "a cat and a dog", "dogs bark at the cat cat", "nothing here", "Émile's console.anthropic.com", "dog", "catalogue of dogs", "more words that pad the corpus out"]
    rows = spark.createDataFrame([("transcript", str(i), "v", float(i), float(i + 1), t) for i, t in enumerate(docs)], "kind string, id string, video_id string, t0 double, t1 double, text string")
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table d using fts5(text, tokenize='unicode61 remove_diacritics 2', prefix='2 3')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    c.executemany("insert into d(rowid, text) values (?, ?)", list(enumerate(docs)))
    for q in ("cat dog", "emile", "anthropic.com", "bark corp"):
        want = {str(i): -s for i, s in c.execute("select rowid, bm25(d) from d where d match ?", (text.free_text_query(q),))}
        got = {r["id"]: r["score"] for r in lexical.bm25(rows, q).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), q


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.strip_markup(F.lit(" <b>a</b> {\\an8}&amp;lt; &#39;b&quot; "))) == "a &lt; 'b\""
    assert [tuple(r) for r in get(text.citations(F.lit("x [[cite:v1:1-2.5]] [[cite:v1:3-4; v2:5-6]] [[cite:bad]]")))] == [("v1", 1.0, 2.5), ("v1", 3.0, 4.0), ("v2", 5.0, 6.0)]
    assert get(text.option_letter(F.lit("The answer is (C)."))) == "C" and get(text.option_letter(F.lit("B) yes"))) == "B" and get(text.option_letter(F.lit("no idea"))) is None
    assert get(text.clock_secs(F.lit("at 1:02:03"))) == 3723
    assert get(text.snippet(F.lit("see console.anthropic.com now"), "anthropic")) == "see console.[anthropic].com now"
    w = get(numbers.wilson(F.lit(8), F.lit(10)))
    assert abs(w["lo"] - 0.4901625) < 1e-4 and abs(w["hi"] - 0.9433178) < 1e-4
    assert get(numbers.lower_percentile(F.array(*map(F.lit, [5, 1, 4, 2, 3])), 0.95)) == 4
    assert get(numbers.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    s = get(evaluation.set_scores(F.array(F.lit("a"), F.lit("b"), F.lit("x")), F.array(F.lit("a"), F.lit("c")), F.array(F.lit("b"))))
    assert abs(s["precision"] - 2 / 3) < 1e-9 and s["recall"] == 0.5


def _mention_rows(spark):
    rows = [
        ("transcript", "1", "a", 10.0, 20.0, "Anthropic builds models"),
        ("transcript", "2", "a", 50.0, 60.0, "go to console.anthropic.com today"),
        ("transcript", "3", "b", 5.0, 9.0, "anthropic again"),
        ("transcript", "4", "c", 5.0, 9.0, "nothing"),
        ("ocr", "5", "a", 505.0, 505.0, "ANTHROPIC"),
        ("ocr", "6", "a", 510.0, 510.0, "ANTHROPIC"),
    ]
    return spark.createDataFrame(rows, "kind string, id string, video_id string, t0 double, t1 double, text string")


def test_mentions(spark):
    found = mentions.mentions(_mention_rows(spark), ["anthropic"])
    c = {(r["kind"], r["video_id"]): r["n"] for r in mentions.counts(found).collect()}
    assert c == {("transcript", "a"): 2, ("transcript", "b"): 1, ("ocr", "a"): 1}
    s = {r["id"]: r["text"] for r in mentions.samples(found, 5, _mention_rows(spark)).collect()}
    assert s["1"] == "[Anthropic] builds models" and s["2"] == "go to console.[anthropic].com today"
    videos = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "id string, channel string")
    got = {r["channel"]: r["total"] for r in mentions.by_channel(found, videos, ["anthropic"]).collect()}
    assert got == {"x": 3, "unknown": 1, "y": 0}
    assert mentions.mentions(_mention_rows(spark), ["--"]).count() == 0


def test_terms_without_hits(spark):
    terms = ["console anthropic", "absent", "--"]
    found = mentions.mentions(_mention_rows(spark), terms)
    assert [tuple(r)[:4] for r in mentions.by_library(found, terms).orderBy("term_i").collect()] == [(0, "console anthropic", 1, 1), (1, "absent", 0, 0)]
    videos = spark.createDataFrame([("a", "x"), ("b", None)], "id string, channel string")
    got = {(r["term"], r["channel"]): r["total"] for r in mentions.by_channel(found, videos, terms).collect()}
    assert got == {("console anthropic", "x"): 1, ("console anthropic", "unknown"): 0, ("absent", "x"): 0, ("absent", "unknown"): 0}
    assert mentions.by_channel(found, videos, ["--"]).count() == 0


def test_fold_and_snippet(spark):
    one = spark.range(1)
    for raw, want in (("Dvořák", ["dvorak"]), ("école", ["ecole"]), ("école Été", ["ecole", "ete"]), ("Ångström ở", ["angstrom", "o"]), ("日本 й", ["日本", "й"])):
        assert text.query_tokens(raw) == want and one.select(text.tokens(F.lit(raw)).alias("t")).first()["t"] == want
    assert text.snippet_text("the café-shop is open", "cafe shop") == "the [café-shop] is open"
    assert text.snippet_text("an école here", "ecole") == "an [école] here"
    assert text.snippet_text("a " * 30 + "hit" + " b" * 30, "hit") == "…" + "a " * 6 + "[hit]" + " b" * 7 + "…"
    assert text.snippet_text("hit", "miss") == "" == text.snippet_text(None, "x") == text.snippet_text("x", "--")
    assert text.snippet_text("console use", "con", True) == "[console] use"


def test_text_index_upkeep(spark, tmp_path):
    """A stored index answers as the rows themselves do, after rows are written again and deleted."""
    rows = _mention_rows(spark)
    index = TextIndex(spark, f"file://{tmp_path}/a").append(rows, 0)
    new = spark.createDataFrame([("transcript", "1", "a", 10.0, 20.0, "the anthropic building"), ("transcript", "9", "c", 1.0, 2.0, "Anthropic anthropic models"), ("description", "1", "c", 0.0, 9.0, "models")], rows.schema)
    index.append(new, 1)
    index.delete(spark.createDataFrame([("transcript", "3"), ("ocr", "77")], "kind string, id string"), 2)
    now = rows.where("not (kind = 'transcript' and id in ('1', '3'))").unionByName(new)
    for source in (index, index.compact(f"file://{tmp_path}/b")):
        for q in ("anthropic models", "today", "mod", "anthropic.com", "m"):
            key = lambda df: sorted((*tuple(r)[:5], round(r["score"], 9)) for r in df.collect())
            assert key(lexical.bm25(source, q)) == key(lexical.bm25(now, q)), q
        for terms in (["anthropic", "console anthropic"], ["anthropic build"]):
            key = lambda df: sorted(map(tuple, df.collect()))
            assert key(mentions.mentions(source, terms, prefix=True)) == key(mentions.mentions(now, terms, prefix=True))
    assert "regexp_extract_all" not in lexical.bm25(index, "anthropic models")._jdf.queryExecution().toString()


def test_places(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 101).alias("v"), "id")
    got = mentions.placed(df, [F.desc("v"), F.col("id")]).collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 501))


def test_hybrid_units(spark):
    rows = [("transcript", "1", "v", 100.0, 115.0, "alpha beta"), ("transcript", "2", "v", 1840.0, 1855.0, "alpha gamma"), ("transcript", "3", "v", 1900.0, 1915.0, "alpha beta beta"), ("ocr", "4", "v", 1841.0, 1841.0, "beta")]
    ev = spark.createDataFrame(rows, "kind string, id string, video_id string, t0 double, t1 double, text string")
    seg = spark.createDataFrame([("c1", "v", "chapter", 0.0, 1800.0), ("c2", "v", "chapter", 1800.0, 3600.0)], "id string, video_id string, level string, t0_secs double, t1_secs double")
    ext = spark.createDataFrame([("v", 3600.0)], "video_id string, extent double")
    hits = hybrid.search(ev, hybrid.temporal_units(seg, ext), "beta", 5).collect()
    assert [h["segment_id"] for h in hits] == ["c2", "c1"] and hits[0]["n_hits"] == 2
    plain = hybrid.temporal_units(seg.where("false"), ext)
    hit = hybrid.search(ev, plain, "gamma", 5).first()
    assert (hit["u0"], hit["u1"], hit["how"]) == (1800.0, 1860.0, "window")
    shot = spark.createDataFrame([("s", "v", "shot", 0.0, 200.0)], seg.schema)
    assert [(r["t0"], r["t1"]) for r in hybrid.temporal_units(shot, ext).orderBy("unit").collect()] == [(0.0, 66.667), (66.667, 133.333), (133.333, 200.0)]
    lib = Library(ev, plain, spark.createDataFrame([("v", None, 1.0)], "id string, channel string, duration_secs double"))
    answer, used = ask(lib, "gamma", RetrievalOnly())
    assert used == ["search"] and "[[cite:v:1800-1860]]" in answer


def test_joins(spark):
    p = spark.createDataFrame([("v", 1, 10.0), ("v", 2, 59.9), ("w", 3, 5.0)], "video_id string, k int, t double")
    s = spark.createDataFrame([("v", 9.0, 1), ("v", 11.0, 2), ("v", 100.0, 3)], "video_id string, s double, n int")
    assert {r["k"]: r["n"] for r in joins.nearest(p, s, ["video_id"], ["k"], "t", "s", 2.0).collect()} == {1: 1, 2: None, 3: None}
    a = spark.createDataFrame([("v", 1, 0.0, 500.0)], "video_id string, a int, a0 double, a1 double")
    b = spark.createDataFrame([("v", 1, 499.0, 600.0), ("v", 2, 500.0, 600.0), ("v", 3, 10.0, 20.0)], "video_id string, b int, b0 double, b1 double")
    assert sorted(r["b"] for r in joins.overlaps(a, b, ["video_id"], "a0", "a1", "b0", "b1").collect()) == [1, 3]
    assert joins.islands(b, ["video_id"], "b0", "b1").count() == 2 and joins.gaps(b, ["video_id"], "b0", "b1").count() == 1


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat").open()
    row = lambda i, title, state="coarse": (i, "s", "h", title, None, "ch", None, 1, 1, 10.0, None, None, state, None, None, None)
    put = lambda rows, seq: c.append("videos", spark.createDataFrame(rows, schema.TABLES["videos"]), seq)
    put([row("a", "old"), row("b", "b")], 1)
    put([row("a", "new")], 2)
    c.delete("videos", c.read("videos").where("id = 'b'"), 3)
    assert [(r["id"], r["title"]) for r in c.read("videos").collect()] == [("a", "new")]
    with pytest.raises(ValueError):
        put([row("z", "z", "odd")], 4)
    c.compact("videos", f"file://{tmp_path}/other")
    assert catalog.Catalog(spark, f"file://{tmp_path}/other").read("videos").count() == 1
    assert c.read("events").count() == 0
    catalog.Catalog(spark, f"file://{tmp_path}/cat").open()
    with pytest.raises(ValueError):
        schema.readable(json.dumps({"schema_version": 99}))


def test_cascade(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    tables = {
        "videos": t([("v",), ("w",)], "id string"),
        "tracks": t([("tv", "v"), ("tw", "w")], "id string, video_id string"),
        "transcript_spans": t([("1", "tv"), ("2", "tw")], "id string, track_id string"),
        "frame_samples": t([("f1", "tv"), ("f2", "tw")], "id string, track_id string"),
        "ocr_spans": t([("o1", "f1"), ("o2", "f2")], "id string, frame_sample_id string"),
        "embeddings": t([("1", "m"), ("o2", "m"), ("o1", "m")], "target_id string, model string"),
    }
    out = catalog.cascade(tables, t([("v",)], "id string"))
    ids = {k: sorted(r[0] for r in v.collect()) for k, v in out.items()}
    assert ids == {"videos": ["w"], "tracks": ["tw"], "transcript_spans": ["2"], "frame_samples": ["f2"], "ocr_spans": ["o2"], "embeddings": ["o2"]}


def test_subtitles(spark, tmp_path):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:03,000\r\nnever\r\n"
    vtt = "WEBVTT\n\nNOTE skip\n\n00:01.000 --> 00:02.000 align:start\n&lt;hi&gt; &amp; bye\n"
    for n, s in (("talk.en.srt", srt), ("talk.vtt", vtt), ("a.b.c.srt", srt)):
        (tmp_path / n).write_text(s)
    got = list((r["stem"], r["lang"], r["t0"], r["t1"], r["text"]) for r in subtitles.read_subtitles(spark, str(tmp_path)).collect())
    assert set(got) == {("talk", "en", 1.0, 2.5, "Hello there"), ("talk", None, 1.0, 2.0, "<hi> & bye")}
    (tmp_path / "x.info.json").write_text(json.dumps({"title": "t", "uploader": "u", "upload_date": "20240102", "chapters": [{"start_time": 0, "end_time": 5, "title": "a"}, {"start_time": 5, "end_time": 5, "title": "b"}]}))
    i = subtitles.read_info(spark, str(tmp_path / "x.info.json"))
    r = i.first()
    assert r["channel"] == "u" and str(r["published_at"])[:10] == "2024-01-02" and len(r["chapters"]) == 1
    assert subtitles.imported_chapters(i, "title").count() == 1
    (tmp_path / "m.mp4").write_bytes(b"abc")
    m = subtitles.read_media(spark, str(tmp_path))
    assert m.first()["content_hash"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert [subtitles.dispatch(x) for x in ("s3://b/x.mp4", "https://youtu.be/1", "http://x/y.mp4", "/tmp/x.mp4")] == ["object_store", "video_site", "http", "local_file"]


def test_folds():
    cues = [(0, 1, "we are"), (1, 2, "we are here"), (2, 3, "here"), (3, 4, "next")]
    assert folds.dedup_rolling(cues) == [(0, 1, "we are"), (1, 3, "here"), (3, 4, "next")]
    assert folds.group_cues([(0, 5, "a"), (5, 10, "b"), (10, 16, "c"), (30, 31, "d")]) == [(0, 10, "a b"), (10, 16, "c"), (30, 31, "d")]
    d = [0.0] + ([0.01] * 9 + [0.9]) * 3
    assert [i for i, c in enumerate(folds.shot_cuts(d)) if c] == [10, 20, 30]
    assert folds.shots([float(i) for i in range(31)], d, 31.0)[0] == (0.0, 10.0)
    assert folds.keep_distinct([0, 1, 127, 128, 255]) == [True, False, True, True, True]
    assert folds.read_gate([0, 1, 40], [0, 0, 0], [0, 0, 0]) == [True, False, True]
    assert folds.new_lines([["ab", "c"], ["ab", "de"], ["ab"]]) == [["ab"], ["de"], []]
    p = [0.0] * 10 + [0.9] * 20 + [0.4] * 5 + [0.0] * 100
    ((a, b),) = folds.speech(p)
    assert abs(a - (10 * 0.032 - 0.2)) < 1e-9 and abs(b - (35 * 0.032 + 0.2)) < 1e-9
    w = [(f"w{i}.", i * 1.0, i + 0.5, 1.0) for i in range(20)]
    spans = folds.shape_words(w)
    assert " ".join(s[2] for s in spans) == " ".join(x[0] for x in w) and all(s[1] - s[0] <= 15 for s in spans)
    assert folds.scenes([(0, 30), (30, 60), (60, 90)], [0.9, 0.1]) == [(0, 30), (30, 90)]
    assert folds.scenes([(0, 5), (5, 60)], [0.9]) == [(0, 60)]
    assert folds.split_long([(0, 240)], [118.0]) == [(0, 118.0), (118.0, 240)]
    assert folds.depth_scores([0.9, 0.2, 0.8])[1] == pytest.approx(1.3)
    assert folds.chapters([0, 600, 1200], 1800, [0.1, 0.9], [False, False], 900) == [(0.0, 1200), (1200, 1800)]
    assert folds.title_like(["12:34", "Attention is all"]) == "Attention is all" and folds.canonical("  Ada   Lovelace ") == "ada lovelace"


def test_vision(spark):
    g = np.random.default_rng(0).integers(0, 256, (32, 32))
    assert vision.perceptual_hash(g) == vision.perceptual_hash(g + 3)
    got = spark.createDataFrame([(bytearray(g.astype(np.uint8).tobytes()),), (None,)], "b binary").select(vision.phash("b").alias("h")).collect()
    assert got[0]["h"] == vision.perceptual_hash(g) and got[1]["h"] is None
    e = vision.edges(np.kron([[0, 255], [255, 0]], np.ones((8, 8))))
    assert vision.edge_change(e, e) == 0 and vision.edge_change(e, np.zeros_like(e)) == 1
    h = vision.histogram(np.zeros((4, 4, 3)))
    assert h.sum() == 1 and vision.distance((h, e), (h, e)) == 0
    m = np.zeros((10, 10))
    m[2:4, 3:7] = 1
    assert vision.boxes(m)[0][0] <= 3 and len(vision.boxes(m)) == 1
    assert vision.ctc_greedy(np.eye(3)[[0, 1, 1, 0, 2]], "ab")[0] == "ab"


def test_planner(spark):
    r = planner.Registry()
    for i, (a, b) in {"decode": ((), ("frame",)), "shots": (("frame",), ("segment",)), "scenes": (("segment",), ("scene",))}.items():
        r.add(planner.Operator(i, inputs=a, outputs=b, replayable=i != "decode"))
    ops = r.ordered(["scenes", "shots", "decode"])
    assert [o.id for o in ops] == ["decode", "shots", "scenes"]
    assert planner.actions(ops, {"decode", "shots", "scenes"}) == {"decode": "skip", "shots": "skip", "scenes": "skip"}
    assert planner.actions(ops, {"decode", "shots"}) == {"decode": "skip", "shots": "replay", "scenes": "run"}
    assert planner.actions(ops, {"decode"}) == {"decode": "run", "shots": "run", "scenes": "run"}
    with pytest.raises(ValueError):
        r.ordered(["scenes"])
    with pytest.raises(ValueError):
        r.ordered(["nope"])
    assert ops[0].cache_key("h") == ops[0].cache_key("h") != ops[0].cache_key("g")

    @r.operator("mark", inputs=("frame",), outputs=("mark",))
    def mark(tables):
        return {"mark": tables["frame"].withColumn("m", F.lit(1))}

    out = planner.execute([r.known["mark"]], {"frame": spark.range(3)})
    assert out["mark"].count() == 3


def test_live(spark, tmp_path):
    src = spark.createDataFrame([(u, float(t)) for u, ts in {1: [0, 1, 2, 10, 11, 30], 2: [5, 30, 31]}.items() for t in ts], "user_id long, t double")
    src = src.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    for i, (a, b) in enumerate([(0, 3), (3, 20), (20, 100)]):
        src.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    q = live.utterances(stream).writeStream.format("memory").queryName("utt").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("utt").collect()}
    want = {(u, *x) for u, ts in {1: [0, 1, 2, 10, 11, 30], 2: [5, 30, 31]}.items() for x in live.utterances_of([float(t) for t in ts])[:-1]}
    assert want <= got
    st = spark.createDataFrame([("v", "asr", 5.0), ("v", "ocr", 3.0), ("v", "fine", 9.0)], "video_id string, stage string, last_t double")
    r = live.frontier(st).first()
    assert (r["watermark"], r["stopped_at"]) == (3.0, 9.0)


def test_sampling(spark):
    f = spark.createDataFrame([("v", t / 10) for t in range(50)], "video_id string, t double")
    assert [r["t"] for r in sampling.sample_frames(f, ["video_id"], "t", 1.0).orderBy("t").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    c = sampling.audio_chunks(spark.createDataFrame([(900_000,), (1,), (0,)], "n_samples long")).collect()
    assert [(r["s0"], r["s1"]) for r in c if r["n_samples"] == 900_000] == [(0, 480_000), (400_000, 880_000), (800_000, 900_000)]


def test_windows(spark):
    rows = _mention_rows(spark)
    assert {r["id"] for r in windows.spans_since(rows, 55.0).collect()} == {"2", "5", "6"}
    t = windows.window_text(rows, [(500, 520)]).where("kind = 'ocr'").first()
    assert (t["n"], t["text"]) == (1, "ANTHROPIC")
    ranks = spark.createDataFrame([(1,), (3,), (None,)], "rank int")
    r = evaluation.retrieval(ranks).first()
    assert r["hit1"] == pytest.approx(1 / 3) and r["mrr"] == pytest.approx((1 + 1 / 3) / 3)


def test_jobs(spark, tmp_path):
    f = jobs.Files(spark, f"file://{tmp_path}/jobs")
    assert jobs.load(f, "j") == {}
    jobs.save(f, "j", {"asr": {"state": "running", "last_t": 3.0}})
    jobs.save(f, "j", {"asr": {"state": "done", "last_t": 9.0}})
    assert jobs.load(f, "j")["asr"]["last_t"] == 9.0
    assert not jobs.mark(f, "k", 5, 1, 0) and jobs.mark(f, "k", 6, 0, 0) and jobs.marked(f, ["k", "x"]) == {"k"}
    done = {"asr": {"state": "done"}, "describe": {"state": "done"}}
    assert jobs.index_state(done, ("describe",)) == "fine" and jobs.index_state(done, ("scenes",)) == "coarse"
    assert jobs.index_state({"asr": {"state": "failed"}}, ()) == "failed"


def test_description_text():
    assert described.description('```json\n{"summary": "A room.", "people": ["a cook"], "objects": [{"name": "chairs", "count": 2}, {"name": "x", "count": 0}, {"name": "pan", "count": 1.6}, "lamp"], "actions": "stirs!", "on_screen_text": null}\n```')[0] == "A room. a cook. 2 chairs, 2 pan, lamp. stirs!"
    assert described.description('{"topics": ["t", ""], "summary": " s ", "visible": ["a", 3]}') == ("s a; 3 t", '{"topics":["t",""],"summary":" s ","visible":["a",3]}')
    assert described.description(" just prose ") == ("just prose", None) and described.description(None) == ("", None) and described.description("[1]") == ("[1]", None)
    assert described.description("{}")[0] == "{}"


def test_object_in():
    assert described.object_in('ok {"a": [1, 2,], "b": "x,}",} bye') == {"a": [1, 2], "b": "x,}"}
    assert described.object_in('{"a": "q\\",]"}') == {"a": 'q",]'} and described.object_in("[1]") is None and described.object_in(None) is None and described.object_in("} {") is None


def test_extraction(spark):
    asked = spark.createDataFrame([("v", 300.0, '{"entities": [{"name": "Bob  Lee", "kind": "place"}], "events": [{"t0": 301, "t1": 300, "text": "late", "participants": ["ann", "bob lee"]}]}'), ("v", 0.0, '{"entities": [{"name": " bob lee", "kind": "person", "mentions": [{"t0": 1, "t1": 2}]}, {"name": ""}], "events": [{"t0": 1, "t1": 4, "text": "early", "participants": ["Bob Lee", "ann"]}, {"t0": 1}]}'), ("w", 0.0, "no")], "video_id string, w0 double, reply string")
    found = described.extracted(asked)
    assert [tuple(r) for r in described.entities(found).collect()] == [("v", "bob lee", "bob lee", "person", 1)]
    assert sorted(tuple(r)[1:] for r in described.events(found).collect()) == [(1.0, 4.0, "early", ["bob lee"]), (301.0, 301.0, "late", ["bob lee"])]
    lines = spark.createDataFrame([("v", 310.0, "b"), ("v", 5.0, "a"), ("v", 1.0, "c")], "video_id string, t double, line string")
    assert [tuple(r) for r in described.prompts(lines).orderBy("w0").collect()] == [("v", 0.0, "c\na"), ("v", 300.0, "b")]


def test_described_before(spark):
    seg = spark.createDataFrame([("s1",), ("s2",)], "id string")
    d = spark.createDataFrame([("segment", "s1", "p1"), ("segment", "s2", "p2")], "target_kind string, target_id string, provenance_id string")
    prov = spark.createDataFrame([("p1", "vlm_describe", "h", "o", "m"), ("p2", "vlm_describe", "other", "o", "m")], "id string, operator string, prompt_hash string, provider string, model string")
    assert [r["id"] for r in described.undescribed(seg, d, prov, "h", "o", "m").collect()] == ["s2"]


def test_job_files_take_each_others_place(spark, tmp_path):
    files = jobs.Files(spark, f"file://{tmp_path}/jobs")
    for k in range(3):
        jobs.save(files, "j", {"asr": {"done": k}})
    assert jobs.load(files, "j") == {"asr": {"done": 2}} and jobs.load(files, "other") == {}
    assert [p.name for p in (tmp_path / "jobs").iterdir() if not p.name.startswith(".")] == ["job-j.json"]


def test_reranked(spark):
    rows = spark.createDataFrame([("1", "a cat"), ("2", "cat dog"), ("3", None), ("4", "dog cat")], "id string, text string")
    assert [r["id"] for r in providers.reranked(rows, "dog cat", providers.OverlapReranker(), 3).collect()] == ["2", "4", "1"]


def _streamed(spark, tmp_path, make, rows, schema):
    for k in range(0, len(rows), 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def test_live_shots_and_utterances(spark, tmp_path):
    """Streams keyed by strings: the open shot a tick, the closed one once; what they come to equals the batch."""
    at = lambda t: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)
    d = [0.0, 0.01, 0.02, 0.01, 0.9, 0.0, 0.01, 0.02]
    rows = [("v", float(i), d[i], at(i)) for i in range(8)]
    schema = "video_id string, t double, d double, ts timestamp"
    got = _streamed(spark, tmp_path / "a", lambda s: live.shots(s, tick=3.0), rows, schema)
    closed = [r for r in got if r[4]]
    assert closed == [("v", 0, 0.0, 4.0, True, 4.0)] and {(r[1], r[5]) for r in got if not r[4]} >= {(0, 3.0), (1, 6.0)}
    batch = [("v", *r) for r in live.shots_by_tick([r[1] for r in rows], d, 3.0)]
    ups = spark.createDataFrame(batch, "video_id string, number long, t0 double, t1 double, closed boolean, at double")
    assert [tuple(r) for r in live.latest_shots(ups, ["video_id"]).orderBy("number").collect()] == [("v", 0, 0.0, 4.0, True), ("v", 1, 4.0, 7.0, False)]
    rows = [("w", t, at(t)) for t in (0.0, 1.0, 2.0, 9.0, 10.0, 30.0, 60.0, 61.0)]
    got = _streamed(spark, tmp_path / "b", lambda s: live.utterances(s, "video_id"), rows, "video_id string, t double, ts timestamp")
    assert set(got) >= {("w", 0.0, 2.0, 3), ("w", 9.0, 10.0, 2)}


def test_questions(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"key": "k1", "video_id": "v", "question": "why", "answer_choice_0": "a", "answer_choice_1": "b", "answer": "b"}, {"key": "k2", "question": "x", "answer": "c", "answer_id": 2}, {"key": "k3"}]))
    got = [tuple(r)[1:6] for r in questions.read(spark, "minerva", f"{tmp_path}/m.json").orderBy("id").collect()]
    assert got == [("minerva-k1", "v", "why", ["a", "b"], "B"), ("minerva-k2", None, "x", ["c"], "C")]
    (tmp_path / "h.csv").write_text("video_id,question,options,answer\nv9,\"what, then\",a | b, b)\n")
    got = [tuple(r)[2:6] for r in questions.read(spark, "onehour_videoqa", f"{tmp_path}/h.csv").collect()]
    assert got == [("v9", "what, then", ["a", "b"], "B")]
    (tmp_path / "l.jsonl").write_text(json.dumps({"key": "k", "qa": [{"question": "Q\n(A) one\nmore\n(B) two", "answer": "a"}, {"question": "no options", "answer": "b"}]}) + "\n")
    got = [tuple(r)[3:6] for r in questions.read(spark, "lvbench", f"{tmp_path}/l.jsonl").orderBy("id").collect()]
    assert got == [("Q", ["one more", "two"], "A"), ("no options", [], "B")]


def test_zoom_pixels_on_an_edge(spark):
    """A crop widened around its centre begins on the pixel that centre less 32 names, also where that is a whole number."""
    def axis(since, size, whole):
        a, z = since * whole, (since + size) * whole
        if z - a < 64:
            a, z = (a + z) / 2 - 32, (a + z) / 2 + 32
        a, z = (0.0, z - a) if a < 0 else (a, z)
        a, z = (a - (z - whole), float(whole)) if z > whole else (a, z)
        start = int(max(a, 0.0) // 1)
        return start, max(min(-int(-z // 1), whole) - start, 1)

    values = [46.05, 42.3, *(i / 20 for i in range(8000))]
    rows = spark.createDataFrame([(v / 400,) for v in values], "x double")
    p = views.pixels(views.region(F.col("x"), F.lit(0.1), F.lit(0.001), F.lit(0.5)), F.lit(1280), F.lit(720))
    got = [tuple(r) for r in rows.select("x", p.alias("p")).select("x", "p.x", "p.w").collect()]
    assert [r[1:] for r in got[:2]] == [(116, 64), (104, 64)]
    assert all(r[1:] == axis(min(r[0], 0.999), min(0.001, 1 - min(r[0], 0.999)), 1280) for r in got)


def test_search_without_index(spark, sf, tmp_path):
    """A search in a session that has written no index passes over the texts: it writes none, sends none to Python and shuffles none, and answers as the index does."""
    b = queries.base(spark, sf)
    known = spark.sparkContext.__dict__.setdefault("_chronolens_indexes", {})
    before = dict(known)
    known.clear()
    try:
        source = b.index()
        hits = lexical.bm25(source, queries.QUERY)
        found = mentions.mentions(source, queries.TERMS)
        assert not known
        for df in (hits, found):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" not in plan and "text-index" not in plan
            assert not any("Exchange" in line and "text" in line.split("Exchange")[1] for line in plan.splitlines())
        index = TextIndex(spark, f"file://{tmp_path}/i").append(b.evidence, 0)
        key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
        assert key(hits) == key(lexical.bm25(index, queries.QUERY)) and key(hits)
        assert key(found) == key(mentions.mentions(index, queries.TERMS)) and key(found)
        known[sf] = index
        assert b.index() is index
    finally:
        known.clear()
        known.update(before)


def test_threads_of_the_driver_are_few(spark):
    """Spark's pools for exchanges are limited before the first query needs them, unless the session names limits of its own."""
    spark.sparkContext._chronolens_sent = False
    session.ready(spark)
    limits = [int(spark.conf.get(k)) for k in session.THREADS]
    assert limits == [int(v) for v in session.THREADS.values()] and max(limits) <= 32
