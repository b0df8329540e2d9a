"""More registered queries: joins with provenance, imported structure, live grouping and provider stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import providers
from .operators import catalog, described, evaluation, folds, hybrid, joins, lexical, mentions, views, windows
from .operators.text_index import matched
from .queries import _BM25, _SHOTS, _UNITS, QUERY, query, r6, units
from .session import shared_dir
from .sources import questions, sampling, subtitles
from .streaming import live


@query("J03_spans_by_operator", "SELECT l_orderkey, l_linenumber, l_returnflag AS operator FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'", shared=False)
def j03(b):
    made = b.table("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return b.table("lineitem").where("l_returnflag = 'N'").join(made, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("operator"))


@query("J12_shot_parent", "+ shot AS (SELECT id, video_id, t0 FROM transcript) SELECT shot.id, min(s.id) AS parent FROM shot LEFT JOIN segments s ON s.video_id = shot.video_id AND shot.t0 + 0.001 >= s.t0_secs AND shot.t0 + 0.001 < s.t1_secs GROUP BY shot.id")
def j12(b):
    shot = b.transcript.select("id", "video_id", (F.col("t0") + 0.001).alias("t"))
    seg = b.segments.select("video_id", F.col("id").alias("parent"), F.col("t0_secs").alias("s0"), F.col("t1_secs").alias("s1"))
    found = joins.points_in(shot, seg, ["video_id"], "t", "s0", "s1").groupBy("id").agg(F.min("parent").alias("parent"))
    return shot.select("id").join(found, "id", "left")


_CITED = "+ cit AS (SELECT event_id, 'v' || (event_id % 50) AS video_id, CAST(event_id % 200 AS DOUBLE) AS c FROM events)"


def _cited(b):
    return b.frames.select("event_id", F.concat(F.lit("v"), F.col("event_id") % 50).alias("video_id"), (F.col("event_id") % 200).cast("double").alias("c"))


@query("J14_cited_span", _CITED + " SELECT event_id, count(t.id) AS n FROM cit LEFT JOIN transcript t ON t.video_id = cit.video_id AND t.t0 < c + 60 AND t.t1 > c - 60 GROUP BY event_id")
def j14(b):
    cit = _cited(b).withColumn("a0", F.col("c") - 60).withColumn("a1", F.col("c") + 60)
    near = joins.overlaps(cit, b.transcript.drop("kind"), ["video_id"], "a0", "a1", "t0", "t1").groupBy("event_id").agg(F.count("*").alias("n"))
    return cit.select("event_id").join(near, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("J15_cited_near_anchor", _CITED + " SELECT event_id FROM cit WHERE EXISTS (SELECT 1 FROM segments s WHERE s.video_id = cit.video_id AND s.t0_secs >= c - 90 AND s.t0_secs < c + 90)")
def j15(b):
    band = _cited(b).withColumn("a0", F.col("c") - 90).withColumn("a1", F.col("c") + 90)
    anchors = b.segments.select("video_id", F.col("t0_secs").alias("t"))
    return joins.points_in(anchors, band, ["video_id"], "t", "a0", "a1", 180.0).select("event_id").distinct()


@query("W03_list_rank", _BM25 + " SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank FROM hits")
def w03(b):
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    return lexical.bm25(b.index(), QUERY).select("id", "kind", F.row_number().over(w).cast("long").alias("rank"))


@query("W04_per_video_cap", _BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, kind, id) AS n FROM hits) SELECT video_id, kind, id FROM r WHERE n <= 2")
def w04(b):
    return catalog.ranked_once(lexical.bm25(b.index(), QUERY), ["video_id"], [F.desc("score"), F.col("kind"), F.col("id")], 2).select("video_id", "kind", "id")


@query("T03_filter_before_limit", _BM25 + " SELECT id, round(score, 6) AS score FROM hits WHERE kind = 'ocr' AND t0 >= 500 AND t0 < 100000 ORDER BY hits.score DESC, id LIMIT 10")
def t03(b):
    return lexical.top(lexical.bm25(b.index(), QUERY, kinds=["ocr"], window=(500, 100000)), 10).select("id", r6("score", "score"))


@query("T05_stable_order", "SELECT row_number() OVER (ORDER BY n DESC, video_id) AS place, video_id, n FROM (SELECT video_id, count(*) AS n FROM evidence GROUP BY video_id)")
def t05(b):
    g = b.evidence.groupBy("video_id").agg(F.count("*").alias("n"))
    return mentions.placed(g, [F.desc("n"), F.col("video_id")]).select("place", "video_id", "n")


@query("U02_union_of_spans", "SELECT id, t0, row_number() OVER (PARTITION BY video_id ORDER BY t0, id) AS n FROM (SELECT id, video_id, t0 FROM transcript WHERE t1 > 30 UNION ALL SELECT id, video_id, t0 FROM ocr WHERE t0 >= 30)")
def u02(b):
    u = b.transcript.where("t1 > 30").select("id", "video_id", "t0").unionByName(b.ocr.where("t0 >= 30").select("id", "video_id", "t0"))
    return u.select("id", "t0", F.row_number().over(Window.partitionBy("video_id").orderBy("t0", "id")).cast("long").alias("n"))


@query("U04_claim_sets", "+ s AS (SELECT source, list(DISTINCT lang) AS a, coalesce(list(DISTINCT lang) FILTER (WHERE n_chars > 3000), []) AS e FROM documents GROUP BY source) SELECT source, len(list_intersect(a, e)) AS both_, len(a) - len(list_intersect(a, e)) AS extra FROM s")
def u04(b):
    g = b.table("documents").groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set(F.when(F.col("n_chars") > 3000, F.col("lang"))).alias("e"))
    return g.select("source", F.size(F.array_intersect("a", "e")).cast("long").alias("both_"), F.size(F.array_except("a", "e")).cast("long").alias("extra"))


@query("R10_search_tool", _BM25 + _UNITS + " SELECT video_id, unit, round(score, 6) AS score, least(n_hits, 4) AS n_evidence FROM g2 WHERE n <= 3 ORDER BY g2.score DESC, video_id, unit LIMIT 5")
def r10(b):
    # its SQL gives the first five of lists as deep as those of the tool's own eight
    return hybrid.search(b.index(), units(b), QUERY, k=5, per_video=3, depth=hybrid.list_depth(8)).select("video_id", F.col("unit").cast("long").alias("unit"), r6("score", "score"), F.size("evidence").cast("long").alias("n_evidence"))


@query("R12_nearest_thumbnail", "+ p AS (SELECT event_id AS pid, video_id, t + 0.5 AS t FROM frames), c AS (SELECT pid, f.event_id AS near, abs(f.t - p.t) AS d, f.t AS ft FROM p JOIN frames f ON f.video_id = p.video_id AND f.kind <> 'error' AND f.t >= greatest(p.t - 2, 0) AND f.t < p.t + 2) SELECT p.pid, (SELECT 'b' || arg_min(near, (d, ft)) FROM c WHERE c.pid = p.pid) AS thumbnail_blob FROM p")
def r12(b):
    hits = b.frames.select(F.col("event_id").alias("pid"), "video_id", (F.col("t") + 0.5).alias("t"))
    frames = b.frames.select("video_id", F.col("t").alias("t_secs"), F.when(F.col("kind") != "error", F.concat(F.lit("b"), "event_id")).alias("thumbnail_blob"))
    return hybrid.thumbnails(hits, frames, ["pid"]).select("pid", "thumbnail_blob")


@query("F05_free_text_query", "SELECT kind, id FROM tok WHERE len(list_filter(toks, lambda x: x = 'ering')) > 0 OR len(list_filter(toks, lambda x: starts_with(x, 'estion'))) > 0")
def f05(b):
    return lexical.bm25(b.index(), " the -ering-  (estion) ").select("kind", "id")


@query("F06_phrase_prefix", "SELECT kind, id FROM tok WHERE len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'licensed' AND starts_with(toks[i + 1], 'un'))) > 0")
def f06(b):
    return matched(b.index(), [(["licensed", "un"], True)]).where("f0 > 0").select("kind", "id")


@query("S06_info", """SELECT event_id, event_type AS title, CASE WHEN event_id % 3 = 0 THEN 'c' || user_id ELSE 'u' || user_id END AS channel,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%d') ELSE strftime(TIMESTAMP '1970-01-01' + to_seconds(event_id), '%Y%m%d') END AS day, CAST(value AS DOUBLE) AS duration_secs,
    CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS chapters FROM events""", shared=False)
def s06(b):
    """Info files made of events: some without a channel of their own, some without a readable day, some with an empty chapter."""
    e, i = b.table("events"), F.col("event_id")
    end = F.when(i % 4 == 0, F.lit(5.0)).otherwise(F.lit(9.0))
    chapters = F.array(*[F.struct(F.lit(a).alias("start_time"), z.alias("end_time"), F.lit("t").alias("title")) for a, z in ((0.0, F.lit(5.0)), (5.0, end))])
    file = F.to_json(F.struct(
        F.col("event_type").alias("title"), F.when(i % 3 == 0, F.concat(F.lit("c"), "user_id")).alias("channel"), F.concat(F.lit("u"), "user_id").alias("uploader"),
        F.when(i % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit("soon")).alias("upload_date"), i.alias("timestamp"), F.col("value").alias("duration"), chapters.alias("chapters")))
    raw = e.select("event_id", F.from_json(file, subtitles.INFO).alias("i")).select("event_id", "i.*")
    return subtitles.info(raw, "event_id").select("event_id", "title", "channel", F.date_format("published_at", "yyyyMMdd").alias("day"), "duration_secs", F.size("chapters").cast("long").alias("chapters"))


@query("S07_sidecar_pairing", "+ p AS (SELECT doc_id, string_split(CASE WHEN n_chars > 3000 THEN 'd' || doc_id || '.x.' || lang || '.srt' WHEN n_chars > 1000 THEN 'd' || doc_id || '.' || lang || '.srt' ELSE 'd' || doc_id || '.vtt' END, '.') AS part FROM documents) SELECT doc_id, part[1] AS stem, CASE WHEN len(part) = 3 THEN part[2] END AS lang FROM p WHERE len(part) IN (2, 3)")
def s07(b):
    stem = F.concat(F.lit("d"), "doc_id")
    name = F.when(F.col("n_chars") > 3000, F.concat(stem, F.lit(".x."), "lang", F.lit(".srt"))).when(F.col("n_chars") > 1000, F.concat(stem, F.lit("."), "lang", F.lit(".srt"))).otherwise(F.concat(stem, F.lit(".vtt")))
    return subtitles.with_sidecar_name(b.table("documents").select("doc_id", F.concat(F.lit("file:/x/"), name).alias("path"))).select("doc_id", "stem", "lang")


@query("S16_questions", """SELECT 'lvbench-k' || item_id || '-' || (CASE WHEN item_id % 2 = 0 THEN 'q' || item_id ELSE '0' END) AS id, 'k' || item_id AS video_key, trim(replace(text, chr(10), ' ')) AS question,
    'one more|two' AS options, 'B' AS answer, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'summary' END AS task_types FROM benchmark""", shared=False)
def s16(b):
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n (A) one\nmore\n(B)  two "))
    item = F.col("item_id")
    qa = F.struct(F.when(item % 2 == 0, F.concat(F.lit("q"), item)).alias("uid"), text.alias("question"), F.lit(" b ").alias("answer"), F.when(item % 3 != 0, F.array(F.lit("summary"))).alias("question_type"))
    line = F.to_json(F.struct(F.concat(F.lit("k"), item).alias("key"), F.array(qa).alias("qa")))
    records = b.table("benchmark").select(F.from_json(line, questions.LVBENCH).alias("r")).select("r.*")
    return questions.lvbench(records).select("id", "video_key", "question", F.array_join("options", "|").alias("options"), "answer", F.array_join("task_types", "|").alias("task_types"))


@query("K03_one_embedding_a_target", "SELECT label, vec_id FROM embeddings WHERE vec_id IN (SELECT max(vec_id) FROM embeddings GROUP BY label)", shared=False)
def k03(b):
    e = b.table("embeddings").select(F.lit("frame").alias("target_kind"), F.col("label").alias("target_id"), F.lit("m").alias("model"), "vec_id", F.col("vec_id").alias("seq"))
    return catalog.latest(e, ["target_kind", "target_id", "model"], "seq").select(F.col("target_id").alias("label"), "vec_id")


@query("K08_compacted", "SELECT vec_id, CAST(label AS VARCHAR) AS model, len(embedding) AS dim FROM embeddings WHERE label <> 3", shared=False)
def k08(b):
    """Vectors written twice, some deleted, then the table written anew."""
    e = b.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("frame").alias("target_kind"), F.col("vec_id").cast("string").alias("target_id"), F.col("label").cast("string").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("provenance_id"))
    home = f"{shared_dir(b.spark)}/catalog-{uuid.uuid4().hex}"
    live = catalog.Catalog(b.spark, f"{home}/a").open()
    live.append("embeddings", e.withColumn("dim", F.lit(0)), 0)
    live.append("embeddings", e, 1)
    live.delete("embeddings", e.where("model = '3'"), 2)
    live.compact("embeddings", f"{home}/b")
    return catalog.Catalog(b.spark, f"{home}/b").read("embeddings").select(F.col("target_id").cast("long").alias("vec_id"), "model", F.col("dim").cast("long").alias("dim"))


@query("K10_unit_vectors", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))", shared=False)
def k10(b):
    from .functions.numbers import norm, unit

    return b.table("embeddings").select("vec_id", r6(norm(unit(F.col("embedding"))), "norm"))


@query("O17_chapters_import", "SELECT conv_id, turn AS n, CAST(turn * 15 AS DOUBLE) AS t0, CAST(turn * 15 + 15 AS DOUBLE) AS t1, role AS title FROM conversations WHERE role <> 'system'", shared=False)
def o17(b):
    end = F.when(F.col("role") == "system", F.col("turn") * 15).otherwise(F.col("turn") * 15 + 15).cast("double")
    c = b.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 15).cast("double").alias("start_time"), end.alias("end_time"), F.col("role").alias("title")))).alias("chapters"))
    raw = c.select("conv_id", F.lit("t").alias("title"), F.lit("c").alias("channel"), F.lit("u").alias("uploader"), F.lit("20240101").alias("upload_date"), F.lit(0).cast("long").alias("timestamp"), F.lit("").alias("description"), F.lit(0.0).alias("duration"), "chapters")
    kept = raw.select("conv_id", F.filter("chapters", lambda x: x["end_time"] > x["start_time"]).alias("chapters"))
    return subtitles.imported_chapters(kept, "conv_id").select("conv_id", (F.col("t0") / 15).cast("long").alias("n"), "t0", "t1", "title")


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("O18_description_text", f"""WITH e AS (SELECT event_id, event_type AS e, 'u' || user_id AS u, coalesce({_K}, 0) AS k FROM events)
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN e || ' seen. ' || u || '; a dog. ' || CASE WHEN k > 0 THEN k || ' items, ' ELSE '' END || 'lamp. waves! ' || e
        WHEN 1 THEN e || ' a; ' || u || ' {{"n":1}} x; y' ELSE 'plain ' || e END AS text, event_id % 3 < 2 AS structured FROM e""", shared=False)
def o18(b):
    e, u, k = F.col("event_type"), F.concat(F.lit("u"), "user_id"), F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).cast("string")
    shot = F.concat(F.lit('```json\n{"summary": " '), e, F.lit(' seen", "people": ["'), u, F.lit('", " a dog "], "objects": [{"name": "items", "count": '), k, F.lit('}, "lamp", {"name": "none", "count": "0"}, 7], "actions": "waves!", "on_screen_text": ["'), e, F.lit('"]}\n```'))
    scene = F.concat(F.lit('{"topics": ["x", "y", ""], "summary": "'), e, F.lit('", "visible": ["a", "'), u, F.lit('"], "actions": {"n": 1}, "on_screen_text": null}'))
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, shot).when(kind == 1, scene).otherwise(F.concat(F.lit(" plain "), e))
    return described.described(b.table("events").select("event_id", raw.alias("raw"))).select("event_id", "text", F.col("structured").isNotNull().alias("structured"))


@query("O10_text_embed")
def o10(b):
    return providers.embedded(b.evidence.where(F.trim("text") != ""), providers.HashingEmbedder(16)).select("kind", "id", "vector")


@query("O01_subtitle_import", """+ n AS (SELECT video_id, id, t0, t1, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM (SELECT video_id, id, t0, t1, text FROM transcript UNION ALL SELECT video_id, id || '+', t0 + 15, t1 + 15, text FROM transcript WHERE t0 = 0 UNION ALL SELECT video_id, id || '-', t0 + 1, t1 + 1, text || ' goes on' FROM transcript WHERE t0 = 30)),
    f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t0, id) AS rn FROM n WHERE text <> ''),
    s AS (SELECT video_id, rn, rn AS cue, t0, t1, text AS new, text AS shown FROM f WHERE rn = 1 UNION ALL
        SELECT f.video_id, f.rn, CASE WHEN rep THEN cue ELSE f.rn END, CASE WHEN rep THEN f.s0 ELSE f.t0 END, CASE WHEN rep THEN greatest(f.s1, f.t1) ELSE f.t1 END, CASE WHEN rep THEN f.old WHEN starts_with(f.text, f.shown || ' ') THEN trim(substring(f.text, length(f.shown) + 1)) ELSE f.text END, CASE WHEN rep THEN f.shown ELSE f.text END
        FROM (SELECT f.*, s.cue, s.t0 AS s0, s.t1 AS s1, s.new AS old, s.shown, f.text = s.shown OR ends_with(s.shown, f.text) AS rep FROM s JOIN f ON f.video_id = s.video_id AND f.rn = s.rn + 1) f),
    c AS (SELECT video_id, cue, min(t0) AS t0, max(t1) AS t1, any_value(new) AS text FROM s GROUP BY video_id, cue),
    d AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cue) AS k FROM c),
    g AS (SELECT video_id, k, t0 AS a, t1 AS z, text FROM d WHERE k = 1 UNION ALL
        SELECT d.video_id, d.k, CASE WHEN d.t1 - g.a <= 15 AND d.t0 - g.z <= 2 THEN g.a ELSE d.t0 END, d.t1, d.text FROM g JOIN d ON d.video_id = g.video_id AND d.k = g.k + 1)
    SELECT video_id, a AS t0, arg_max(z, k) AS t1, string_agg(text, ' ' ORDER BY k) AS text FROM g GROUP BY video_id, a""")
def o01(b):
    def fold(p):
        cues = list(p.sort_values(["t0", "id"])[["t0", "t1", "text"]].itertuples(index=False, name=None))
        return folds.group_cues(folds.dedup_rolling(cues))

    t = b.transcript.select("video_id", "id", "t0", "t1", "text")
    again = t.where("t0 = 0").select("video_id", F.concat("id", F.lit("+")).alias("id"), (F.col("t0") + 15).alias("t0"), (F.col("t1") + 15).alias("t1"), "text")
    more = t.where("t0 = 30").select("video_id", F.concat("id", F.lit("-")).alias("id"), (F.col("t0") + 1).alias("t0"), (F.col("t1") + 1).alias("t1"), F.concat("text", F.lit(" goes on")).alias("text"))
    return folds.folded(t.unionByName(again).unionByName(more), ["video_id"], "video_id string, t0 double, t1 double, text string", fold)


@query("O14_word_spans")
def o14(b):
    def fold(p):
        out, at = [], 0.0
        for t in p.sort_values(["t0", "id"])["text"]:
            for w in t.split():
                out.append((w, at, at + 0.3, 0.9))
                at += 0.4
        return folds.shape_words(out) if out else []

    return folds.folded(b.transcript.select("video_id", "id", "t0", "text"), ["video_id"], "video_id string, t0 double, t1 double, text string, confidence double", fold)


@query("L05_utterances", "+ f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS rn FROM frames), s AS (SELECT video_id, rn, t AS a, t FROM f WHERE rn = 1 UNION ALL SELECT f.video_id, f.rn, CASE WHEN f.t - s.t > 3600 OR f.t - s.a > 5400 THEN f.t ELSE s.a END, f.t FROM s JOIN f ON f.video_id = s.video_id AND f.rn = s.rn + 1) SELECT video_id, round(a, 3) AS t0, round(max(t), 3) AS t1, count(*) AS n FROM s GROUP BY video_id, a")
def l05(b):
    """Utterances with both rules, the pause and the length."""
    fold = lambda p: live.utterances_of(p.sort_values(["t", "event_id"]).t.tolist(), 5400.0, 3600.0)
    out = folds.folded(b.frames.select("video_id", "event_id", "t"), ["video_id"], "video_id string, t0 double, t1 double, n long", fold)
    return out.select("video_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "n")


@query("L06_tumbling_counts", "SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY 1, 2", shared=False)
def l06(b):
    g = b.table("events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "60 seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.floor(F.unix_timestamp(F.col("w.start")) / 60).cast("long").alias("minute"), "n")


@query("L07_sliding_chunks", "SELECT user_id, s AS start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(CAST(floor(e / 1800) AS BIGINT) * 1800 - 1800, CAST(floor(e / 1800) AS BIGINT) * 1800, 1800)) AS s FROM (SELECT user_id, epoch(ts) AS e FROM events)) GROUP BY 1, 2", shared=False)
def l07(b):
    g = b.table("events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "3600 seconds", "1800 seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_timestamp(F.col("w.start")).alias("start"), "n")


@query("L09_anchored_clock", "+ g AS (SELECT *, sum(CASE WHEN t - p > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, event_id) AS session, coalesce(n - t > 7200, true) AS flush FROM (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id))) SELECT event_id, CAST(session AS BIGINT) AS session, round(t - min(t) OVER (PARTITION BY video_id, session), 3) AS since, flush FROM g")
def l09(b):
    return live.anchored(b.frames, ["video_id"], ["t", "event_id"], "t", 7200.0).select("event_id", "session", F.round("since", 3).alias("since"), "flush")


@query("L01_readable_below_frontier", "+ st AS (SELECT video_id, kind AS stage, max(t) AS last_t FROM frames GROUP BY video_id, kind), fr AS (SELECT video_id, min(last_t) AS w FROM st WHERE stage IN ('click', 'view') GROUP BY video_id) SELECT event_id FROM frames JOIN fr USING (video_id) WHERE t < w")
def l01(b):
    st = b.frames.groupBy("video_id", F.col("kind").alias("stage")).agg(F.max("t").alias("last_t"))
    lim = live.frontier(st, ("click", "view")).select("video_id", F.col("watermark").alias("until")).where("until is not null")
    return catalog.bounded(b.frames.join(lim.select("video_id"), "video_id", "left_semi"), lim, "t").select("event_id")


@query("L04_open_shots", _SHOTS + """, o AS (SELECT video_id, rn, t, CASE WHEN cut THEN 1 ELSE 0 END AS c FROM s), n AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY rn) AS number FROM o)
    SELECT video_id, CAST(number AS BIGINT) AS number, round(min(t), 3) AS t0, round(CASE WHEN number < max(max(number)) OVER (PARTITION BY video_id) THEN lead(min(t)) OVER (PARTITION BY video_id ORDER BY number) ELSE max(t) END, 3) AS t1, number < max(max(number)) OVER (PARTITION BY video_id) AS closed FROM n GROUP BY video_id, number""")
def l04(b):
    """Upserts of each tick, and what they come to: closed shots, and the one still open."""
    def fold(p):
        p = p.sort_values(["t", "event_id"])
        return live.shots_by_tick(p.t.tolist(), [0.0, *(p.value.diff().abs().iloc[1:] / 500).tolist()], 3600.0)

    ups = folds.folded(b.frames.select("video_id", "event_id", "t", "value"), ["video_id"], "video_id string, number long, t0 double, t1 double, closed boolean, at double", fold)
    return live.latest_shots(ups, ["video_id"]).select("video_id", "number", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "closed")


@query("S12_live_feed", """+ g AS (SELECT 'v' || conv_id AS video_id, CAST(turn * 15 AS DOUBLE) AS a, CAST(turn * 15 + 15 AS DOUBLE) AS z FROM conversations WHERE turn <> 2),
    w AS (SELECT *, max(z) OVER (PARTITION BY video_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM g), e AS (SELECT video_id, min(a) AS a, max(z) AS z FROM g GROUP BY video_id)
    SELECT video_id, a AS t, 'media' AS item FROM g UNION ALL SELECT video_id, a, 'gap' FROM w WHERE a > u + 1e-6 UNION ALL
    SELECT video_id, a + unnest(range(1, CAST(floor((z - a) / 20) AS BIGINT) + 1)) * 20.0, 'tick' FROM e UNION ALL SELECT video_id, z, 'end' FROM e""")
def s12(b):
    seg = b.transcript.where("t0 <> 30").select("video_id", "t0", "t1")
    return sampling.feed(seg, ["video_id"], 20.0)


@query("S12_segment_head", "SELECT video_id, max(t1_secs) AS head, min(t0_secs) AS t0, count(*) AS segments FROM segments GROUP BY video_id")
def s12b(b):
    return sampling.head(b.segments.select("video_id", F.col("t0_secs").alias("t0"), F.col("t1_secs").alias("t1")), ["video_id"])


@query("A19_cited_near", "SELECT event_id, abs(value - 250) <= 90 OR (value - 250 < 0 AND value + 10 >= 160) AS near FROM events", shared=False)
def a19(b):
    c = F.array(F.struct(F.col("value").alias("t0"), (F.col("value") + 10).alias("t1")))
    return b.table("events").select("event_id", evaluation.cited_near(c, F.lit(250.0)).alias("near"))


@query("W11_depth_scores", "+ b AS (SELECT *, value / 500 AS s, lag(value) OVER w AS p FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)), r AS (SELECT *, sum(CASE WHEN p < value THEN 1 ELSE 0 END) OVER w AS l, sum(CASE WHEN p > value THEN 1 ELSE 0 END) OVER w AS r FROM b WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)) SELECT event_id, round(max(s) OVER (PARTITION BY video_id, l ORDER BY t, event_id) - s + max(s) OVER (PARTITION BY video_id, r ORDER BY t DESC, event_id DESC) - s, 6) AS depth FROM r")
def w11(b):
    d = described.depth_scores(b.frames.withColumn("s", F.col("value") / 500), ["video_id"], [F.col("t"), F.col("event_id")], "s")
    return d.select("event_id", r6("depth", "depth"))


@query("R11_view_windows", """SELECT event_id, round(a, 6) AS t0, round(z, 6) AS t1, round(least(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE (event_id % 7) / 2.0 + 0.1 END, n / (z - a)), 6) AS fps, CAST(n AS BIGINT) AS frames FROM (
    SELECT *, least(least(greatest(value - 250 + event_id % 200, a + 0.5), greatest(240.0, a + 0.5)), a + 120) AS z, least(greatest(event_id % 25, 1), 16) AS n FROM (SELECT *, least(greatest(value - 250, 0), 240.0) AS a FROM events))""", shared=False)
def r11(b):
    i = F.col("event_id")
    fps = F.when(i % 5 == 0, F.lit(-1.0)).otherwise((i % 7) / 2 + 0.1)
    v = views.window(F.col("value") - 250, F.col("value") - 250 + i % 200, fps, (i % 25).cast("int"), F.lit(240.0))
    return b.table("events").select("event_id", v.alias("v")).select("event_id", r6("v.t0", "t0"), r6("v.t1", "t1"), r6("v.fps", "fps"), F.col("v.frames").cast("long").alias("frames"))


@query("R11_zoom_pixels", """WITH r AS (SELECT event_id, least(greatest(value / 400, 0), 0.999) AS x, CASE WHEN event_id % 4 = 0 THEN 1 - least(greatest(value / 400, 0), 0.999) ELSE least((event_id % 10) / 20.0 + 0.001, 1 - least(greatest(value / 400, 0), 0.999)) END AS w FROM events),
    a AS (SELECT event_id, x * 1280 AS a, (x + w) * 1280 AS z FROM r), b AS (SELECT event_id, CASE WHEN z - a < 64 THEN (a + z) / 2 - 32 ELSE a END AS a, CASE WHEN z - a < 64 THEN (a + z) / 2 + 32 ELSE z END AS z FROM a),
    c AS (SELECT event_id, greatest(a, 0) AS a, z - least(a, 0) AS z FROM b), d AS (SELECT event_id, greatest(a - greatest(z - 1280, 0), 0) AS a, least(z, 1280) AS z FROM c)
    SELECT event_id, CAST(floor(a) AS BIGINT) AS x, CAST(greatest(least(ceil(z), 1280) - floor(a), 1) AS BIGINT) AS w FROM d""", shared=False)
def r11b(b):
    i = F.col("event_id")
    w = F.when(i % 4 == 0, F.lit(-1.0)).otherwise((i % 10) / 20 + 0.001)
    p = views.pixels(views.region(F.col("value") / 400, F.lit(0.1), w, F.lit(0.5)), F.lit(1280), F.lit(720))
    return b.table("events").select("event_id", p.alias("p")).select("event_id", "p.x", "p.w")


@query("O08_sample_rows", "SELECT video_id AS track_id, CAST(round(t * 1000) AS BIGINT) AS pts, sha256(video_id || '|' || CAST(round(t * 1000) AS BIGINT)) AS id, row_number() OVER (PARTITION BY video_id ORDER BY t) = 1 AS is_keyframe FROM frames QUALIFY row_number() OVER (PARTITION BY video_id, floor((t + 1e-6) / 3600) ORDER BY t) = 1".replace("row_number() OVER (PARTITION BY video_id ORDER BY t) = 1 AS", "t = min(t) OVER (PARTITION BY video_id) AS"))
def o08(b):
    return sampling.frame_rows(sampling.sample_frames(b.frames, ["video_id"], "t", 3600), "video_id", "t").select("track_id", "pts", "id", "is_keyframe")


@query("R08_segments_since", "SELECT id FROM segments WHERE level = 'scene' AND t1_secs > 45")
def r08b(b):
    return windows.segments_since(b.segments, "scene", 45.0).select("id")
