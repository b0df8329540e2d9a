"""Training-data operators against brute force, with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import ann, bpe_automaton, chat, language_id, license_scan, near_copies, packing, quality, shingling, simhash, suffix_dedup, topk
from chronolens.llm.common import small_batches, tokenizer_path

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The driver's texts, some awkward ones, repeated rows and a clashing column."""
    small_batches(spark)
    odd = [(9001, "a" * 450), (9002, None), (9003, ""), (9004, "xyz" * 200), (9005, "é" * 250), (9006, "w " * 100), (9007, "w " * 100), (9008, "hi <|endoftext|>  there\n\n x"), (9009, "x"), (9009, "x"), (None, "no id"), (9010, "word " * 30_000)]
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return some.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("th", F.lit(1)).withColumn("key", F.lit("k")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_bpe_against_library(docs, texts, none, tokenizer):
    want = collections.Counter()
    for i, t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in bpe_automaton.bpe_digests(docs, tokenizer_path()).collect())
    assert got == want
    assert bpe_automaton.bpe_digests(none, tokenizer_path()).count() == 0


def test_bpe_words(tokenizer):
    r = random.Random(3)
    enc = bpe_automaton.Encoder(tokenizer_path(), bytes, limit=50)
    pool = ["abcdeothn", "a aa\n\t  .'s!é日本​\U0001f600", "  \n", "".join(map(chr, range(1, 300)))]
    for _ in range(600):
        t = "".join(r.choice(pool[r.randrange(4)]) for _ in range(r.randint(0, 40)))
        ids = np.frombuffer(b"".join(enc.parts([t])[0]), np.uint32).tolist()
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        assert enc.machine.decode(ids).decode() == t
    m = enc.machine
    for w in ("aaaaaaa", "ontionthe", "=" * 300):
        assert m.word(w.encode()) == np.frombuffer(m.words([w.encode()])[0], np.uint32).tolist()
        assert all(m.arc(a, b) for a, b in zip(m.word(w.encode()), m.word(w.encode())[1:]))


def test_bpe_gadgets():
    """Cells worked out from the gadgets are those of the table that the gadgets make one after another."""
    m = bpe_automaton.automaton(tokenizer_path())
    tokens, table = bpe_automaton.compiled(m, 700)
    ids = np.array(tokens)
    a, b = np.divmod(np.arange(len(ids) ** 2), len(ids))
    assert (m._arcs(ids[a], ids[b], 701) == table[a, b]).all() and table.any() and not table.all()
    small = bpe_automaton.compiled(m, 60)
    assert small[1].shape == (256 + 60,) * 2


def test_bpe_code_points(tokenizer):
    """Every code point of the lower planes, alone and among letters, and random strings: ids and decoded text."""
    enc = bpe_automaton.Encoder(tokenizer_path(), bytes)
    points = [chr(c) for c in [*range(1, 0x3100), *range(0x1F300, 0x1F700)]]
    texts = ["".join(points[i : i + 7]) for i in range(0, len(points), 7)] + ["a" + c + " " + c + "b\n" for c in points]
    r = random.Random(9)
    pool = [" ", "  ", "\n", "\t", "\0", "\x85", "\u00a0", "\u3000", "<|endoftext|>", "'s", "the", "ing", "É", "9", "!", "日本"]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(8000)]
    for t, p in zip(texts, (x for ts in bpe_automaton.sliced(texts) for x in enc.parts(ts))):
        ids = np.frombuffer(b"".join(p), np.uint32).tolist()
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids == want, repr(t)
        assert enc.machine.decode(ids).decode("utf-8", "replace") == tokenizer.decode(want, skip_special_tokens=False), repr(t)


def test_packing(docs, texts, none, tokenizer):
    r = packing.packed_pieces(docs, tokenizer_path()).toPandas()
    count = collections.Counter(i for i, _ in texts)
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END], "<u4") for i, t in texts}
    for i, g in r.groupby("doc_id"):
        pieces = sorted(g[["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None))
        assert sum(p[1] for p in pieces) == len(ids[i]) * count[i]
        for start, length, crc, total in pieces:
            assert total == len(ids[i]) and zlib.crc32(ids[i][start : start + length].tobytes()) == crc
    assert r["doc_id"].isna().sum() == 1
    for _, g in r.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.append(0, g["length"].cumsum().to_numpy()[:-1])).all() and g["length"].sum() <= 2048
    whole = packing.packed_sequences(docs, tokenizer_path()).toPandas()
    assert set(whole["ids"].map(len)) <= {2048, *(1 << k for k in range(11))}
    assert sum(len(x) for x in whole["doc_ids"]) == len(r)
    assert packing.packed_pieces(none, tokenizer_path()).count() == 0


def test_packing_paths():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, 300), rng.integers(30_000, 30_500, 300)
    ids = [np.append(x, rng.integers(0, 50_000, 5)).astype(np.uint32) for x in (a, b, a, b, a, b)]
    paths = packing.walk(packing.graph(ids))
    order = [i for p in paths for i in p]
    assert sorted(order) == list(range(6)) and sum(x % 2 != y % 2 for x, y in zip(order, order[1:])) == 1
    assert packing.walk(packing.graph(ids[:1])) == [[0]]


def _brute_repeats(texts):
    raws = [(i, t.encode()) for i, t in texts]
    count = collections.Counter(r[s : s + 200] for _, r in raws for s in range(len(r) - 199))
    out, seen = [], set()
    for i, r in raws:
        every, later = np.zeros(len(r) + 1, int), np.zeros(len(r) + 1, int)
        for s in range(len(r) - 199):
            w = r[s : s + 200]
            for m in ([every] if count[w] > 1 else []) + ([later] if w in seen else []):
                m[s] += 1
                m[s + 200] -= 1
            seen.add(w)
        out.append((i, r, every.cumsum()[:-1] > 0, later.cumsum()[:-1] > 0))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, docs, texts, none, hot):
    small = [(i, t) for i, t in texts if len(t) < 10_000 and i is not None and i != 9009]
    df = spark.createDataFrame(small, DOCS).withColumn("spans", F.lit("x"))
    want, kept = collections.Counter(), {}
    for i, r, every, later in _brute_repeats(sorted(small)):
        left = bytes(np.frombuffer(r, np.uint8)[~every])
        spans = int((np.diff(np.append(0, every.astype(int))) == 1).sum())
        want[i, len(r), int(every.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
        kept[i] = bytes(np.frombuffer(r, np.uint8)[~later]).decode("utf-8", "ignore")
    assert collections.Counter(tuple(r) for r in suffix_dedup.digests(df, hot).collect()) == want
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(df, hot).collect()} == kept
    if hot > 1:
        assert suffix_dedup.digests(none).count() == 0 and suffix_dedup.deduplicated(none).count() == 0
        assert suffix_dedup.digests(docs).count() == len(texts)


def test_runs_of_long_texts(monkeypatch):
    """Stretches change nothing."""
    rng = random.Random(3)
    raw = ["".join(rng.choice("ab c") for _ in range(n)).encode() for n in (5000, 150, 200, 3000, 900)] + [b"a" * 4000, b""]
    want = [sorted(zip(*map(np.ndarray.tolist, suffix_dedup.runs(raw))))]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 301)
    assert [sorted(zip(*map(np.ndarray.tolist, suffix_dedup.runs(raw))))] == want
    assert sum(x[2] for x in want[0]) == sum(max(0, len(r) - 199) for r in raw)


def test_longest_previous_factor():
    text = b"abracadabra abracadabra"
    order, lcp = suffix_dedup.suffix_order(np.frombuffer(text + bytes(16), np.uint8), np.arange(len(text)), 16)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: ((text + bytes(16))[i : i + 16], i))
    true = [0] + [next(k for k in range(16, -1, -1) if (text + bytes(16))[a : a + k] == (text + bytes(16))[b : b + k]) for a, b in zip(order, order[1:])]
    lpf = suffix_dedup.longest_previous_factor(order, np.array(true), np.arange(len(text)))
    for i in range(len(text)):
        best = max((next(k for k in range(16, -1, -1) if (text + bytes(16))[i : i + k] == (text + bytes(16))[j : j + k]) for j in range(i)), default=0)
        assert lpf[i] == best


def _fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 2])
def test_simhash(spark, texts, none, hot):
    some = [x for x in texts if x[0] != 9010 and len(x[1]) < 8000]
    fp = [_fingerprint(t) for _, t in some]
    root = _components(len(fp), ((a, b) for b in range(len(fp)) for a in range(b) if (fp[a] ^ fp[b]).bit_count() <= 3))
    least = {}
    for (i, _), r in zip(some, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = collections.Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(some, fp, root))
    assert collections.Counter(tuple(r) for r in simhash.near_groups(spark.createDataFrame(some, DOCS), hot=hot).collect()) == want
    assert simhash.near_groups(none).count() == 0


def test_gray_index():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 40)).astype(np.uint64), axis=0) for k in (1, 1, 2, 3, 5)]))
    key = rng.integers(0, 3, len(fp))
    o = np.lexsort((simhash.gray_rank(fp), key))
    key, fp = key[o], fp[o]
    a, b = simhash.GrayIndex(key, fp).pairs(0, len(fp), 3)
    want = {(i, j) for j in range(len(fp)) for i in range(j) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and want
    g = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    assert simhash.gray_rank(g).tolist() == list(range(64))


@pytest.mark.parametrize("hot,block", [(near_copies.HOT, near_copies.BLOCK), (1, 2)])
def test_near_copies(spark, texts, none, hot, block):
    rng = random.Random(1)
    some = [x for x in texts if x[0] not in (None, 9009) and len(x[1]) < 8000]
    for n, (_, t) in enumerate(some[:60]):
        w = t.split(" ")
        for k in range(0, len(w), rng.choice([15, 40, 100])):
            w[k] = "changed"
        some.append((20_000 + n, " ".join(w)))
    sh = []
    for _, t in some:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", low).split(" ")
        w = [x for x in w if x] or re.findall(r"[^\x20\x09-\x0D]+", low)
        sh.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()})
    pairs = [(a, b) for b in range(len(sh)) for a in range(b) if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]) - 1e-9]
    root = _components(len(sh), pairs)
    least = {}
    for (i, _), r in zip(some, root):
        least[r] = min(least.get(r, i), i)
    got = {r["doc_id"]: r["group"] for r in near_copies.groups(spark.createDataFrame(some, DOCS), hot=hot, block=block).collect()}
    assert got == {i: least[r] for (i, _), r in zip(some, root)}
    assert near_copies.groups(none).count() == 0


def test_one_of_each(spark):
    long = "one two three four five six seven eight nine ten " * 3
    df = spark.createDataFrame([(3, long), (1, long + "end"), (2, "else"), (2, "else"), (None, long), (5, None), (6, "")], DOCS).withColumn("lang", F.lit("en"))
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and sorted((r["doc_id"] or 0) for r in got.collect())[:1] == [0]
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) in ([1, 2, 5], [1, 2, 3, 5])


def test_license_scan(docs, texts, none, spark):
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs).collect()}
    for i, t in texts:
        want = [n for n, x in license_scan.TEMPLATES.items() if x in t]
        assert got[i] in (want or [None])
    s = license_scan.Scanner()
    assert s.scan("so, LICENSED under the (Apache) license -- version 2.0 and more")[0][0] == "Apache-2.0"
    assert s.scan("Licensed under the new Apache License, version 2")[0][1] == pytest.approx(7 / 8)
    assert s.scan(("Released under the MIT License. " * 500))[0][:2] == ("MIT", 1.0)
    assert s.scan(None) == [] == s.scan("the license")
    a, b = "x b c d y e".split(), "b c z d e".split()
    assert [(a[i], b[j]) for i, j in license_scan.align(a, b)] == [("b", "b"), ("c", "c"), ("d", "d"), ("e", "e")]
    assert license_scan.scan(none).count() == 0


def _vectors(spark, n=600, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
    v[7] = v[6]
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    odd = [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] * dim), (1060, [None] * dim), (None, rows[0][1]), (1, rows[1][1])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


def test_top_k(spark):
    rows, df = _vectors(spark)
    ids = np.array([*range(600), 1020])
    v = np.floor(64 * np.array([r[1] for r in rows] + [[0.0] * 16])).astype(int)
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        top = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        want += [(int(ids[i]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(top)]
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(few).collect()) == [(0, 1, 20, 4096), (20, 1, 0, 4096)]
    assert topk.top_k(few.where("false")).count() == 0
    # rounds of queries and blocks of rows change nothing
    was, topk.CELLS = topk.CELLS, 160
    try:
        assert sorted(tuple(r) for r in topk.top_k(df).collect()) == got
    finally:
        topk.CELLS = was


def test_impact_index():
    rng = np.random.default_rng(8)
    v = np.floor(64 * rng.normal(0, 0.125, (4000, 32))).astype(np.int64)
    for (some, score), q in zip(topk.ImpactIndex(v).best(v[:70], 10, np.full(70, -1)), v[:70]):
        true = np.sort(v @ q)[::-1][:10]
        assert (np.sort(score)[::-1][:10] == true).all() and len(some) < 400


def test_nearest(spark):
    rows, df = _vectors(spark, 3000)
    v = np.array([r[1] for r in rows])
    got = collections.defaultdict(list)
    for r in ann.nearest(df, settings=ann.Settings(leaf_rows=64)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for i in range(0, 3000, 100):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        top = [j for j in np.lexsort((np.arange(3000), d)) if j != i][:10]
        assert [x[1] for x in got[i]] == sorted(x[1] for x in got[i]) and all(abs(d[j] - s) < 1e-12 for j, s in got[i])
        hits += len({j for j, _ in got[i]} & set(top))
    assert hits >= 0.9 * 300 and len(got) == 30
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 0.0]), (101, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1, 100, 2.0), (0, 2, 101, 2.0), (100, 1, 101, 0.0), (100, 2, 0, 2.0)]
    assert ann.nearest(few.where("false")).count() == 0
    # blocks of a leaf change nothing once all leaves are visited
    every = {b: sorted(map(tuple, ann.nearest(df, settings=ann.Settings(leaf_rows=64, recall=1.0, queries=10**6, block=b)).collect())) for b in (20, 16_384)}
    assert every[20] == every[16_384]
    huge = spark.createDataFrame([(0, [1e308, 1.0]), (1, [-1e308, 1.0]), (2, [1e308, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(huge).orderBy("rank").collect()] == [(0, 1, 2, 0.0), (0, 2, 1, float("inf"))]


def test_nearest_in_clusters(spark):
    """Clustered rows, a third of them in one tight cluster: recall holds."""
    rng = np.random.default_rng(12)
    centre = rng.normal(0, 1, (30, 16))
    own = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 30, 4000))
    v = (centre[own] + rng.normal(0, 0.05, (4000, 16))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(4000)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, settings=ann.Settings(leaf_rows=64, block=100)).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in range(0, 4000, 100):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += len(got[i] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 400


def test_best_bin_first():
    x = np.random.default_rng(1).normal(0, 1, (2000, 8))
    t = ann.Tree(x, 64, 4)
    leaf = t.file(x)
    assert leaf.max() < t.n_leaves and sorted(t.visits(x[0], t.n_leaves)) == list(range(t.n_leaves))
    assert np.mean([t.visits(q, 1)[0] == a for q, a in zip(x[:200], leaf[:200])]) > 0.7


def test_chat(spark, sf):
    ok = "<|im_end|><|im_start|>assistant ok"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-1, 0, "user", ok), (-1, 1, "assistant", ok), (-2, 0, "user", None), (-2, 0, "user", None), (-3, None, "a\nb", "\\<\\|"), (None, 0, "assistant", "x"), (None, 1, "user", "y")]
    every = rows.unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    want = set()
    talks = collections.defaultdict(list)
    for r in every.collect():
        talks[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    for c, ts in talks.items():
        ts.sort()
        learned = "".join(t for _, r, t in ts if r == "assistant")
        want.add((c, len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    got = chat.chat_digests(chat.linear(every)).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert chat.chat_digests(chat.linear(every.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.parsed("<|im_start|>user\nx")


def test_reply_trees(spark):
    rows = [(1, None, 0.0), (2, 1, 0.5), (3, 1, 0.9), (4, 3, 0.1), (5, 2, 0.8), (6, 99, None), (7, 8, 1.0), (8, 7, 1.0)]
    df = spark.createDataFrame([(*r, 9, "user", "t") for r in rows], "id long, parent long, score double, conv_id long, role string, text string")
    assert sorted(map(tuple, chat.reply_paths(df, 1).collect())) == [(5, 1, 0), (5, 2, 1), (5, 5, 2), (6, 6, 0)]
    tree = df.where("id < 7")
    assert sorted(map(tuple, chat.reply_paths(tree, 1).collect())) == [(5, 1, 0), (5, 2, 1), (5, 5, 2), (6, 6, 0)]
    assert len(chat.reply_paths(tree, None).collect()) == 7
    assert chat.chats(tree, None).count() == 3
    one = chat.chats(df.where("id = 6")).collect()
    assert [(r["path"], r["conv_id"], r["formatted"], r["loss"]) for r in one] == [("6", 9, "<|im_start|>user\nt<|im_end|>\n", [])]
    talk = chat.chats(chat.linear(spark.createDataFrame([(4, 0, "user", "q"), (4, 1, "assistant", "<|a")], "conv_id long, turn long, role string, text string"))).collect()
    assert [(r["conv_id"], [r["formatted"][a:b] for a, b in r["loss"]]) for r in talk] == [(4, ["<\\|a"])]
    assert chat.chats(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="repeated"):
        chat.reply_paths(df.unionByName(df.where("id = 3")))
    assert sorted(map(tuple, chat.reply_paths(df.withColumn("id", F.when(F.col("id") != 6, F.col("id"))), 1).collect())) == [(5, 1, 0), (5, 2, 1), (5, 5, 2)]


def test_language_id(spark, sf, docs, none):
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.trained_and_identified(all_docs).collect()}
    rows = all_docs.collect()
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9
    model = language_id.learn(all_docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. !"), (4, "the and of the"), (5, "und der die das " * 20_000)], DOCS).withColumn("lang", F.lit("xx"))
    r = {x["doc_id"]: x for x in language_id.identify(odd, model).collect()}
    assert [r[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and r[1]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in r.values())
    assert language_id.identify(none, model).count() == 0 and language_id.learn(all_docs.where("false")) == {}
    assert {x["lang_pred"] for x in language_id.identify(odd, {}).collect()} == {"und"}
    assert sorted(x["doc_id"] for x in language_id.kept(odd, model).collect()) == [4, 5]
    # ties are rejected, however short the text
    c = language_id.Classifier(model, language_id.Settings())
    assert not any(c.predict(t)[2] for t in ("x", "ok 7", "qqq www", "qqq www eee " * 3))
    assert len(language_id.learn(all_docs, language_id.Settings(languages=2))) == 2


def test_quality(spark, sf, none):
    d, lab = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.trained_and_scored(d, lab).collect()}
    test = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in lab.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in test]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "y")], DOCS).withColumn("score", F.lit("s"))
    model = quality.learn(d, lab)
    r = [(x["doc_id"], x["score"]) for x in quality.score(odd, model).collect()]
    assert len(r) == 4 and dict(r)[1] == dict(r)[2]
    assert quality.score(none, model).count() == 0 and quality.learn(d, lab.where("quality = 1")) is None
    assert {x["score"] for x in quality.score(odd, None).collect()} == {0.5}


def test_quality_attends():
    """A short stretch of junk in a long clean text gets the weight that its passages need."""
    rng = random.Random(0)
    clean = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [clean(400) for _ in range(60)] + [clean(300) + " " + "### " * 200 + clean(100) for _ in range(60)]
    x, first = quality.passages(texts)
    y = np.array([1.0] * 60 + [0.0] * 60)
    m = quality.AttentionBag(quality.Settings(steps=300)).fit(x, first, y, np.ones(120))
    assert ((m.scores(texts) >= 0.5) == y).all()
    # one pass over all passages, by the formula, gives the same, however few are held at a time
    for i in (0, 70):
        xs, h = (x[first[i] : (np.append(first, len(x)))[i + 1]] - m.mean) / m.scale, None
        h = np.tanh(xs @ m.p["W"] + m.p["b"])
        w = np.exp((np.tanh(h @ m.p["V"]) / (1 + np.exp(-(h @ m.p["U"])))) @ m.p["w"])
        want = 1 / (1 + np.exp(-((w / w.sum()) @ h @ m.p["c"] + m.p["o"][0])))
        was, quality.TOGETHER = quality.TOGETHER, 3
        try:
            assert abs(m.scores([None, texts[i], "x"])[1] - want) < 1e-6
        finally:
            quality.TOGETHER = was


def test_quality_reads_words():
    """Classes that differ in their words alone are told apart, in texts unseen and from the ends of long ones."""
    rng = random.Random(1)
    a, b = (["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)] for _ in range(2))
    text = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    texts = [text(a if i % 2 else b, 60) for i in range(400)]
    x, first = quality.passages(texts)
    m = quality.AttentionBag(quality.Settings(steps=300)).fit(x, first, np.arange(400) % 2 * 1.0, np.ones(400))
    new = [text(a if i % 2 else b, 60) for i in range(100)]
    assert ((m.scores(new) >= 0.5) == np.arange(100) % 2).mean() > 0.95


def test_quality_gradient():
    """The gradient that fit takes is that of its loss, by finite differences."""
    texts = ["ab cd. " * 200, "## ## " * 120, "x"]
    x, first = quality.passages(texts)
    m = quality.AttentionBag(quality.Settings(steps=1, batch=64, rate=1e-6, decay=0.0))
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    before = {k: v.copy() for k, v in m.p.items()}
    m.fit(x, first, y, w)
    pick = np.random.default_rng(11).integers(0, 3, 64)

    def loss(p):
        m.p = p
        out = m._forward((x - m.mean) / m.scale, first)[5]
        each = np.log1p(np.exp(-out)) * y + np.log1p(np.exp(out)) * (1 - y)
        return each[pick].mean()

    after = m.p
    for k in ("V", "U", "w", "c", "b"):
        at = np.unravel_index(np.abs(before[k]).argmax(), before[k].shape)
        up, down = ({n: v.copy() for n, v in before.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        # the first step of Adam goes by the sign of the gradient
        assert abs(slope) < 1e-7 or np.sign(before[k][at] - after[k][at]) == np.sign(slope), k


def test_quality_learns_from_long_texts(spark):
    rows = [(i, ("good word " if i % 2 else "### $$ ") * 6000) for i in range(40)]
    d = spark.createDataFrame(rows, DOCS)
    model = quality.learn(d, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"), quality.Settings(steps=60))
    assert {r["doc_id"] for r in quality.kept(d, model).collect()} == set(range(1, 40, 2))


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_packing_graph_over_all(spark, monkeypatch):
    """A neighbour is found wherever the order by least words puts it, and shares a block."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for i in range(150):
        own = [word() for _ in range(60)]
        rows += [(2 * i, " ".join(own + [word() for _ in range(20)])), (2 * i + 1, " ".join([word() for _ in range(20)] + own))]
    monkeypatch.setattr(packing, "BLOCK_DOCS", 4)
    df = spark.createDataFrame(rows, DOCS)
    got = packing.packed_pieces(df, tokenizer_path()).toPandas().sort_values(["sequence_id", "offset"])["doc_id"].tolist()
    got = list(dict.fromkeys(got))
    assert sorted(got) == list(range(300))
    place = {d: k for k, d in enumerate(got)}
    assert sum(abs(place[2 * i] - place[2 * i + 1]) == 1 for i in range(150)) >= 145


def test_packing_long_texts(spark, monkeypatch):
    """Texts of several windows stand beside their near copies, and texts that share words near each other."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for i in range(30):
        own = [word() for _ in range(3000)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:2800] + [word() for _ in range(200)]))]
    monkeypatch.setattr(packing, "BLOCK_DOCS", 4)
    got = packing.packed_pieces(spark.createDataFrame(rows, DOCS), tokenizer_path()).toPandas().sort_values(["sequence_id", "offset"])["doc_id"].tolist()
    place = {d: k for k, d in enumerate(dict.fromkeys(got))}
    assert len(place) == 60 and sum(abs(place[2 * i] - place[2 * i + 1]) == 1 for i in range(30)) >= 28
    rows = packing._features(packing._keyed(spark.createDataFrame([(1, "same " * 4000), (2, "same " * 4000)], DOCS))).collect()
    assert rows[0]["k1"] == rows[1]["k1"] and rows[0]["item"] == rows[1]["item"]


def test_license_texts_and_marks():
    s = license_scan.Scanner()
    name = lambda t: [h[0] for h in s.scan(t)]
    for n, t in license_scan.TEMPLATES.items():
        assert name(t)[0] == n.partition("#")[0], n
        assert name("Some words before it. " + t + " And some words after it.") == [n.partition("#")[0]], n
    assert name("Licensed under CC BY 4.0.") == ["CC-BY-4.0"] and name("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"]
    assert name("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert name("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert name("Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.") == ["CC-BY-NC-4.0", "CC-BY-SA-4.0"]
    assert name(license_scan.TEMPLATES["BSD"]) == ["BSD"]
    assert name("This is not under the MIT License at all") == [] == name("code never released under any MIT license") == name("It is not released under the MIT License.")
    assert name("Do not touch. Released under the MIT License.") == ["MIT"] and name("Not licensed. Licensed under CC BY 4.0.") == ["CC-BY-4.0"]


def test_alignment_against_brute_force():
    """Aligned words rise on both sides, are equal, and are the longest common subsequence where each word stands once."""
    rng = random.Random(6)
    for _ in range(200):
        a = rng.sample("abcdefghijkl", 9)
        b = rng.sample("abcdefghijkl", 9)
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == len(license_scan._common(a, b))


def test_near_copies_hot_bucket(spark):
    """Two items that share one band alone meet in it, however hot it is."""
    rows = [(i, bytes([i % 250] * 64), [7, *range(1000 + 20 * i, 1015 + 20 * i)]) for i in range(40)]
    rows[31] = (31, rows[5][1], rows[31][2])
    df = spark.createDataFrame(rows, "item long, sig binary, bands array<long>")
    got = {tuple(sorted(r)) for r in near_copies._candidates(df, 0.6, 4).collect()}
    assert got == {(5, 31)}
    # items that only others of their clusters link, across blocks: a chain, each alike to the next alone
    base = np.zeros(64, np.uint8)
    rows = []
    for i in range(30):
        sig = base.copy()
        sig[:] = 200 + i % 3
        sig[:44] = 7 if i % 2 else 9
        rows.append((i, sig.tobytes(), [7, *range(5000 + 20 * i, 5015 + 20 * i)]))
    root = _components(30, [tuple(r) for r in near_copies._candidates(spark.createDataFrame(rows, "item long, sig binary, bands array<long>"), 0.6, 4).collect()])
    assert len({root[i] for i in range(0, 30, 2)}) == 1 == len({root[i] for i in range(1, 30, 2)}) and root[0] != root[1]


def test_near_copies_large_groups(spark):
    """A group of many blocks is linked as one; two groups that one text joins loosely stay apart, whatever the blocks."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    a, b = [word() for _ in range(150)], [word() for _ in range(150)]
    rows = []
    for i in range(600):
        own = list(a if i % 2 else b)
        own[rng.randrange(150)] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000, " ".join(a[:75] + b[75:])), (1001, " ".join(a[:135] + b[135:]))]
    got = {r["doc_id"]: r["group"] for r in near_copies.groups(spark.createDataFrame(rows, DOCS), block=40).collect()}
    assert all(got[i] == i % 2 for i in range(600)) and got[1000] == 1000 and got[1001] == 1


def test_shingling_of_long_texts(monkeypatch):
    """Stretches change nothing, but for runs longer than one without a blank."""
    text = " ".join(random.Random(2).choice(["ab", "c", "defg", "h.i", "É"]) for _ in range(3000))
    whole = [x.tolist() for x in shingling.shingle_sets([text, None, "a b", text])]
    want = simhash.fingerprint(text)
    monkeypatch.setattr(shingling, "STRETCH", 128)
    monkeypatch.setattr(simhash, "STRETCH", 128)
    assert [x.tolist() for x in shingling.shingle_sets([text, None, "a b", text])] == whole
    assert simhash.fingerprint(text) == want == _fingerprint(text)


def test_packing_padding(spark, docs):
    """Padding doesn't depend on the session's number of partitions."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        r = packing.packed_pieces(docs, tokenizer_path()).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    full = r.groupby("sequence_id")["length"].sum()
    assert (full < 2048).sum() <= 1 and full.sum() >= 0.99 * 2048 * len(full)


def test_language_of_long_texts_only(spark):
    rows = [(i, "alpha beta gamma delta epsilon " * 2000, "aa") for i in range(4)] + [(10 + i, "uno dos tres cuatro cinco ", "bb") for i in range(4)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model) == ["aa", "bb"]
    assert language_id.Classifier(model, language_id.Settings()).predict("gamma delta epsilon alpha")[0] == "aa"


def test_language_learns_on_executors(spark, sf, monkeypatch):
    """Dictionaries of the sample in its order, shared lines out; the sample's texts don't come to the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang")
    at = F.xxhash64(F.col("doc_id"), F.lit("language")).bitwiseAND((1 << 53) - 1)
    rows = docs.withColumn("text", F.substring("text", 1, 28_160)).orderBy(at, "text").collect()
    assert max(collections.Counter(r["lang"] for r in rows).values()) <= 400
    spoken = collections.defaultdict(set)
    for r in rows:
        for line in r["text"].split("\n"):
            spoken[language_id.letters(line)].add(r["lang"])
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("texts come to the driver"))
    model = language_id.learn(docs, language_id.Settings(sample_docs=10**6))
    assert set(model) == {r["lang"] for r in rows}
    for lang, got in model.items():
        texts = [" ".join(x for x in map(language_id.letters, r["text"].split("\n")) if len(spoken[x]) == 1) for r in rows if r["lang"] == lang]
        assert got[:2] == ["".join(t + " " for t in texts[k::2]).encode()[:112_640] for k in (0, 1)]
        assert got[2] == language_id.common(texts, 3_072)


@pytest.mark.parametrize("few", [near_copies.FEW, 1])
def test_near_copies_that_bands_miss(spark, few):
    """Two texts at 0.8 that share no band are linked all the same; those below aren't, though a sample finds their shingles common."""

    def pair(i, more):
        words = [f"w{i}x{k}" for k in range(44)]
        return [" ".join(words), " ".join(words + [f"v{i}x{k}" for k in range(more)])]

    two = pair(1188, 10)  # 40 of 50 shingles
    values, count, _ = shingling.shingle_sets(two)
    assert count.tolist() == [40, 50]
    bands = shingling.band_keys(shingling.min_hashes(values, count, near_copies.BANDS * near_copies.ROWS), near_copies.ROWS)
    assert not (bands[0] == bands[1]).any()
    other = [f"{' '.join(f'c{k}' for k in range(30))} {' '.join(f'o{i}x{k}' for k in range(9))}" for i in range(6)]
    rows = list(enumerate(two + pair(1188, 11)[1:] + pair(7, 11) + other))
    got = {r["doc_id"]: r["group"] for r in near_copies.groups(spark.createDataFrame(rows, DOCS)).collect()} if few > 1 else None
    found = near_copies.written(near_copies.features(spark.createDataFrame(rows, DOCS), ["doc_id"]), "shingles")
    name = {r["item"]: r["doc_id"] for r in found.collect()}
    edges = [(name[r["a"]], name[r["b"]]) for r in near_copies.links(found, few=few).collect()]
    sets = [set(v.tolist()) for v in np.split(*(lambda v, c: (v, np.cumsum(c)[:-1]))(*shingling.shingle_sets([t for _, t in rows])[:2]))]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert (1, 0) in want and _components(len(rows), edges) == _components(len(rows), want)
    assert got is None or [got[i] for i in range(len(rows))] == _components(len(rows), want)


@pytest.mark.parametrize("few", [near_copies.FEW, 1])
def test_near_copies_rule_out_by_sketches(spark, monkeypatch, few):
    """Without any band, prefixes link all that is alike; texts that meet there and are far from alike are ruled out before shingles move."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(50):
        own = words[: rng.choice([50, 70, 90])]
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(words[:50] + [f"y{i}z{k}" for k in range(60)])) for i in range(50, 70)]
    found = near_copies.written(near_copies.features(spark.createDataFrame(rows, DOCS), ["doc_id"]), "shingles")
    name = {r["item"]: r["doc_id"] for r in found.collect()}
    same = [(name[r["item"]], r["doc_id"]) for r in found.collect()]
    moved = set()
    pairs, across = near_copies._pairs, near_copies._across

    def seen(run, items, *more):
        moved.update(r[0] for r in items.collect())
        return run

    monkeypatch.setattr(near_copies, "_common", lambda found: np.zeros(0, np.uint32))
    monkeypatch.setattr(near_copies, "_candidates", lambda found, least, hot: found.select(F.col("item").alias("a"), F.col("item").alias("b")).where("false"))
    monkeypatch.setattr(near_copies, "_pairs", lambda p, *more: seen(pairs, p.select("a").union(p.select("b")))(p, *more))
    monkeypatch.setattr(near_copies, "_across", lambda named, *more: seen(across, named.select("item"))(named, *more))
    edges = [(name[r["a"]], name[r["b"]]) for r in near_copies.links(found, few=few).collect()] + same
    sets = [set(v.tolist()) for v in np.split(*(lambda v, c: (v, np.cumsum(c)[:-1]))(*shingling.shingle_sets([t for _, t in rows])[:2]))]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = lambda e: _components(len(rows), [(min(x), max(x)) for x in e])
    assert low(edges) == low(want) and 2 < len(set(low(want)[:50])) < 50
    assert moved and max(name[x] for x in moved) < 50


def test_sketches():
    """Sketches, folded or not, differ in at most as many bits as shingles are in one set alone; blocks link the same as pairs."""
    rng = np.random.default_rng(3)
    sets, label = [], []
    for base in range(6):
        most = np.unique(rng.integers(0, 1 << 32, rng.integers(60, 140), dtype=np.uint32))
        for k in range(12):
            keep = rng.random(len(most)) < rng.choice([0.8, 0.95, 1.0])
            sets.append(np.union1d(most[keep], rng.integers(0, 1 << 32, rng.integers(0, 9), dtype=np.uint32)).astype(np.uint32))
            label.append(base * 12 + k - k % 2)
    sets.append(np.zeros(0, np.uint32))
    label.append(999)
    bits = [near_copies._sketch(x.tobytes()) for x in sets]
    assert len({len(x) for x in bits}) > 1
    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            size = min(len(bits[i]), len(bits[j]))
            x, y = (int.from_bytes(near_copies._folded(z, size)) for z in (bits[i], bits[j]))
            alone = len(np.setxor1d(sets[i], sets[j]))
            assert (x ^ y).bit_count() <= alone
            n = len(sets[i]) + len(sets[j])
            both = (n - alone) // 2
            go = near_copies._may((x ^ y).bit_count(), n, 0.8)
            assert go or both < 0.8 * (n - both)
            if go and label[i] != label[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                pairs.append((j, i))
    root = near_copies._sketch_links(np.array(label), np.array([len(x) for x in sets], np.int32), bits, 0.8).tolist()
    assert pairs and _components(len(sets), [(min(i, r), max(i, r)) for i, r in enumerate(root)]) == _components(len(sets), pairs)


def test_one_of_each_repeated_id(spark):
    """A repeated id with another text is another document; near copies of either don't merge through it."""
    rng = random.Random(5)
    a, b = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (3, a)], DOCS)
    got = sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect())
    assert got == sorted([(1, a), (1, b)])
    df = spark.createDataFrame([(5, a), (5, b), (4, b)], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()) == sorted([(4, b), (5, a)])


def _near_by_brute_force(rows):
    """item -> the (share, item) of its nearest among all that share a min-hash with it, from (item, bands, sig)."""
    item = np.array([r[0] for r in rows])
    bands = np.array([r[1] for r in rows])
    sig = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), -1)
    out = {}
    for i in range(len(rows)):
        share, meet = (sig == sig[i]).mean(1), (bands == bands[i]).any(1)
        meet[i] = False
        best = sorted(zip((-share[meet]).tolist(), item[meet].tolist()))[: packing.NEIGHBOURS]
        if best:
            out[int(item[i])] = [(-s, b) for s, b in best]
    return out


@pytest.mark.parametrize("hot", [4, 25, 10_000])
def test_packing_hot_min_hashes(spark, hot):
    """Nearest ones are the same whatever is too large for one task: pairs that share one hot min-hash, two of them, or most."""
    g = np.random.default_rng(3)
    rows = []
    for i in range(240):
        band = g.integers(1 << 20, 1 << 60, 16)
        sig = g.integers(0, 1 << 16, 16)
        # 80 that share one, 80 that share some of four, 60 near copies that share most, the rest nothing
        shared = [0] if i < 80 else [k for k in range(4) if g.random() < 0.5] if i < 160 else [k for k in range(16) if g.random() < 0.8] if i < 220 else []
        for k in shared:
            which = 0 if i < 80 else 1 if i < 160 else 2
            band[k], sig[k] = 1000 * which + k, 100 * which + k
        rows.append((int(g.integers(-(1 << 62), 1 << 62)), [int(x) for x in band], bytearray(sig.astype("<u2").tobytes())))
    items = spark.createDataFrame(rows, "item long, bands array<long>, sig binary")
    got = {r["item"]: list(zip(r["share"], r["near"])) for r in packing._nearest(items, hot).collect()}
    assert got == _near_by_brute_force(rows)


def test_letters_of_long_texts(monkeypatch):
    """Stretches change nothing, also around repeated words and final sigmas, and a long text's words are not all held at once."""
    import tracemalloc

    rng = random.Random(4)
    texts = ["", "1 2", "ΑΣ'Α ΑΣ 7ΑΣ", "x", "a a a a", "1" * 50 + " a a 1 a"] + [" ".join(rng.choice(["a", "a", "Bb", "ΑΣ", "ΑΣ'", "7", "ß-é", "\n"]) for _ in range(200)) for _ in range(20)]
    whole = [language_id.letters(t) for t in texts]
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(600_000))
    tracemalloc.start()
    language_id.letters(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7 * len(long)
    monkeypatch.setattr(language_id, "STRETCH", 7)
    assert [language_id.letters(t) for t in texts] == whole
