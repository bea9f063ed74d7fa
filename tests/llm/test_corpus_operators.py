"""Every dealt operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import chat, contain, langid, lines, mixing, repeats, secrets, shards, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the queen of old jade and sand"
LONG = " ".join(f"w{i * 7919 % 104729}" for i in range(30_000))


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, copies and repeated rows."""
    own = [f"{PROSE} number {i} {' '.join(f'x{i}y{j}' for j in range(40))}" for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(own)]
    rows += [(20, None, "en", "s0", None), (21, "", None, "s1", 0), (22, " \t\n ", "de", None, 3), (None, PROSE, "en", "s2", 5)]
    rows += [(23, LONG, "en", "s0", 1), (24, LONG, None, None, None), (25, own[0], "en", "s1", 1), (0, own[0], "en", "s0", len(own[0]))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_shards_are_even_and_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("shard", F.lit("mine"))
    out = shards.shard(docs, shards=4).toPandas()
    assert len(out) == docs.count()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() - sizes.min() < out["size"].max() + 0.05 * sizes.mean()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert out.groupby("text")["shard"].nunique().max() == 1
    row = out.iloc[0]
    assert row["size"] == len(row["text"].encode()) + 8 and row["text_crc32"] == zlib.crc32(row["text"].encode())


def test_shards_cut_a_hot_group_and_take_odd_rows(spark, docs, none):
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    out = shards.shard(hot, shards=3).groupBy("shard").count().toPandas()
    assert out["count"].sum() == 900 and out["count"].max() < 330
    odd = shards.shard(docs, shards=3).toPandas()
    assert len(odd) == len(odd_rows()) and odd.loc[odd["doc_id"] == 20, "size"].iloc[0] == 8
    assert shards.shard(none, shards=3).count() == 0


def test_language_gradients():
    w = {k: v.astype(np.float64) for k, v in langid.start_weights(3, 4, 5, 1).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (5, 6)), rng.integers(0, 3, 6)
    x[3:, 2] = langid.PAD
    _, g = langid.gradients({k: v.astype(np.float32) for k, v in w.items()}, x, y)
    for name, at in (("emb", (100, 2)), ("wf", (1, 3)), ("uf", (2, 9)), ("ub", (0, 5)), ("bb", (7,)), ("v", (3, 1)), ("c", (2,))):
        ends = []
        for move in (1e-2, -1e-2):
            v = {k: a.astype(np.float32).copy() for k, a in w.items()}
            v[name][at] += move
            p = langid.position_probabilities(v, x)
            ends.append(-np.log(p[:, y, np.arange(6)][x != langid.PAD]).mean())
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(g[name][at]), abs=2e-3)


def test_language_held_out_accuracy(spark, none, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table)
    out = langid.predict(table.withColumn("score", F.lit("x")), model).withColumn("h", ~langid.in_training(F.col("doc_id"))).toPandas()
    held = out[out["h"]]
    assert len(held) > 250 and (held["lang"] == held["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()
    odd = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert {odd[i]["lang_pred"] for i in (20, 21, 22)} == {"und"} and odd[23]["lang_pred"] in model.langs
    assert langid.train(none) is None and langid.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model).count() == 0
    assert len(langid.label_positions("hello", model)) == 5
    words = next(t for t in table.filter("lang = 'en' AND n_chars > 3000").limit(1).toPandas()["text"]).split()
    shuffled = [" ".join(words), " ".join(sorted(words)), "  ".join(words)]
    p = langid.pool(model, shuffled)
    assert len({tuple(np.round(row, 9)) for row in p}) == 3


def forward(w, data):
    """The distribution at every position, one state after the other over the whole sequence."""
    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    states, hidden = {}, w["uf"].shape[0]
    for d, order in (("f", range(len(data))), ("b", range(len(data) - 1, -1, -1))):
        h, states[d] = np.zeros(hidden), np.zeros((len(data), hidden))
        for t in order:
            a, b = w["emb"][data[t]] @ w["w" + d] + w["b" + d], h @ w["u" + d]
            z, r = sigmoid(a[:hidden] + b[:hidden]), sigmoid(a[hidden : 2 * hidden] + b[hidden : 2 * hidden])
            n = np.tanh(a[2 * hidden :] + r * b[2 * hidden :])
            h = n + z * (h - n)
            states[d][t] = h
    s = np.exp(np.concatenate([states["f"], states["b"]], axis=1) @ w["v"] + w["c"])
    return s / s.sum(axis=1, keepdims=True)


def test_language_windows_equal_the_forward_pass(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 40)
    monkeypatch.setattr(langid, "BLOCK", 300)
    monkeypatch.setattr(langid, "ROWS", 3)
    model = langid.Model(["a", "b", "c"], langid.start_weights(3, 4, 5, 1))
    rng = np.random.default_rng(2)
    texts = ["", "x", "two words", "".join(chr(k) for k in rng.integers(32, 300, 39)), "z" * 40, "", "é \n" * 15]
    exact = [forward(model.weights, t.encode()).mean(axis=0) if t else np.zeros(3) for t in texts]
    near = langid.pool(model, texts)
    short = [i for i, t in enumerate(texts) if len(t.encode()) <= 40]
    assert np.allclose(near[short], np.array(exact)[short], atol=1e-4)
    monkeypatch.setattr(langid, "CONTEXT", 400)
    texts = [*texts, " ".join(["word"] * 60), "many bytes " * 30]
    exact = [forward(model.weights, t.encode()).mean(axis=0) if t else np.zeros(3) for t in texts]
    assert np.allclose(langid.pool(model, texts), exact, atol=1e-4)
    assert langid.label_positions(texts[-2], model) == [model.langs[k] for k in forward(model.weights, texts[-2].encode()).argmax(axis=1)]


def brute_repeats(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_repeats_against_brute_force(spark, docs, window):
    rng = np.random.default_rng(window)
    shared = " ".join(f"p{i}" for i in range(60))
    texts = [t for _, t, *_ in odd_rows()]
    texts += [" ".join(rng.choice(["a", "b", "c"], 200)) for _ in range(6)]
    texts += ["z " * 50, "z " * 34 + "y", "q r " * 40, shared, f"before {shared} after", f"{shared[3:]}", "", "one two"]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    out = repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string"), window).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, window)


def test_repeats_odd_tables(docs, none):
    out = repeats.drop_repeats(docs).toPandas()
    assert len(out) == len(odd_rows())
    assert out.loc[out["doc_id"] == 23, "n_removed"].iloc[0] == 30_000
    assert repeats.drop_repeats(none).count() == 0


def test_top_k_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 6))
    rows = [(i, [float(x) for x in (base[i % 40] if i % 5 else base[0])]) for i in range(400)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan"), 1.0]), (903, [float("inf"), 1.0]), (904, [0.5]), (None, [1.0] * 6), (1000, [3.0] * 6)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(vectors, every=100, k=10, pivots=6, most_rings=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    known = {i: np.floor(1024 * np.pad(np.array(v), (0, 6 - len(v)))).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in (0, 100, 200, 300, 1000):
        best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {0, 100, 200, 300, 1000}
    few = topk.top_k(vectors.filter("vec_id in (100, 101)"), every=100)
    assert [tuple(r)[1:3] for r in few.collect()] == [(1, 101)]
    assert topk.top_k(vectors.filter("vec_id < 0")).count() == 0


def test_top_k_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 12)) * 4
    v = np.floor((centres[rng.integers(0, 20, 2000)] + rng.standard_normal((2000, 12)) * 0.2) * 1024).astype(int)
    v = np.floor(v / np.linalg.norm(v, axis=1, keepdims=True) * 1024).astype(int)
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, v array<long>")
    rows, index = topk.build(vectors, ring_rows=16)
    assert 1.5 * len(set(index.pivot.tolist())) < len(index.names) and index.sizes.sum() == 2000
    queries = vectors.filter("vec_id % 50 = 0")
    found = topk.candidates(queries, rows, index, 10, block=256, queries_per_block=16)
    assert topk.visited_share(found, rows) < 0.3
    got = {}
    for r in topk.search(queries, rows, index, 10, block=256, queries_per_block=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 2000, 50):
        best = sorted((-int(v[q] @ x), i) for i, x in enumerate(v) if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_hot_ring_and_least_scores(spark):
    """A third of the rows equal, rings above the block size, and scores far below zero."""
    rows = [(i, [7, -3]) for i in range(100)] + [(i, [(-1) ** (i // 4) * (i % 4) * 10**9, i]) for i in range(100, 300)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), every=100, k=7, block=32, pivots=4)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, x in rows[::100]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_large_numbers_stay_exact(spark):
    rows = [(0, [3_000_000_001, 1]), (1, [2_999_999_999, 5]), (2, [2_999_999_999, 4])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), every=100, pivots=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, 3_000_000_001 * 2_999_999_999 + 5), (2, 3_000_000_001 * 2_999_999_999 + 4)]


def test_crf_gradient_and_viterbi():
    rng = np.random.default_rng(2)
    n, length = 3, 4
    x = tuple(rng.random(s) for s in ((n, length, secrets.N_SHAPE), (n, length, secrets.N_NEAR), (n, length, secrets.N_NEAR), (n, secrets.N_FILE)))
    y = rng.integers(0, 3, (n, length))
    f = secrets.Field(*(rng.standard_normal(s) * 0.5 for s in ((secrets.N_SHAPE, 3), (secrets.N_NEAR, 3), (secrets.N_NEAR, 3), (secrets.N_FILE, 3), (3, 3), 3)))
    _, g = secrets.likelihood(f, x, y)
    for name, at in (("own", (3, 1)), ("left", (2, 0)), ("file", (1, 2)), ("move", (1, 2)), ("start", (0,))):
        ends = []
        for move in (1e-5, -1e-5):
            getattr(f, name)[at] += move
            ends.append(secrets.likelihood(f, x, y)[0])
            getattr(f, name)[at] -= move
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(getattr(g, name)[at], abs=1e-5)
    tagger = secrets._Tagger(f, 0.0)
    e = rng.standard_normal((5, 3))
    def score(tags):
        return f.start[tags[0]] + e[np.arange(5), tags].sum() + sum(f.move[a, b] for a, b in zip(tags, tags[1:]))
    best = max((tuple(int(k // 3**i % 3) for i in range(5)) for k in range(3**5)), key=score)
    assert tuple(tagger._viterbi(e, True, True)) == best


def test_secrets(spark, none):
    texts = [
        'set PassWord = "hunter2secret" and api_key:abcdef1', "token: abc and secret=short1", "AKIA" + "Z" * 16 + " AKIAZZ", "x" * 3 + "ab12" * 6,
        "password: secret=abcdefgh", None, "", "é token=zzzzzz", "a quiet sentence about nothing",
    ]
    rows = [(i, t, "mine") for i, t in enumerate(texts)]
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = secrets.train(table, max_docs=4000)
    frame = spark.createDataFrame(rows + [(50, "deploy with ghp16C7e42F292c6912E7710c838347Ae178B4a now", "")], "doc_id long, text string, secrets string")
    got = {r["doc_id"]: r for r in secrets.scan(frame, field).collect()}
    for i, t in enumerate(texts):
        spans = []
        for kind, pattern in enumerate((secrets.ASSIGN, secrets.ACCESS, re.compile("[0-9a-f]+"))):
            for m in pattern.finditer(t or ""):
                if (kind == 0 and len(m.group(2)) >= 6) or (kind == 1 and len(m.group()) >= 20) or (kind == 2 and len(m.group()) >= 24):
                    spans.append((m.start(), kind, m.end()))
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in got[i]["span_text"].split(",") if x and not x.startswith("crf")] == ([x for x in text.split(",") if x])
    assert got[8]["span_text"] == "" and got[5]["secrets"] == []
    assert got[50]["span_text"] == "crf:12:53" or got[50]["span_text"].startswith("crf:12:")
    # Secrets that no pattern knows, each at some word boundary of a text: found whole, and nothing beside them.
    rng = np.random.default_rng(5)
    planted, places = [], {}
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    for i, row in enumerate(r for r in table.filter("n_chars > 100").limit(400).toLocalIterator()):
        secret, words = ("ghp_" if i % 2 else "") + "".join(rng.choice(letters, 32)), row["text"].split(" ")
        at = int(rng.integers(1, len(words)))
        start = len(" ".join(words[:at])) + 1
        planted.append((i, " ".join([*words[:at], secret, *words[at:]])))
        places[i] = (start, start + len(secret))
    added = {
        r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "crf"]
        for r in secrets.scan(spark.createDataFrame(planted, "doc_id long, text string"), field).collect()
    }
    assert sum(added[i] == [place] for i, place in places.items()) > 0.9 * len(places)
    assert sum(spot != places[i] for i, spots in added.items() for spot in spots) <= 4


def test_cover_equals_all_spans():
    rng = np.random.default_rng(3)
    for _ in range(50):
        spans = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 60, 8), rng.integers(1, 15, 8))]
        cover = secrets.Cover(spans)
        for place, before in rng.integers(0, 80, (30, 2)).tolist():
            assert cover.reaches(place, before) == any(s < before and e > place for s, e in spans)
    assert not secrets.Cover([]).reaches(0, 5)


def test_secret_scan_empty_tables(none):
    assert secrets.train(none) is None and secrets.scan(none, None).count() == 0


def print_of(text):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, none):
    rng = np.random.default_rng(9)
    values = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    for v in values[:30]:
        for _ in range(3):
            a, b = rng.integers(0, 64, 2)
            flipped = (v % (1 << 64)) ^ (1 << int(a)) ^ (1 << int(b))
            values.append(flipped - (1 << 64) if flipped >= 1 << 63 else flipped)
    values = sorted(set(values))
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for distance in (0, 1, 2, 3, 5):
        want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= distance}
        found = [(r["a"], r["b"]) for r in simhash.links(prints, distance).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(odd_rows())
    by = {r["doc_id"]: r for r in out}
    assert by[20]["component_id"] == by[21]["component_id"] == by[22]["component_id"] == 20
    assert by[25]["component_id"] == 0 and by[24]["component_id"] == 23
    for i, t, *_ in odd_rows():
        assert by[i]["fp"] % (1 << 64) == print_of(t)
    kept = simhash.keep_one(docs.withColumn("fp", F.lit(1))).collect()
    assert len(kept) == len({r["root"] for r in out}) and {"fp", "text"} <= set(kept[0].asDict())
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_mixing(spark, docs, none):
    table = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 40_000, "big").when(F.col("id") < 59_000, "mid").alias("source"))
    wish = spark.createDataFrame([("big", 0.2), ("mid", 0.3), (None, 0.5)], "source string, weight double")
    out = mixing.replicate(table, mixing.rates(table, weights=wish)).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).toPandas()
    shares = dict(zip(out["source"].fillna("null"), out["n"] / out["n"].sum()))
    assert shares["big"] == pytest.approx(0.2, abs=0.01) and shares["null"] == pytest.approx(0.5, abs=0.02)
    big = out[out["source"] == "big"]["d"].iloc[0] / 40_000
    assert big == pytest.approx(1 - np.exp(-0.3), abs=0.01)  # Poisson: share of documents with at least one copy
    odd = mixing.replicate(docs.withColumn("replica", F.lit("x")), mixing.rates(docs)).toPandas()
    assert set(odd["doc_id"].dropna()) <= {i for i, *_ in odd_rows()} and odd["shuffle_key"].notna().all()
    assert mixing.replicate(none, mixing.rates(none)).count() == 0


def test_containment(spark, docs, none):
    text = {r[0]: r[1] for r in odd_rows()}
    item = " ".join(f"b{i}" for i in range(30))
    near = item.replace("b29", "other")
    far = " ".join(w if k % 4 else "other" for k, w in enumerate(item.split()))
    rows = [(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (4, "two words", "x"), (None, text[3][-120:], "x")]
    items = spark.createDataFrame(rows, "item_id long, text string, doc_id string")
    more = [(100, f"{LONG} {item.upper()}! {LONG}"), (101, f"start {near} end"), (102, f"start {far} end"), (103, "Two, words"), (104, "two words more of them here")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("item_id", F.lit(7))
    got = sorted((r["doc_id"] or -9, r["item_id"] or -1) for r in contain.containment(both, items).collect())
    assert got == [(3, -1), (100, 1), (101, 1), (103, 4)]
    left = contain.decontaminate(both, items).collect()
    assert len(left) == both.count() - 4 and set(left[0].asDict()) == {"doc_id", "text", "item_id"}
    assert contain.containment(none, items).count() == 0 and contain.decontaminate(docs, none.withColumnRenamed("doc_id", "item_id")).count() == docs.count()


def test_lines(spark, docs, none):
    foot = "Read our terms"
    rows = [(i, f"own line {i}\n{foot} \n\nnear {i % 4}", f"site{i % 5}") for i in range(40)] + [(90, None, "site1"), (91, "", None), (92, f"{foot}\n{foot}", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("x"))
    out = {r["doc_id"]: r for r in lines.drop_widespread_lines(table, least=5).collect()}
    assert out[0]["text"] == "own line 0\n" and out[0]["n_removed"] == 2 and out[0]["n_lines"] == 4
    assert out[90]["text"] is None and out[90]["n_lines"] == 0 and out[91]["text"] == "" and out[92]["text"] == ""
    assert {r["doc_id"]: r["n_removed"] for r in lines.drop_widespread_lines(table, least=6).collect()}[0] == 0
    assert lines.drop_widespread_lines(docs).count() == len(odd_rows()) and lines.drop_widespread_lines(none).count() == 0


def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "a\\|b\\\\<|", "<\\|", "", None, "line\nbreak\\n", "é😀" * 50, "<|im_start|>assistant\nhi<|im_end|>\n", "\\"]
    rows = [(c, t, ("system" if t == 0 and c % 2 else ["user", "assistant", "to\\ol\n\\n"][t % 3]), hard[(c + t) % len(hard)]) for c in range(6) for t in range(9)]
    rows += [(7, t, ["user", "assistant"][t % 2], f"turn {t} " + "words " * (t % 7 * 40)) for t in range(300)]
    rows += [(8, None, "user", "x"), (8, 1, None, "y"), (8, 1, "assistant", "z"), (8, 1, "assistant", "z"), (None, 0, "assistant", "lost"), (9, 0, "assistant", "long " * 4000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    found = chat.windows(turns, budget=512, history=128)
    digest = {r["conv_id"]: r for r in chat.digest(found).collect()}
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, (r[2] or "").encode()), (r[3] is not None, (r[3] or "").encode())))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert digest[c]["n_turns"] == len(own) and digest[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digest[c]["loss_chars"] == len(loss)
    windows = [r for r in found.collect() if r["conv_id"] == 7]
    assert len(windows) > 5 and any(r["n_repeated"] for r in windows) and order(rows[0])
    assert all(len(r["formatted"].encode()) / 4 < 512 * 1.2 for r in windows)
    assert chat.digest(chat.windows(turns.limit(0))).count() == 0
