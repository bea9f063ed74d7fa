"""Importance resampling, hard negatives and sketch near-dedup against brute force, with odd rows, ties and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import LONG, SCHEMA, odd_rows

from riskloom.llm import chat, contain, importance, langid, lines, minhash, mixing, negatives, repeats, secrets, shards, simhash
from riskloom.llm.queries import QUERIES
from riskloom.llm.text import unused


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_unused_names():
    assert unused(["at", "_AT", "x"], "at", "y", "y") == ["__at", "y", "_y"]


# importance resampling


def brute_features(text, ngrams):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return w, [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


def brute_draw(rows, target, ngrams, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, brute_features(text, ngrams)[1]))
    for text in target:
        t.update(map(bucket, brute_features(text, ngrams)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, f = brute_features(text, ngrams)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("ngrams,buckets", [(1, 10_000), (3, 97)])
def test_importance_against_brute_force(spark, docs, ngrams, buckets):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(300 + i, f"Ünï-CODE {'alpha beta ' * (i % 4)} 3d_{i} " + "gamma " * 20) for i in range(60)]
    rows += [(400, "same text " * 10)] * 5
    target = ["alpha beta", None, "", "Gamma Ünï 3D"]
    frame = spark.createDataFrame([(i, t, "mine", "x") for i, t in rows], "doc_id long, text string, at string, rank string")
    wish = spark.createDataFrame([(t,) for t in target], "text string")
    want, drawn = brute_draw(rows, target, ngrams, buckets, 30, 20)
    scored = importance.weigh(frame, wish, ngrams=ngrams, buckets=buckets)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in scored.select("doc_id", "n_words", "n_features", "weight", "score").collect())
    ranked = importance.rank(scored.drop("text"), percent=30)
    assert ranked.columns.count("at") == 1 and ranked.filter("at = 'mine'").count() == len(rows)
    got = sorted((r["rank"], r["doc_id"]) for r in ranked.filter("rank is not null").collect())
    assert got == [(n + 1, r[0]) for n, r in enumerate(drawn)]
    whole = importance.draw(frame, wish, percent=30, ngrams=ngrams, buckets=buckets).collect()
    assert Counter(r["doc_id"] for r in whole) == Counter(r[0] for r in drawn) and "text" in whole[0].asDict()


def test_importance_odd_tables(spark, docs, none):
    nothing = spark.createDataFrame([], "text string")
    assert importance.rank(importance.weigh(none, docs)).count() == 0 and importance.draw(none, nothing).count() == 0
    plain = importance.rank(importance.weigh(docs, nothing).drop("text"), percent=100, least_words=1)
    assert plain.count() == len(odd_rows())
    held = [r["rank"] for r in plain.collect() if r["n_words"]]
    assert sorted(held) == list(range(1, len(held) + 1))
    none_id = spark.createDataFrame([(None, "a b c " * 9)] * 50 + [(1, "a b c " * 9)] * 50, "doc_id long, text string")
    ties = importance.rank(importance.weigh(none_id, nothing), percent=60).collect()
    assert sorted(r["rank"] for r in ties if r["rank"]) == list(range(1, 61))
    assert importance.draw(none_id, nothing, percent=60).count() == 60


# hard negatives


def brute_negatives(rows, every, positives, negatives_, low, high):
    out = []
    for a, (i, la, va) in enumerate(rows):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, vo)), o, lo) for b, (o, lo, vo) in enumerate(rows) if o != i]
        best = sorted((s, o) for s, o, lo in scored if lo == la)[:positives]
        for s, o in best:
            able = sorted((n, x) for n, x, lo in scored if lo != la and low * -s <= 100 * -n <= high * -s)[:negatives_]
            out += [(i, o, k + 1, x, -s, -n) for k, (n, x) in enumerate(able)]
    return sorted(out)


def quantised_rows(rows):
    good = [(i, lab, v) for i, v, lab in rows if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all()]
    return [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in good]


def test_hard_negatives_exact_and_pruned(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 8))
    rows = [(i, [float(x) for x in centre[i % 40] + 0.05 * rng.standard_normal(8)], int(i % 3)) for i in range(2000)]
    rows += [(3000 + i, rows[7][1], i % 2) for i in range(30)]  # ties
    rows += [(None, rows[0][1], 1), (5000, None, 1), (5100, [1.0, None], 1), (5200, [float("nan")] * 8, 1), (5300, [float("inf")] * 8, 0), (5400, rows[3][1], None)]
    rows += [(6000, [0.5], 1), (6100, [0.0] * 8, 2), (6200, [], 2), (100, rows[5][1], 2)]  # short, zero, empty, repeated id
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("at", F.lit("x")).withColumn("leaf", F.lit(1))
    counted = {}
    found = negatives.mine(negatives.quantised(frame), counted=counted, sample=1024)
    assert sorted(map(tuple, found.collect())) == brute_negatives(quantised_rows(rows), 100, 5, 10, 30, 90)
    for step in ("positives", "negatives"):  # clustered vectors: most leaves are eliminated
        assert counted[step]["visited"] < 0.3 * counted[step]["all"]


def test_hard_negatives_random_directions_and_odd_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(5)], int(rng.integers(0, 4))) for i in range(300)]
    frame = negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = negatives.mine(frame, anchors_every=10, positives=3, negatives=4, low=10, high=80, sample=64, fan=3, leaf=4)
    assert sorted(map(tuple, got.collect())) == brute_negatives(quantised_rows(rows), 10, 3, 4, 10, 80)
    assert negatives.mine(frame.limit(0)).count() == 0 and negatives.mine(frame.filter("vec_id = 100")).count() == 0
    huge = [(0, [1.0e7, 1.0], 0), (1, [0.9e7, 5.0], 0), (2, [0.5e7, 4.0], 1), (3, [1.0e300, 1.0], 1)]
    got = negatives.mine(negatives.quantised(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int"))).collect()
    v = dict((i, x) for i, _, x in quantised_rows(huge[:3]))
    assert [(r["positive_score"], r["negative_id"], r["negative_score"]) for r in got] == [(v[0][0] * v[1][0] + v[0][1] * v[1][1], 2, v[0][0] * v[2][0] + v[0][1] * v[2][1])]


def test_leaf_bounds_hold_for_every_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(4) * rng.exponential()], 0) for i in range(500)]
    table, tree = negatives.build(negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), sample=200, fan=4, leaf=5)
    held = table.toPandas()
    assert tree.leaves > 8 and tree.sizes.sum() == 500
    least, most = tree.bounds(held["v"].iloc[:50])
    scores = negatives._products(held["v"].iloc[:50], held["v"], 4)
    leaf = held["leaf"].to_numpy()
    assert (scores >= least[:, leaf]).all() and (scores <= most[:, leaf]).all() and (most - least).mean() < 0.8 * (most - least).max()


# sketch near-dedup


def brute_components(rows, size, percent):
    def cut(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", w)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [cut(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    ids = [doc if not sets[i] else least.get(find(i)) for i, (doc, _) in enumerate(rows)]
    return sorted(((doc, len(sets[i]), ids[i], doc == ids[i]) for i, (doc, _) in enumerate(rows)), key=str)


def near_rows():
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(30, "ONE"), (31, "one"), (32, " one\t"), (33, "one two"), (34, "é É"), (35, "é é")]
    for i in range(60):  # copies of one text with a few words changed: all meet, only some are linked
        w = list(base)
        for at in rng.choice(60, int(rng.integers(1, 6)), False):
            w[at] = f"n{i}x{at}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, " ".join(base)), (201, " ".join(reversed(base))), (None, " ".join(base[:58])), (None, "only null ids here"), (None, "only null ids here")]
    return rows


@pytest.mark.parametrize("size,percent,most", [(2, 80, 512), (2, 80, 7), (5, 80, 512), (1, 60, 20)])
def test_near_duplicates_against_brute_force(spark, size, percent, most):
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, class string, h int")
    settings = {"bands": 60, "rows": 2} if percent < 80 else {}
    found = minhash.near_duplicates(frame, shingle=size, percent=percent, most_members=most, **settings).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == brute_components(rows, size, percent)


def test_keep_one_and_odd_tables(spark, none):
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, class string, h int")
    one = minhash.keep_one(frame, shingle=2).collect()
    want = {(d, c) for d, _, c, kept in brute_components(rows, 2, 80) if kept}
    assert one[0].asDict().keys() == {"doc_id", "text", "class", "h"} and {r["doc_id"] for r in one if r["doc_id"] is not None} == {d for d, _ in want if d is not None}
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(6)
    off = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(40):
            n = int(rng.integers(3, 900))
            pool = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
            k = int(round(2 * n * share / (1 + share)))
            a, b = pool[:n], np.concatenate([pool[:k], pool[n : 2 * n - k]])
            s = minhash.sketches([a, b], 128)
            assert not (s == minhash._EMPTY).any()
            off.append((s[0] == s[1]).mean() - k / (2 * n - k))
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.05
    one = minhash.sketches([np.array([5], np.uint64), np.zeros(0, np.uint64)], 16)
    assert not (one[0] == minhash._EMPTY).any() and (one[1] == minhash._EMPTY).all()


def test_registered_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = QUERIES["op13_sketch_near_dedup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 2, 80)
    assert len(LONG.split()) == 30_000


@pytest.mark.parametrize("operator,private", [
    (lambda d: shards.shard(d, shards=3), ("_key", "_tie", "_cell", "_start", "_at")),
    (lambda d: langid.predict(d, None), ("_lettered", "_label")),
    (lambda d: repeats.drop_repeats(d), ("tk", "TC", "spots", "copied", "_cut")),
    (lambda d: secrets.scan(d, None), ("_found",)),
    (simhash.keep_one, ("_id", "_hash", "_nth")),
    (lambda d: mixing.replicate(d, mixing.rates(d)), ("_source", "_parts", "_cdf", "_n")),
    (lambda d: contain.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0)), ("_row",)),
    (lambda d: lines.drop_widespread_lines(d, least=3), ("_row", "_bad", "_lines", "line_hash")),
    (lambda d: minhash.keep_one(d, shingle=2), ("h", "id", "class", "kept")),
    (lambda d: importance.rank(importance.weigh(d, d).drop("text")), ("at", "found", "part", "start")),
])
def test_extra_columns_keep_their_names_and_values(spark, operator, private):
    few = [r for r in odd_rows() if r[1] is None or len(r[1]) < 5000]
    docs = spark.createDataFrame(few, SCHEMA).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in private})
    out = operator(docs).collect()
    assert out
    for r in out:
        for n in private:
            assert r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}"


def test_a_text_id_is_not_a_null_id(spark):
    rows = [("null", 0, "user", "a"), ("null", 1, "assistant", "b"), (None, 0, "user", "c"), (None, 1, "assistant", "d")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest(chat.windows(turns)).collect()}
    assert got == {"null": 2, None: 2}
