"""Hard negatives inside a score window of each positive, found with a multiway hyperplane tree (after GNAT).

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, so that all lie on one sphere; a query
gets 0 there. The angle between them is a metric and the inner product is |q| sqrt(M) cos(angle), so a window of scores
is an annulus of angles. A tree node has a few split points; a row goes to the subtree of its nearest one. For every
split point and every sibling subtree the node keeps the least and greatest angle of all rows there. From the angle
between query and split point the triangle inequality gives the angles that a subtree can hold; a subtree is eliminated
when any split point's interval misses the annulus, and with it all its leaves. Leaves that remain are scanned exactly.

The split points come from a bounded sample (``sample`` vectors of the smallest id hashes); every row is indexed and the
ranges are measured over all rows. Per scan a query first visits its likeliest leaves; the scores found narrow the
annulus for the rest. Driver and tasks hold the tree alone: at most ``sample`` split points and ``fan``-squared ranges
each. Leaves are scanned in blocks of rows and groups of queries, so no task holds a whole leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import cut_lineage

_LIMIT = (1 << 63) - 1
_SLACK = 1e-6  # radians; covers the rounding of cosines and angles


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: components floor(scale * x), which saturate at the 64-bit range. Rows with a null key, label
    or vector, or a null or non-finite component go."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.filter(kept).select(
        F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v")
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Float64 rows; shorter vectors are filled with zeros, which leaves inner products as they are."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(q: pd.Series, v: pd.Series, width: int) -> np.ndarray:
    """Integer inner products: through floats where these are exact, else through Python integers that saturate."""
    a, b = _matrix(q, width), _matrix(v, width)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0**52:
        return (a @ b.T).astype(np.int64)
    left, right = [[int(c) for c in r] for r in q], [[int(c) for c in r] for r in v]
    return np.array(
        [[max(-_LIMIT, min(_LIMIT, sum(x * y for x, y in zip(r, s)))) for s in right] for r in left], np.int64
    ).reshape(len(q), len(v))


def _unit(a: np.ndarray) -> np.ndarray:
    length = np.sqrt((a * a).sum(axis=1, keepdims=True))
    return np.divide(a, length, out=np.zeros_like(a), where=length > 0)


class Tree:
    """Nodes of split points with their children (a leaf is ~leaf) and the measured ranges between them."""

    def __init__(self, most: float, width: int):
        self.most, self.width = most, width
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.near: list[np.ndarray] = []
        self.far: list[np.ndarray] = []
        self.sizes: np.ndarray = np.zeros(0, np.int64)
        self.leaves = 0

    def lifted(self, rows: pd.Series) -> np.ndarray:
        """Unit vectors of rows on the sphere of radius sqrt(most)."""
        a = _matrix(rows, self.width)
        return _unit(np.hstack([a, np.sqrt(np.maximum(self.most - (a * a).sum(axis=1, keepdims=True), 0))]))

    def asked(self, rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of queries, and the score of a row at angle 0."""
        a = _matrix(rows, self.width)
        return _unit(np.hstack([a, np.zeros((len(a), 1))])), np.sqrt((a * a).sum(axis=1)) * np.sqrt(self.most)

    def angles(self, node: int, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.points[node].T, -1, 1))

    def grow(self, units: np.ndarray, fan: int, leaf: int) -> int:
        """Split points spread by farthest-first choice; a part of the sample no larger than ``leaf`` is a leaf."""
        chosen, gap = [0], np.full(len(units), np.inf)
        while len(units) > leaf and len(chosen) < fan:
            gap = np.minimum(gap, np.arccos(np.clip(units @ units[chosen[-1]], -1, 1)))
            if gap.max() < 1e-5:
                break
            chosen.append(int(gap.argmax()))
        if len(chosen) == 1:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.points)
        self.points.append(units[chosen])
        self.children.append([])
        self.near.append(np.full((len(chosen), len(chosen)), np.inf))
        self.far.append(np.full((len(chosen), len(chosen)), -np.inf))
        part = self.angles(node, units).argmin(axis=1)
        self.children[node] = [self.grow(units[part == i], fan, leaf) for i in range(len(chosen))]
        return node

    def descend(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows there, their angles to its split points, the nearest one) for every node that rows meet."""
        waiting = [(0, np.arange(len(units)))] if self.points else []
        while waiting:
            node, rows = waiting.pop()
            angles = self.angles(node, units[rows])
            part = angles.argmin(axis=1)
            yield node, rows, angles, part
            for i, child in enumerate(self.children[node]):
                inside = rows[part == i]
                if child >= 0 and len(inside):
                    waiting.append((child, inside))

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units), np.int32)
        for node, rows, _, part in self.descend(units):
            child = np.array(self.children[node])[part]
            out[rows[child < 0]] = ~child[child < 0]
        return out

    def bounds(self, rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(queries, leaves) least and greatest score that a row of the leaf can have."""
        units, top = self.asked(rows)
        low, high = np.zeros((len(units), self.leaves)), np.full((len(units), self.leaves), np.pi)
        waiting = [(0, np.zeros(len(units)), np.full(len(units), np.pi))] if self.points else []
        while waiting:
            node, least, most = waiting.pop()
            d = self.angles(node, units)[:, :, None]
            near, far = self.near[node][None], self.far[node][None]
            lows = np.maximum(near - d, d - far).max(axis=1) - _SLACK
            highs = np.minimum(d + far, 2 * np.pi - d - near).min(axis=1) + _SLACK
            for i, child in enumerate(self.children[node]):
                a, b = np.maximum(least, lows[:, i]), np.minimum(most, highs[:, i])
                if child >= 0:
                    waiting.append((child, a, b))
                else:
                    low[:, ~child], high[:, ~child] = a, b
        spare = 1 + 1e-9 * top[:, None]
        least = top[:, None] * np.cos(np.clip(high, 0, np.pi)) - spare
        return least, top[:, None] * np.cos(np.clip(low, 0, np.pi)) + spare


def build(vectors: DataFrame, sample: int = 4096, fan: int = 8, leaf: int = 32) -> tuple[DataFrame, Tree] | None:
    """The index ``vec_id, label, v, leaf, at`` over every row of ``vectors`` and its tree; None for an empty table.

    ``at`` numbers the rows, so rows of one vec_id stay apart. ``leaf`` counts sampled vectors.
    """
    rows = cut_lineage(vectors.select("vec_id", "label", "v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("most")).first()
    if facts["width"] is None:
        return None
    tree = Tree(facts["most"] * (1 + 1e-12), facts["width"])
    tree.grow(tree.lifted(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]), fan, leaf)

    @F.pandas_udf(T.IntegerType())
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(tree.lifted(v)))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, far = [n.copy() for n in tree.near], [f.copy() for f in tree.far]
        held = np.zeros(tree.leaves, np.int64)
        for batch in batches:
            units = tree.lifted(batch["v"])
            held += np.bincount(batch["leaf"], minlength=tree.leaves)
            for node, _, angles, part in tree.descend(units):
                for i in range(angles.shape[1]):
                    inside = angles[part == i]
                    if len(inside):
                        near[node][:, i] = np.minimum(near[node][:, i], inside.min(axis=0))
                        far[node][:, i] = np.maximum(far[node][:, i], inside.max(axis=0))
        out = [(n, i, j, near[n][i, j], far[n][i, j], 0) for n in range(len(near)) for i in range(len(near[n])) for j in range(len(near[n])) if np.isfinite(near[n][i, j])]
        out += [(-1, k, 0, 0.0, 0.0, int(c)) for k, c in enumerate(held) if c]
        yield pd.DataFrame(out, columns=["node", "i", "j", "near", "far", "n"])

    table = cut_lineage(rows.withColumn("leaf", leaf_of("v")).withColumn("at", F.monotonically_increasing_id()))
    parts = table.select("v", "leaf").mapInPandas(ranges, "node int, i int, j int, near double, far double, n long")
    tree.sizes = np.zeros(tree.leaves, np.int64)
    for r in parts.groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n")).collect():
        if r["node"] < 0:  # one row per leaf, the others one per range of the tree
            tree.sizes[r["i"]] = r["n"]
        else:
            tree.near[r["node"]][r["i"], r["j"]], tree.far[r["node"]][r["i"], r["j"]] = r["near"], r["far"]
    return table, tree


_FOUND = "q long, w int, vec_id long, score long"


def _scan(visits: DataFrame, table: DataFrame, tree: Tree, k: int, same: bool, block: int = 4096, group: int = 1024) -> DataFrame:
    """``q, w, vec_id, score``: the ``k`` best rows per query, window and scanned block.

    ``visits``: ``q, query_id, label, v, lows, highs, leaf``; a window w holds the scores lows[w] .. highs[w]. Rows of the
    query's own vec_id take no part; ``same`` asks for rows of the query's label, else of any other. Large leaves are cut
    into blocks of rows, and the queries of a leaf into groups.
    """
    spark = table.sparkSession
    blocks = spark.createDataFrame([(i, int(-(-n // block))) for i, n in enumerate(tree.sizes) if n], "leaf int, blocks int")
    groups = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups"))
    dealt = F.broadcast(cut_lineage(blocks.join(groups, "leaf")))  # one row per leaf of the tree
    left = visits.join(dealt, "leaf").withColumn("g", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).drop("blocks", "groups")
    right = table.join(dealt, "leaf").withColumn("b", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    ).drop("blocks", "groups")
    width = tree.width

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            products = _products(queries["v"], rows["v"], width)
            asked = zip(queries["q"], queries["query_id"], queries["label"], queries["lows"], queries["highs"], products)
            for q, own, label, lows, highs, scores in asked:
                able = np.flatnonzero(((labels == label) == same) & (ids != own) & (scores >= lows.min(initial=_LIMIT)) & (scores <= highs.max(initial=-_LIMIT)))
                able = able[np.argsort(-scores[able], kind="stable")]
                falling = -scores[able]
                for w, (low, high) in enumerate(zip(lows, highs)):
                    first = np.searchsorted(falling, -high, "left")
                    for at in able[first : min(first + k, np.searchsorted(falling, -low, "right"))]:
                        out.append((q, w, ids[at], scores[at]))
        return pd.DataFrame(out, columns=["q", "w", "vec_id", "score"])

    keys = ["leaf", "b", "g"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(asked: DataFrame, table: DataFrame, tree: Tree, k: int, same: bool, counted: dict[str, int] | None = None) -> DataFrame:
    """``q, w, rank, vec_id, score``: per query and window its ``k`` best rows, exactly.

    ``asked``: ``q, query_id, label, v, lows, highs`` with distinct q. ``counted`` receives how many (query, leaf) visits
    were made and how many there are.
    """
    need = 8 * k
    sizes = tree.sizes

    def meets(least: np.ndarray, most: np.ndarray, lows: pd.Series, highs: pd.Series) -> np.ndarray:
        """(queries, leaves): the leaf has rows and its possible scores meet a window."""
        out = np.zeros(least.shape, bool)
        for i, (a, b) in enumerate(zip(lows, highs)):
            for low, high in zip(a, b):
                out[i] |= (most[i] >= low) & (least[i] <= high) & (low <= high)
        return out & (sizes > 0)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def likeliest(v: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        least, most = tree.bounds(v)
        out = []
        for m, a, b, h in zip(meets(least, most, lows, highs), least, most, highs):
            # leaves whose middle lies nearest below the upper edge hold the best scores of a window soonest
            gap = np.abs((a + b) / 2 - min(h.max(initial=-_LIMIT), b.max()))
            order = np.flatnonzero(m)[np.argsort(gap[m], kind="stable")]
            out.append(order[: int(np.searchsorted(np.cumsum(sizes[order]), need)) + 1].tolist())
        return pd.Series(out)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def remaining(v: pd.Series, lows: pd.Series, highs: pd.Series, seen: pd.Series) -> pd.Series:
        least, most = tree.bounds(v)
        return pd.Series([np.setdiff1d(np.flatnonzero(m), s).tolist() for m, s in zip(meets(least, most, lows, highs), seen)])

    columns = ["q", "query_id", "label", "v", "lows", "highs"]
    first = cut_lineage(asked.select(*columns).withColumn("leaves", likeliest("v", "lows", "highs")))
    near = cut_lineage(_ranked(_scan(first.select(*columns, F.explode("leaves").alias("leaf")), table, tree, k, same), k))
    full = near.filter(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    narrowed = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.element_at("kth", w), low)))
    second = first.join(full, "q", "left").withColumn("lows", narrowed).withColumn("leaves", remaining("v", "lows", "highs", "leaves"))
    second = cut_lineage(second.select(*columns, F.explode("leaves").alias("leaf")))
    if counted is not None:
        counted["visited"] = first.agg(F.coalesce(F.sum(F.size("leaves")), F.lit(0))).first()[0] + second.count()
        counted["all"] = first.count() * int((sizes > 0).sum())
    far = _scan(second, table, tree, k, same)
    return _ranked(near.drop("rank").unionByName(far), k).select("q", "w", "rank", "vec_id", "score")


def mine(
    vectors: DataFrame, anchors_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    counted: dict[str, dict[str, int]] | None = None, **settings,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``vectors(vec_id, label, v)``.

    Anchors are the rows whose vec_id is divisible by ``anchors_every``; positives the best other rows of their label;
    negatives rows of another label with low * positive <= 100 * negative <= high * positive. Scores are integer inner
    products (saturating at 64 bits), ties go to the smaller vec_id. A row of the anchor's own vec_id takes no part.
    Of repeated vec_ids every row counts, as anchor, positive or negative. An anchor without positives, or without a
    negative in the window, gives no rows, and so does an empty table. Other columns are left out.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = build(vectors, **settings)
    if built is None:
        return vectors.sparkSession.createDataFrame([], schema)
    table, tree = built
    counted = {} if counted is None else counted
    whole = [F.array(F.lit(x).cast("bigint")).alias(n) for x, n in ((-_LIMIT, "lows"), (_LIMIT, "highs"))]
    asked = table.filter(F.col("vec_id") % anchors_every == 0).select(F.col("at").alias("q"), F.col("vec_id").alias("query_id"), "label", "v", *whole)
    found = cut_lineage(search(asked, table, tree, positives, True, counted.setdefault("positives", {})))
    by_rank = F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score")))  # at most ``positives``
    score = lambda p, share, up: _share(p["score"], share, up)
    windows = asked.drop("lows", "highs").join(found.groupBy("q").agg(by_rank.alias("p")), "q")
    windows = cut_lineage(
        windows.withColumn("lows", F.transform("p", lambda p: score(p, low, True))).withColumn("highs", F.transform("p", lambda p: score(p, high, False)))
    )
    hard = search(windows, table, tree, negatives, False, counted.setdefault("negatives", {}))
    positive = F.element_at("p", F.col("w") + 1)
    return hard.join(windows.select("q", "query_id", "p"), "q").select(
        F.col("query_id").alias("anchor_id"), positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _share(score, percent: int, up: bool):
    """percent * score / 100, rounded up or down, in whole numbers."""
    product = score.cast("decimal(25,0)") * F.lit(percent)
    return (F.ceil(product / 100) if up else F.floor(product / 100)).cast("bigint")


def negatives_sql(anchors_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    return f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score
      FROM v a JOIN v o ON a.vec_id % {anchors_every} = 0 AND o.vec_id <> a.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives}),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
      AND {low} * p.positive_score <= 100 * s.score AND 100 * s.score <= {high} * p.positive_score)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank,
      negative_id, positive_score, negative_score FROM n
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= {negatives}"""
