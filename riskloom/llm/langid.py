"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions, white space included, labels every byte position with a
language distribution, and a document's probabilities are the mean over all its positions. A text is read in windows
of ``WINDOW`` bytes; in each direction the states start ``CONTEXT`` bytes ahead of the window, so they run through its
edges, and every position lies in exactly one window. Trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import guarded

#: Bytes of a window, and bytes read ahead of it in each direction.
WINDOW = 256
CONTEXT = 32
#: Windows of one pass through the network, and bytes of text taken up together.
ROWS = 2048
BLOCK = 8_000_000
#: The symbol beyond the ends of a text; its gates are zero, so states stay zero until the text begins.
PAD = 256
UNDETERMINED = "und"
NAMES = ("emb", "wf", "uf", "bf", "wb", "ub", "bb", "v", "c")


def in_training(doc_id: Column) -> Column:
    """True where crc32 of the doc_id's text leaves no remainder 1 by 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, np.ndarray]


def start_weights(langs: int, hidden: int, width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def matrix(rows: int, cols: int) -> np.ndarray:
        return (rng.standard_normal((rows, cols)) / np.sqrt(rows)).astype(np.float32)

    return {
        "emb": matrix(256, width) * 4,
        "wf": matrix(width, 3 * hidden), "uf": matrix(hidden, 3 * hidden), "bf": np.zeros(3 * hidden, np.float32),
        "wb": matrix(width, 3 * hidden), "ub": matrix(hidden, 3 * hidden), "bb": np.zeros(3 * hidden, np.float32),
        "v": matrix(2 * hidden, langs), "c": np.zeros(langs, np.float32),
    }


def _table(w: dict[str, np.ndarray], d: str) -> np.ndarray:
    """Input part of the gates per byte, and zeros for PAD."""
    return np.concatenate([w["emb"] @ w["w" + d] + w["b" + d], np.zeros((1, w["b" + d].size), w["emb"].dtype)])


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, N) along the first axis of ``x`` (T steps of N rows)."""
    hidden = u.shape[0]
    gates, ut = np.ascontiguousarray(table.T), np.ascontiguousarray(u.T)
    h = np.zeros((hidden, x.shape[1]), table.dtype)
    out = np.empty((x.shape[0], *h.shape), table.dtype)
    for t in range(x.shape[0]):
        a, b = np.take(gates, x[t], axis=1, mode="clip"), ut @ h
        zr, n, inner = a[: 2 * hidden], a[2 * hidden :], b[2 * hidden :]
        zr += b[: 2 * hidden]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:hidden], zr[hidden:]
        n += r * inner
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, n, inner))
        h = n + z * (h - n)
        out[t] = h
    return out


def _distribution(w: dict[str, np.ndarray], f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(T, languages, N) from the states (T, H, N) of both directions."""
    hidden = f.shape[1]
    s = w["v"][:hidden].T @ f
    s += w["v"][hidden:].T @ b
    s += w["c"][:, None]
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


def position_probabilities(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(T, languages, N): the distribution at every position of N sequences, the columns of ``x`` (T, N), PAD outside."""
    f = _run(_table(w, "f"), w["uf"], x)
    b = _run(_table(w, "b"), w["ub"], x[::-1])[::-1]
    return _distribution(w, f, b)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of ``x`` (T, N) but PAD, and its gradient, by backpropagation through time."""
    hidden = w["uf"].shape[0]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    kept: dict[str, list] = {"f": [], "b": []}
    seen = {"f": x, "b": x[::-1]}
    states = {d: _run(_table(w, d), w["u" + d], seen[d], kept[d]) for d in "fb"}
    both = np.concatenate([states["f"], states["b"][::-1]], axis=1)
    p = _distribution(w, states["f"], states["b"][::-1])
    at, live = np.arange(x.shape[1]), (x != PAD).astype(p.dtype)
    loss = float(-(np.log(p[:, y, at] + 1e-9) * live).sum() / live.sum())
    p[:, y, at] -= 1
    p *= live[:, None, :] / live.sum()
    g["v"] = np.einsum("thn,tkn->hk", both, p)
    g["c"] = p.sum(axis=(0, 2))
    back = w["v"] @ p
    for k, d in enumerate("fb"):
        u, gates = w["u" + d], []
        part = back[:, k * hidden : (k + 1) * hidden]
        part = part if d == "f" else part[::-1]
        dh = np.zeros(part.shape[1:], part.dtype)
        for t, before, z, r, cand, inner in reversed(kept[d]):
            dh = dh + part[t]
            dn = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            through = np.concatenate([dz, dr, dn * r])
            gates.append(np.concatenate([dz, dr, dn]))
            g["u" + d] += before @ through.T
            dh = dh * z + u @ through
        read = seen[d][::-1].reshape(-1)
        outer = np.stack(gates).transpose(0, 2, 1).reshape(len(read), -1)
        one_hot = np.zeros((PAD, len(read)), outer.dtype)
        real = np.flatnonzero(read != PAD)
        one_hot[read[real], real] = 1
        table_g = one_hot @ outer
        g["w" + d] = w["emb"].T @ table_g
        g["b" + d] = table_g.sum(axis=0)
        g["emb"] += table_g @ w["w" + d].T
    return loss, g


def columns(runs: list[bytes]) -> np.ndarray:
    """Byte sequences as the columns of one array, PAD behind the shorter ones."""
    x = np.full((max(map(len, runs)), len(runs)), PAD, np.intp)
    for i, run in enumerate(runs):
        x[: len(run), i] = np.frombuffer(run, np.uint8)
    return x


def fit(samples: list[tuple[str, bytes]], hidden: int = 8, width: int = 8, steps: int = 400, batch: int = 192,
        rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on batches of byte sequences, drawn with equal weight for every language."""
    samples = sorted(samples)
    langs = sorted({lang for lang, _ in samples})
    w = start_weights(len(langs), hidden, width, seed)
    rng = np.random.default_rng(seed)
    x = columns([run for _, run in samples])
    y = np.array([langs.index(lang) for lang, _ in samples])
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = np.concatenate([part[rng.integers(0, len(part), max(1, batch // len(langs)))] for part in of])
        _, g = gradients(w, x[:, rows], y[rows])
        pace = rate * min(1.0, step / 50) * (1 - 0.95 * step / steps)
        for k in w:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return Model(langs, {k: v.astype(np.float32) for k, v in w.items()})


def train(docs: DataFrame, max_docs: int = 2000, runs_per_doc: int = 6, run: int = 48, **settings) -> Model | None:
    """Fit on at most about ``max_docs`` labelled documents (bound per language: max_docs / languages, chosen by
    hash of the id) and ``runs_per_doc`` runs of ``run`` bytes of each, from random places; only text and lang of rows
    outside the held-out third are used. A text without bytes teaches nothing. None where no labelled row with text exists."""
    rows = docs.filter(F.col("lang").isNotNull() & in_training(F.col("doc_id")) & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max_docs / len(counts)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(F.coalesce(*[F.when((F.col("lang") == k) & (chance < share / n), True) for k, n in counts.items()], F.lit(False)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"]):
                data = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(len(data))
                places = sorted(set(rng.integers(0, max(len(data) - run, 0) + 1, runs_per_doc).tolist()))
                out += [(lang, data[i : i + run]) for i in places if data]
            yield pd.DataFrame(out, columns=["lang", "run"])

    drawn = picked.select("lang", "text").mapInPandas(draw, "lang string, run binary").collect()
    samples = [(r["lang"], bytes(r["run"])) for r in drawn]
    return fit(samples, **settings) if samples else None


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and length of every window of texts with these sizes."""
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    return owner, start, np.minimum(sizes[owner] - start, WINDOW)


def window_probabilities(model: Model, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of windows: text numbers, first bytes, lengths, and (T, languages, N) distributions, T at least each length."""
    w = model.weights
    tables = {d: _table(w, d) for d in "fb"}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = b"\0" * (WINDOW + CONTEXT)
    joined = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    first = np.cumsum(sizes + len(gap)) - sizes
    live = np.zeros(len(joined) + 1, np.int8)
    np.add.at(live, first, 1)
    np.add.at(live, first + sizes, -1)
    symbols = np.where(np.cumsum(live[:-1], dtype=np.int8) > 0, joined, np.int16(PAD))
    owner, start, length = _windows(sizes)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), ROWS):
        rows = order[i : i + ROWS]
        steps = int(length[rows[0]])
        at = (first[owner[rows]] + start[rows])[None, :] + np.arange(-CONTEXT, steps + CONTEXT)[:, None]
        x = symbols[at].astype(np.intp)
        f = _run(tables["f"], w["uf"], x[: CONTEXT + steps])[CONTEXT:]
        b = _run(tables["b"], w["ub"], x[CONTEXT:][::-1])[CONTEXT:][::-1]
        yield owner[rows], start[rows], length[rows], _distribution(w, f, b)


def pool(model: Model, texts: list[str]) -> np.ndarray:
    """Mean distribution over all byte positions per text (0 for a text without bytes), in blocks of about BLOCK bytes."""
    out, block, size = np.zeros((len(texts), len(model.langs))), [], 0
    for i, text in enumerate(texts):
        block.append(text.encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size > BLOCK or i == len(texts) - 1:
            sums = out[i + 1 - len(block) : i + 1]
            for owner, _, length, p in window_probabilities(model, block):
                p *= (np.arange(len(p))[:, None] < length)[:, None, :]
                for k, values in enumerate(p.sum(axis=0)):
                    sums[:, k] += np.bincount(owner, values, len(block))
            sums /= np.maximum([len(t) for t in block], 1)[:, None]
            block, size = [], 0
    return out


@guarded("_lettered", "_label")
def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows with ``lang_pred`` and ``score`` (the pooled probability, 0 to 1); every byte of a text counts,
    however long; equal texts get equal results, and an empty table gives an empty one.

    A null text, a text without a letter, and every text when there is no model give ``und`` with score 0.
    Input columns of these two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if model is None:
                yield pd.DataFrame({"lang": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)})
                continue
            p = pool(model, [t if t is not None else "" for t in texts])
            best = p.argmax(axis=1)
            yield pd.DataFrame({
                "lang": [model.langs[k] for k in best],
                "score": np.round(np.clip(p[np.arange(len(p)), best], 0, 1), 4),
            })

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    labelled = docs.select(*names, lettered.alias("_lettered"), label(F.col("text")).alias("_label"))
    return labelled.select(
        *names,
        F.when(F.col("_lettered"), F.col("_label.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("_lettered"), F.col("_label.score")).otherwise(0.0).alias("score"),
    )


def label_positions(text: str, model: Model) -> list[str]:
    """The likeliest language at each byte position of a text."""
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(data), np.intp)
    for _, start, length, p in window_probabilities(model, [data]):
        best = p.argmax(axis=1)
        for i, (at, n) in enumerate(zip(start, length)):
            out[at : at + n] = best[:n, i]
    return [model.langs[k] for k in out]
