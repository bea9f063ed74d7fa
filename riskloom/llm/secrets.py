"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are tagged O (outside), B (secret begins) or I (inside). Scores come from the token's shape, the two neighbouring
tokens, the file as a whole and the transition; they are fitted by maximum likelihood (forward-backward) on windows of
a bounded sample, labelled by the patterns, with secrets recast over other alphabets and neighbours hidden at times, so that shape alone
must tell. Viterbi
decodes whole texts. Tokens whose O score beats the others by more than any transition can bring back are O in every
best path; Viterbi runs over the stretches between them, which gives the same tags.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import guarded

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"""[^\x20\x09-\x0D"'=:,;()\[\]{}<>|]+""")
KEYWORD = re.compile(r"passw|secret|token|api_?key|credential|bearer|auth|private", re.IGNORECASE)
DIGIT = re.compile(r"\d")
O, B, I = 0, 1, 2  # noqa: E741
N_SHAPE, N_NEAR, N_FILE = 22, 7, 4


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


class Cover:
    """Spans by start, with the furthest end so far, so that one look-up tells whether any of them reaches a place."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def reaches(self, place: int, before: int) -> bool:
        """Whether a span that starts ahead of ``before`` ends behind ``place``."""
        at = bisect_left(self.starts, before)
        return at > 0 and self.ends[at - 1] > place


def shape(token: str) -> list[float]:
    """Shape features of a token."""
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    upper, lower = sum("A" <= c <= "Z" for c in token), sum("a" <= c <= "z" for c in token)
    other = n - digits - upper - lower
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values()) if n else 0.0
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(token, token[1:]))
    long = n >= 16
    return [
        1.0, n < 4, 4 <= n < 8, 8 <= n < 16, 16 <= n < 24, 24 <= n < 40, n >= 40,
        digits > 0, digits == n, 0 < digits < n and digits * 5 >= n, upper > 0 and lower > 0 and digits > 0,
        upper + digits == n and upper > 0 and digits > 0, lower + digits == n and lower > 0 and digits > 0,
        long and upper + digits == n and digits > 0, long and lower + digits == n and digits > 0, long and upper > 0 and lower > 0 and digits > 0,
        upper + lower == n, other > 0, long and entropy > 3.2, long and entropy > 3.9, long and turns * 4 >= n, token.startswith("AKIA"),
    ]


def near(token: str) -> list[float]:
    """Features of a neighbouring token; an empty one stands for the edge of the text."""
    word = token.isalpha()
    return [
        float(token == ""), float(bool(KEYWORD.search(token))), float(word and len(token) < 4), float(word and len(token) >= 4),
        float(token.isdigit()), float(not word and any(c.isdigit() for c in token)), float(not word),
    ]


def file_features(tokens: int, mixed: float, text: str) -> list[float]:
    """Features of the whole file: share of tokens with digits, assignment signs, code brackets, length."""
    n = max(tokens, 1)
    return [min(mixed / n * 4, 1.0), float(text.count("=") * 10 > n), float(text.count("{") * 20 > n), min(math.log10(n + 1) / 5, 1.0)]


@dataclass
class Field:
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    file: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def slack(self) -> np.ndarray:
        """Per tag, the most that neighbours' transitions can gain by it over O."""
        into = np.concatenate([self.move, self.start[None, :]])
        out = np.concatenate([self.move, np.zeros((3, 1))], axis=1)
        return np.array([(into[:, x] - into[:, O]).max() + (out[x] - out[O]).max() for x in range(3)])


def _scores(f: Field, x: tuple) -> np.ndarray:
    return x[0] @ f.own + x[1] @ f.left + x[2] @ f.right + (x[3] @ f.file)[:, None, :]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def likelihood(f: Field, x: tuple, y: np.ndarray) -> tuple[float, Field]:
    """Negative log-likelihood per window and its gradient, by forward-backward; windows of one length."""
    e = _scores(f, x)
    n, length, _ = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0] + f.start
    for t in range(1, length):
        a[:, t] = e[:, t] + _logsum(a[:, t - 1][:, :, None] + f.move, 1)
    for t in range(length - 2, -1, -1):
        b[:, t] = _logsum(f.move[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _logsum(a[:, -1], 1)
    tag = np.exp(a + b - z[:, None, None])
    pair = np.exp(a[:, :-1, :, None] + f.move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
    gold = np.eye(3)[y]
    score = (e * gold).sum() + f.start[y[:, 0]].sum() + f.move[y[:, :-1], y[:, 1:]].sum()
    d = (tag - gold) / n
    seen = np.zeros((3, 3))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    g = Field(
        np.einsum("ntf,nts->fs", x[0], d), np.einsum("ntf,nts->fs", x[1], d), np.einsum("ntf,nts->fs", x[2], d),
        x[3].T @ d.sum(axis=1), (pair - seen) / n, d[:, 0].sum(axis=0),
    )
    return float((z.sum() - score) / n), g


def fit(windows: list[tuple[list[str], list[int], list[float]]], length: int = 24, steps: int = 300, rate: float = 0.15, ridge: float = 0.0005, seed: int = 3) -> Field:
    """Adam over windows of ``length`` tokens (with one token of context at either end); half of each batch holds secrets."""
    rng = np.random.default_rng(seed)
    own = np.array([[shape(t) for t in w[1:-1]] for w, _, _ in windows], float)
    sides = np.array([[near(t) for t in w] for w, _, _ in windows], float)
    tags, files = np.array([y for _, y, _ in windows]), np.array([f for _, _, f in windows], float)
    f = Field(*(np.zeros(s) for s in ((N_SHAPE, 3), (N_NEAR, 3), (N_NEAR, 3), (N_FILE, 3), (3, 3), 3)))
    holding = np.flatnonzero((tags == B).any(axis=1))
    if not len(holding):
        holding = np.arange(len(windows))
    names = list(vars(f))
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(holding, 64), rng.integers(0, len(windows), 64)])
        shown = rng.random((len(at), length, 1)) < 0.6
        x = (own[at], sides[at, :-2] * shown, sides[at, 2:] * shown, files[at])
        _, g = likelihood(f, x, tags[at])
        for k in names:
            d = getattr(g, k) + ridge * getattr(f, k)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(f, k, getattr(f, k) - rate * (1 - step / (steps + 1)) * move)
    return f


def _tagged(text: str) -> tuple[list[str], list[int]]:
    tokens, tags, cover = [], [], Cover([(s, e) for _, _, e, s in base_matches(text)])
    for m in TOKEN.finditer(text):
        tokens.append(m.group())
        tags.append(O if not cover.reaches(m.start(), m.end()) else I if cover.reaches(m.start(), m.start()) else B)
    return tokens, tags


ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-",
)


def recast(token: str, rng: np.random.Generator) -> str:
    """A secret of about the same length over another alphabet, so that the field learns shapes beyond the patterns'."""
    letters = ALPHABETS[rng.integers(0, len(ALPHABETS))]
    n = max(20, len(token) + int(rng.integers(-12, 5)))
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def train(docs: DataFrame, max_docs: int = 4000, windows_per_doc: int = 3, length: int = 24, **settings) -> Field | None:
    """Fit on at most about ``max_docs`` documents chosen by hash of their id, ``windows_per_doc`` windows around
    pattern matches and as many elsewhere; None without any text."""
    rows = docs.filter(F.col("text").isNotNull())
    n = rows.count()
    if n == 0:
        return None
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("crf")), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                tokens, tags = _tagged(text)
                if not tokens:
                    continue
                mixed = sum(any(c.isdigit() for c in t) for t in tokens)
                file = file_features(len(tokens), mixed, text)
                rng = np.random.default_rng(len(text))
                hits = [i for i, y in enumerate(tags) if y == B]
                spots = [hits[i] for i in rng.permutation(len(hits))[:windows_per_doc]] + rng.integers(0, len(tokens), windows_per_doc).tolist()
                for i in spots:
                    a = max(0, min(i - int(rng.integers(2, length - 2)), len(tokens) - length))
                    w = ["", *tokens, *[""] * (length + 1)][a : a + length + 2]
                    y = [*tags, *[O] * length][a : a + length]
                    if a:
                        w[0] = tokens[a - 1]
                    if rng.random() < 0.6:
                        w = [recast(t, rng) if 0 < k <= length and y[k - 1] == B else t for k, t in enumerate(w)]
                    out.append((w, y, file))
            yield pd.DataFrame(out, columns=["w", "y", "f"])

    sample = rows.filter(chance < max_docs / n).select("text").mapInPandas(cut, "w array<string>, y array<int>, f array<double>").collect()
    windows = sorted((r["w"], r["y"], r["f"]) for r in sample)
    return fit(windows, length, **settings) if windows else None


class _Tagger:
    """Viterbi over whole texts; scores of recurring tokens are kept, up to a bound."""

    def __init__(self, field: Field, caution: float, most: int = 400_000):
        self.field, self.caution, self.most = field, caution, most
        self.slack, self.plain = field.slack(), {}
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.kept = np.zeros((0, 9), np.float32)
        self.digit = np.zeros(0, bool)
        self._learn([""])

    def _learn(self, tokens: list[str]) -> None:
        start = len(self.rows)
        self.rows.update(zip(tokens, range(start, start + len(tokens))))
        kept, digit = [], []
        for t in tokens:
            has = DIGIT.search(t) is not None
            digit.append(has)
            # The features of a short token without digits depend on these alone.
            key = (len(t), t.isascii() and t.isalpha(), t.isalpha(), KEYWORD.search(t) is not None) if len(t) < 16 and not has else None
            row = self.plain.get(key) if key else None
            if row is None:
                f, side = self.field, np.array(near(t))
                row = np.concatenate([np.array(shape(t), float) @ f.own, side @ f.left, side @ f.right])
                if key:
                    self.plain[key] = row
            kept.append(row)
        self.kept = np.concatenate([self.kept, np.array(kept, np.float32)])
        self.digit = np.concatenate([self.digit, np.array(digit)])

    def secrets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans (start, end) in code points of each text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        found = [TOKEN.findall(t) for t in texts]
        if len(self.rows) > self.most:
            self._clear()
        new = set().union(*found).difference(self.rows)
        if new:
            self._learn(list(new))
        rows, ids, heads, files, at = self.rows, [0], [], [], 1
        for text, tokens in zip(texts, found):
            heads.append(at)
            ids += [rows[t] for t in tokens]
            ids.append(0)
            at += len(tokens) + 1
        ids = np.array(ids)
        mixed = np.concatenate([[0], np.cumsum(self.digit[ids])])
        for text, tokens, a in zip(texts, found, heads):
            files.append(file_features(len(tokens), mixed[a + len(tokens)] - mixed[a], text))
        scores = self.kept[ids, :3].astype(float)
        scores[1:] += self.kept[ids[:-1], 3:6]
        scores[:-1] += self.kept[ids[1:], 6:9]
        file_scores = np.array(files) @ self.field.file
        scores[1:] += np.repeat(file_scores, [len(t) + 1 for t in found], axis=0)
        scores[:, O] += self.caution
        open_ = ((scores - scores[:, [O]]) + self.slack >= 0)[:, 1:].any(axis=1)
        open_[ids == 0] = False
        spots = np.flatnonzero(open_)
        if not len(spots):
            return out
        tagged: dict[int, dict[int, int]] = {}
        owner = np.searchsorted(heads, spots, "right") - 1
        breaks = np.flatnonzero(np.diff(spots) > 1) + 1
        for part, docs in zip(np.split(spots, breaks), np.split(owner, breaks)):
            first = part[0] == heads[docs[0]]
            last = part[-1] == heads[docs[0]] + len(found[docs[0]]) - 1
            for i, y in zip(part, self._viterbi(scores[part], first, last)):
                if y != O:
                    tagged.setdefault(int(docs[0]), {})[int(i) - heads[docs[0]]] = y
        for k, tags in tagged.items():
            for i, m in enumerate(TOKEN.finditer(texts[k])):
                y = tags.get(i, O)
                if y == B or y == I and not (out[k] and tags.get(i - 1, O) != O):
                    out[k].append(m.span())
                elif y == I:
                    out[k][-1] = (out[k][-1][0], m.end())
        return out

    def _viterbi(self, e: np.ndarray, first: bool, last: bool) -> list[int]:
        move = self.field.move
        best, back = e[0] + (self.field.start if first else move[O]), []
        for row in e[1:]:
            step = best[:, None] + move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        if not last:
            best = best + move[:, O]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


@guarded("_found")
def scan(docs: DataFrame, field: Field | None, caution: float = 0.0) -> DataFrame:
    """All rows with ``secrets``: array of (kind, start, end) in code points, and ``base_sha256``, ``span_text``.

    Pattern spans always stay; the field adds the spans that overlap none of them. ``caution`` is added to O's score;
    at 0 the tags are the field's likeliest. A null or empty text has no spans, an empty table gives an empty one, equal
    texts get equal spans; time grows with the length of a text, however many spans it holds. Input columns with these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("secrets", "base_sha256", "span_text")]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = T.StructType([T.StructField("secrets", T.ArrayType(span)), T.StructField("sha", T.StringType()), T.StructField("spans", T.StringType())])

    @F.pandas_udf(kind)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = _Tagger(field, caution) if field else None
        for series in batches:
            texts = [t if t is not None else "" for t in series]
            added: list[list[tuple[int, int]]] = []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < 1_000_000:
                    size += len(texts[j])
                    j += 1
                added += tagger.secrets(texts[i:j]) if tagger else [[] for _ in texts[i:j]]
                i = j
            out = []
            for text, more in zip(texts, added):
                base = [(s, k, e) for s, k, e, _ in base_matches(text)]
                cover = Cover([(s, e) for s, _, e in base])
                extra = [(s, 3, e) for s, e in more if not cover.reaches(s, e)]
                both = sorted(base + extra)
                out.append((
                    [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in both],
                    hashlib.sha256(_span_text(base).encode()).hexdigest(),
                    _span_text(both),
                ))
            yield pd.DataFrame(out, columns=["secrets", "sha", "spans"])

    found = docs.select(*names, find(F.col("text")).alias("_found"))
    return found.select(*names, F.col("_found.secrets").alias("secrets"), F.col("_found.sha").alias("base_sha256"), F.col("_found.spans").alias("span_text"))
