"""Substring dedup by recompression: removes passages whose words repeat anywhere in the corpus.

Words get names; a first round names runs of equal words, further rounds name pairs: every symbol is left or right by
its name, and a left symbol followed by a right one becomes one symbol. Names are 64-bit hashes of the parts' names,
so every task gives equal parts equal names without a table that grows with the corpus. Whether a symbol forms at
some place depends on its direct neighbours only: inside a window, all symbols but a few at either border come out
alike wherever the window stands. Its anchor is the longest of those interior symbols at the highest level that has
one (of equally long ones, the one of least hash); equal windows have equal anchors. Spark counts the anchors over the corpus, only windows with an anchor that
occurs twice are compared, by 96 bits of window and anchor name, and only those found twice count as repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import guarded
from riskloom.session import cut_lineage, drop_table, release

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 21), np.uint64(base))
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def _least(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Position of the leftmost smallest value in [left, right) for every row; ranges are not empty."""
    at, width = np.arange(len(values)), right - left
    out = left.copy()
    step, k = at, 0
    while True:
        here = (width >= 1 << k) & (width < 2 << k)
        if here.any():
            a, b = step[left[here]], step[right[here] - (1 << k)]
            out[here] = np.where(values[b] < values[a], b, a)
        if not (width >= 2 << k).any():
            return out
        a, b = step[: -(1 << k)], step[1 << k :]
        step = np.where(values[b] < values[a], b, a)
        k += 1


def anchors(words: np.ndarray, heads: np.ndarray, window: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, place) of every window's anchor over concatenated documents.

    ``words``: names of all words; ``heads``: start of each document, and the end. ``place`` is a word position that
    tells occurrences of one anchor apart.
    """
    n = len(words)
    sizes = np.diff(heads)
    ends = np.repeat(heads[1:], sizes)
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    name, place = np.zeros(len(starts), np.uint64), starts.copy()
    if not len(starts):
        return starts, name, place
    first = np.zeros(n, bool)
    first[heads[:-1][sizes > 0]] = True
    edge = first.copy()
    edge[1:] |= words[1:] != words[:-1]
    at = np.flatnonzero(edge)  # word position of every run
    run = np.cumsum(edge) - 1
    length = np.diff(np.append(at, n))
    sym = np.where(length > 1, _mix(words[at] + length.astype(np.uint64) * _A), words[at])
    head = first[at]  # first symbol of a document: never joined to the one before
    left, right = run[starts] + 1, run[starts + window - 1]
    todo = np.arange(len(starts))
    inside = left < right
    if not inside.all():  # one run, or two: the window itself is the anchor
        few = todo[~inside]
        name[few] = window_hashes(words, window)[starts[few]]
        todo, left, right = todo[inside], left[inside], right[inside]
    top = None  # windows that share their interior are one state; states thin out level by level
    stack: list[tuple] = []
    for level in range(rounds + 1):
        fresh = np.ones(len(left), bool)
        fresh[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        state = np.cumsum(fresh) - 1
        left, right = left[fresh], right[fresh]
        kind = (_mix(sym ^ _B) & np.uint64(1)).astype(bool)  # False: left, True: right
        label = _mix(sym + np.uint64(level * int(_A) % (1 << 64)))
        l = left + kind[left]
        r = right - ~kind[right - 1]
        go = l < r if level < rounds else np.zeros(len(left), bool)
        stay = np.flatnonzero(~go)
        best_name, best_at = np.zeros(len(left), np.uint64), np.zeros(len(left), np.int64)
        if len(stay):
            width = np.minimum(np.diff(np.append(at, n)), 255).astype(np.uint64)
            rank = ((np.uint64(255) - width) << np.uint64(56)) | (label >> np.uint64(8))  # longest first, then by hash
            best = _least(rank, left[stay], right[stay])
            best_name[stay], best_at[stay] = label[best], at[best]
        stack.append((state, go, best_name, best_at))
        if not go.any():
            break
        joined = np.zeros(len(sym), bool)
        joined[1:] = ~kind[:-1] & kind[1:] & ~head[1:]
        new = np.cumsum(~joined) - 1
        keep = np.flatnonzero(~joined)
        pair = np.append(joined[1:], False)[keep]
        upper = sym[np.minimum(keep + 1, len(sym) - 1)]
        sym = np.where(pair, _mix(sym[keep] * _A + _mix(upper)), sym[keep])
        last = new[-1] + 1
        at, head = at[keep], head[keep]
        l, r = l[go], r[go]
        left, right = new[l], np.where(r < len(new), new[np.minimum(r, len(new) - 1)], last)
    for state, go, best_name, best_at in reversed(stack):
        if top is not None:
            best_name[go], best_at[go] = top
        top = best_name[state], best_at[state]
    if top is not None:
        name[todo], place[todo] = top
    return starts, name, place


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` words from every position that has so many."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)])
    return _mix((sums[window:] - sums[:-window]) * _powers(_BACK, n - window + 1))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def named(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, concatenated, and where each text starts.

    A name is a polynomial hash of the word's bytes, mixed.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[data]
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begin, end = change[0::2], change[1::2]
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)
    words = _mix((sums[end - 1] - sums[begin - 1]) * _powers(_BACK, len(data))[begin] + (end - begin).astype(np.uint64))
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return words, np.searchsorted(begin, offsets).astype(np.int64)


def _blocks(pdf: pd.DataFrame, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` characters."""
    first = held = 0
    for k, text in enumerate(pdf["text"]):
        held += len(text)
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(pdf):
        yield first, len(pdf)


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _emit_anchors(window: int, rounds: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, checks = pdf["tk"].to_numpy(np.int64), pdf["tc"].to_numpy(np.int32)
            for a, b in _blocks(pdf):
                words, heads = named(_encoded(pdf["text"].iloc[a:b]))
                starts, name, place = anchors(words, heads, window, rounds)
                if not len(starts):
                    continue
                fresh = np.ones(len(starts), bool)
                fresh[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1])
                name, place = name[fresh], place[fresh]
                owner = np.searchsorted(heads, place, "right") - 1
                order = np.lexsort((place, name, owner))
                name, place, owner = name[order], place[order], owner[order]
                other = np.ones(len(name), bool)  # first row of each (text, name)
                other[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
                spot = np.ones(len(name), np.int64)
                spot[1:] = other[1:] | (place[1:] != place[:-1])
                at = np.flatnonzero(other)
                yield pd.DataFrame({
                    "tk": keys[a + owner[at]], "tc": checks[a + owner[at]], "name": name[at].view(np.int64),
                    "n": np.add.reduceat(spot, at),
                })

    return emit


def _emit_windows(window: int, rounds: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, checks = pdf["tk"].to_numpy(np.int64), pdf["tc"].to_numpy(np.int32)
            for a, b in _blocks(pdf):
                words, heads = named(_encoded(pdf["text"].iloc[a:b]))
                starts, name, _ = anchors(words, heads, window, rounds)
                if not len(starts):
                    continue
                owner = np.searchsorted(heads, starts, "right") - 1
                name = name.view(np.int64)
                held = np.zeros(len(name), bool)
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                for k, wanted in enumerate(pdf["names"].iloc[a:b]):
                    i, j = cuts[k], cuts[k + 1]
                    held[i:j] = np.isin(name[i:j], np.asarray(wanted, dtype=np.int64))
                if not held.any():
                    continue
                starts, owner, name = starts[held], owner[held], name[held]
                yield pd.DataFrame({
                    "tk": keys[a + owner], "tc": checks[a + owner], "start": (starts - heads[owner]).astype(np.int32),
                    "name": (name >> 32).astype(np.int32), "hash": window_hashes(words, window)[starts].view(np.int64),
                })

    return emit


def _cut_words(window: int):
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, starts: pd.Series, copied: pd.Series) -> pd.DataFrame:
        out = []
        for text, spots, copy in zip(texts, starts, copied):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            if copy and n >= window:
                out.append((n, n, ""))
            elif spots is None:
                out.append((n, 0, b" ".join(words).decode("utf-8", "surrogatepass")))
            else:
                depth = np.zeros(n + 1, np.int64)
                depth[spots] += 1
                depth[np.asarray(spots) + window] -= 1
                gone = np.cumsum(depth)[:n] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((n, int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return cut


@guarded("tk", "tc", "spots", "copied", "_cut")
def drop_repeats(docs: DataFrame, window: int = 35, rounds: int = 5) -> DataFrame:
    """All rows with ``n_words``, ``n_removed`` and ``kept``: the words outside every repeated window, one space apart.

    A window is ``window`` words in a row of one document; it is repeated if the same words also start anywhere else,
    in the same document or another, a copy of the row included. All windows are judged on the input. A null or empty
    text has no words. Columns with these three names are replaced, extra columns stay.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    keyed = docs.select(*names).withColumn("tk", F.xxhash64("text")).withColumn("tc", F.hash("text"))
    texts = keyed.filter(F.col("text").isNotNull()).select("doc_id", "text", "tk", "tc")
    copies = cut_lineage(texts.groupBy("tk", "tc").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("rep")))

    found = cut_lineage(texts.select("text", "tk", "tc").mapInPandas(_emit_anchors(window, rounds), "tk long, tc int, name long, n long"))
    release(spark)
    who = F.struct("tk", "tc")
    shared = found.groupBy("name").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.max("n").alias("n")).filter("a <> b OR n > 1")
    shared = cut_lineage(shared.select("name"))
    release(spark)
    wanted = found.join(shared, "name", "left_semi").groupBy("tk", "tc").agg(F.collect_set("name").alias("names"))
    wanted = cut_lineage(wanted.join(copies.select("tk", "tc", "rep"), ["tk", "tc"]))
    drop_table(found)
    release(spark)
    # One row per distinct text: of copies, the one with the smallest doc_id.
    chosen = texts.alias("t").join(
        wanted.alias("w"), (F.col("t.tk") == F.col("w.tk")) & (F.col("t.tc") == F.col("w.tc")) & F.col("t.doc_id").eqNullSafe(F.col("w.rep"))
    ).select("t.tk", "t.tc", "t.text", "w.names")
    shape = "tk long, tc int, start int, name int, hash long"
    candidates = cut_lineage(chosen.mapInPandas(_emit_windows(window, rounds), shape))
    release(spark)
    # Rows alike in doc_id and text give the same candidates again: a place counts once.
    place = F.xxhash64("tk", "tc", "start")
    twice = candidates.groupBy("name", "hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("name", "hash")
    twice = cut_lineage(twice)
    release(spark)
    repeated = candidates.join(twice, ["name", "hash"], "left_semi")
    spots = repeated.groupBy("tk", "tc").agg(F.collect_set("start").alias("spots"))
    again = copies.filter("rows > 1").select("tk", "tc", F.lit(True).alias("copied"))
    facts = cut_lineage(spots.join(again, ["tk", "tc"], "full_outer"))
    drop_table(candidates)
    release(spark)
    done = keyed.join(facts, ["tk", "tc"], "left").withColumn(
        "_cut", _cut_words(window)("text", "spots", F.coalesce("copied", F.lit(False)))
    )
    return done.select(*names, "_cut.n_words", "_cut.n_removed", "_cut.kept")
