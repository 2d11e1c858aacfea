"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Small boosted trees are fitted to labelled rows; every path from a root to a node is a rule, the
conjunction of its tests. A logistic regression with an L1 penalty gives the rules weights, most of
them zero. What is left becomes one Spark column expression over the statistics, which are counted
over the whole text.

Null text counts as empty text, which has a score too. Labels that are null, or other than 0 and 1,
teach nothing; with labels of one kind or none the score is their share, 0.5 without any. Repeated
rows are scored alike; a score of just 0.5 is label 1. Only a sample of labelled rows of bounded size
(max_rows) is ever collected. Texts of any length are read in whole; accepted_rows judges null and empty
texts as any other. Columns other than those named don't matter, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, packed
from .textops import SPACED, Words, chunks

MAX_ROWS = 20_000

STATS = ("chars", "words", "word_len", "max_word", "upper", "digit", "symbol", "punct", "space", "wide", "lines", "line_words", "distinct_words", "distinct_lines", "symbol_words", "caps_words", "top_word", "letters")

_classes = np.zeros(256, np.uint8)
for _c in range(256):
    ch = chr(_c)
    _classes[_c] = 7 if _c >= 0xC0 else 6 if _c >= 0x80 else 1 if "A" <= ch <= "Z" else 2 if ch.isdigit() else 3 if ch in "#$%&*|@^~_=<>{}[]\\+`" else 4 if ch in ".,;:!?'\"()-/" else 5 if _c <= 32 else 0
_symbol_end = np.isin(np.arange(256), [ord(x) for x in "#$%&*|@!"])


def _stats(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATS for each text of a run."""
    rows = len(offs) - 1
    kind = _classes[buf]
    row = np.repeat(np.arange(rows), np.diff(offs))
    by = np.bincount(row * 8 + kind, minlength=rows * 8).reshape(rows, 8).astype(float)
    chars = by.sum(1) - by[:, 6]
    w = Words(buf, offs, SPACED)
    n = w.count.astype(float)
    length = (w.end - w.start).astype(float)
    word_row = w.row_of()
    breaks = np.bincount(row[buf == 10], minlength=rows).astype(float)
    last = np.bincount(word_row[_symbol_end[buf[w.end - 1]]], minlength=rows)
    caps = np.concatenate([[0], np.cumsum(kind == 1)])
    letters = np.concatenate([[0], np.cumsum((kind == 0) | (kind == 1) | (kind == 7))])
    shout = (caps[w.end] - caps[w.start] >= 2) & (2 * (caps[w.end] - caps[w.start]) > letters[w.end] - letters[w.start])
    shouted = np.bincount(word_row[shout], minlength=rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, word_row, length)
    # distinct words and lines
    order = np.lexsort((w.hash, word_row))
    h, r = w.hash[order], word_row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=rows).astype(float)
    at = np.flatnonzero(new)
    top = np.zeros(rows)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(h))).astype(float))
    cuts = np.union1d(np.flatnonzero(buf == 10) + 1, offs)
    first = np.searchsorted(w.start, cuts)
    full = np.flatnonzero(np.diff(first) > 0)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * (np.arange(len(w.hash), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))])
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash)])
    # the same for equal lines wherever they stand: sum of hash * (2 * place in the line + 1)
    line = (c[first[full + 1]] - c[first[full]]) - (s[first[full + 1]] - s[first[full]]) * (first[full].astype(np.uint64) * np.uint64(2))
    line_row = np.searchsorted(offs, cuts[full], "right") - 1
    order = np.lexsort((line, line_row))
    a, b = line[order], line_row[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lines = np.bincount(line_row, minlength=rows).astype(float)
    distinct_lines = np.bincount(b[new], minlength=rows).astype(float)
    share = lambda x, y: x / np.maximum(y, 1)
    return np.stack([chars, n, share(np.bincount(word_row, length, rows), n), longest, share(by[:, 1], chars), share(by[:, 2], chars), share(by[:, 3], chars), share(by[:, 4], chars), share(by[:, 5], chars), share(by[:, 7], chars), breaks, share(n, lines), share(distinct, n), share(distinct_lines, lines), share(last, n), share(shouted, n), share(top, n), share(by[:, 0] + by[:, 1] + by[:, 7], chars)], 1)


_TYPE = pa.struct([(s, pa.float64()) for s in STATS])


def statistics(text: Column) -> Column:
    """A struct of STATS of the whole text."""

    @F.arrow_udf("struct<" + ",".join(f"{s}:double" for s in STATS) + ">")
    def of(column: pa.Array) -> pa.Array:
        runs = [_stats(buf, offs) for _, _, buf, offs in chunks(column)]
        m = np.concatenate(runs) if runs else np.zeros((0, len(STATS)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(m[:, k])) for k in range(len(STATS))], fields=list(_TYPE))

    return of(F.coalesce(text, F.lit("")))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: Column) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = None
            for k, above, at in rule:
                c = stats[STATS[k]] > at if above else stats[STATS[k]] <= at
                test = c if test is None else test & c
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, above, at in rule:
        ok &= (x[:, k] > at) == above
    return ok


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule], step: np.ndarray, rate: float) -> None:
    """One regression tree on gradients; notes the path of each node, adds the leaf values to step."""
    best = (1e-9, -1, -1)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 20:
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            a = np.cumsum(np.bincount(bins[rows, k], g[rows], len(c) + 1))[:-1]
            b = np.cumsum(np.bincount(bins[rows, k], h[rows], len(c) + 1))[:-1]
            m = np.cumsum(np.bincount(bins[rows, k], minlength=len(c) + 1))[:-1]
            gain = a**2 / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
            gain[(m < 5) | (len(rows) - m < 5)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, i)
    if best[1] < 0:
        step[rows] += rate * total_g / (total_h + 1)
        return
    _, k, i = best
    low = bins[rows, k] <= i
    for above, part in ((False, rows[low]), (True, rows[~low])):
        here = (*path, (k, above, float(cuts[k][i])))
        out.append(here)
        _grow(bins, cuts, g, h, part, depth - 1, here, out, step, rate)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> Ensemble:
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 10 or y.min() == y.max():
        return Ensemble(base, [])
    rng = np.random.default_rng(seed)
    values = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 49))) for k in range(x.shape[1])]
    cuts = [(v[1:] + v[:-1]) / 2 for v in values]
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    z = np.full(len(y), base)
    rules: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(10, len(y) // 2)])
        step = np.zeros(len(y))
        found: list[Rule] = []
        _grow(bins, cuts, y - p, p * (1 - p), rows, depth, (), found, step, 0.3)
        rules += found
        z += step
    rules = sorted(set(rules))
    m = np.stack([_holds(r, x) for r in rules], 1).astype(np.float32)
    # rules that hold for the same rows are one rule: the shortest
    keep: dict[bytes, int] = {}
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i]), rules[i])):
        keep.setdefault(np.packbits(m[:, i] > 0).tobytes(), i)
    at = sorted(keep.values())
    rules, m = [rules[i] for i in at], m[:, at]
    # logistic loss with an L1 penalty, by accelerated proximal steps
    n = len(y)
    lam = 1.0 / np.sqrt(n) * 0.15
    v = np.ones(m.shape[1], np.float32)
    for _ in range(12):
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v) + 1e-12
    size = float(np.linalg.norm(m @ v) ** 2) + n
    rate = 4 * n / size
    w, b = np.zeros(m.shape[1]), base
    wy, by, t = w.copy(), b, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(m @ wy.astype(np.float32) + by)))
        r = (p - y) / n
        new = wy - rate * (m.T @ r.astype(np.float32))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lam, 0)
        nb = by - rate * r.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return Ensemble(float(b), [(r, round(float(c), 6)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ensemble:
    """From labelled rows whose crc32 of doc_id mod 3 isn't 1; a sample of max_rows by a hash of the id if there are more."""
    known = packed(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(crc_mod("doc_id", 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = packed(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")  # max_rows ids at most
    stats = texts.select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", statistics(F.col("text")).alias("s")).orderBy("h", "doc_id", *[f"s.{k}" for k in STATS]).limit(max_rows)
    rows = stats.select("quality", *[F.col(f"s.{k}").alias(k) for k in STATS]).toPandas()
    return fit(rows[list(STATS)].to_numpy(float), rows["quality"].to_numpy(float))


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    stats = packed(docs, "doc_id", "text").select("doc_id", statistics(F.col("text")).alias("stats"))
    out = stats.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return out.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return scored(docs, train(docs, labels, max_rows))


def accepted_rows(docs: DataFrame, known: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that a model trained on known and labels doesn't reject, all of their columns."""
    model = train(known, labels, max_rows)
    rows = packed(docs, keep="row").select("row", statistics(F.col("row.text")).alias("stats"))
    return rows.where(model.score(F.col("stats")) >= 0.5).select("row.*")
