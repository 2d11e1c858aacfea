"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the whole text in consecutive windows of WIDTH bytes, forwards and backwards, and
labels every position; a document's probabilities are the mean over its letters. It is trained in
numpy by backpropagation through time, on windows of a sample of labelled documents of bounded size.

lang_pred is `und`, with score 0, for null text and text without letters. Documents without lang
teach nothing; without any teacher every text is `und`. Repeated rows get the same label; among
equal probabilities the language that sorts first wins. Texts of any length are read in whole, and
only the training windows (max_rows documents, windows_each of each) are a sample. Columns other than
doc_id, text and lang don't matter, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, packed
from .textops import chunks

WIDTH, HIDDEN, BATCH = 64, 8, 4096
MAX_ROWS, WINDOWS_EACH = 3000, 6
UND = "und"
_letter = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_ascii_letter = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each row, (WIDTH, windows), padded by 0; and the row of each window."""
    length = np.diff(offs)
    each = -(-length // WIDTH)
    row = np.repeat(np.arange(len(length)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    start = offs[row] + nth * WIDTH
    at = start[None, :] + np.arange(WIDTH)[:, None]
    end = offs[row + 1]
    x = np.where(at < end, buf[np.minimum(at, max(len(buf) - 1, 0))], 0) if len(row) else np.zeros((WIDTH, 0), np.uint8)
    return x.astype(np.intp), row


@dataclass
class Network:
    langs: list[str]
    e: np.ndarray  # (2, 3 * HIDDEN, 256): what a byte adds to update gate, reset gate and candidate
    u: np.ndarray  # (2, 3 * HIDDEN, HIDDEN): what the state adds
    o: np.ndarray  # (languages, 2 * HIDDEN + 1): the labels from both states and a constant

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (WIDTH, languages, windows) of the label at each position."""
        b = x.shape[1]
        h, hs = np.zeros((2, HIDDEN, b), np.float32), np.empty((2, WIDTH, HIDDEN, b), np.float32)
        g, add = np.empty((2, 3 * HIDDEN, b), np.float32), np.empty((2, 3 * HIDDEN, b), np.float32)
        gates, new, reset, update = g[:, : 2 * HIDDEN], g[:, 2 * HIDDEN :], g[:, HIDDEN : 2 * HIDDEN], g[:, :HIDDEN]
        for t in range(WIDTH):
            np.take(self.e[0], x[t], axis=1, out=add[0], mode="clip")
            np.take(self.e[1], x[WIDTH - 1 - t], axis=1, out=add[1], mode="clip")
            np.matmul(self.u, h, out=g)
            gates += add[:, : 2 * HIDDEN]
            np.clip(gates, 0, 1, out=gates)
            new *= reset
            new += add[:, 2 * HIDDEN :]
            np.clip(new, -1, 1, out=new)
            new -= h
            new *= update
            h += new
            hs[0, t], hs[1, WIDTH - 1 - t] = h[0], h[1]
        z = np.matmul(self.o[:, :HIDDEN], hs[0])
        z += np.matmul(self.o[:, HIDDEN : 2 * HIDDEN], hs[1])
        z += self.o[:, -1:]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def label(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for i, j, buf, offs in chunks(column, 1 << 20):
            x, row = cut(buf, offs)
            rows = j - i
            total = np.zeros((len(self.langs), rows))
            letters = np.zeros(rows)
            for a in range(0, x.shape[1], BATCH):
                part, r = x[:, a : a + BATCH], row[a : a + BATCH]
                is_letter = _letter[part]
                p = np.einsum("tlb,tb->lb", self.positions(part), is_letter.astype(np.float32))
                letters += np.bincount(r, is_letter.sum(0), rows)
                for k in range(len(self.langs)):
                    total[k] += np.bincount(r, p[k], rows)
            sure = np.bincount(row, _ascii_letter[x].sum(0), rows) > 0 if x.shape[1] else np.zeros(rows, bool)
            for k in range(rows):
                if letters[k] and (sure[k] or any(c.isalpha() for c in (column[i + k].as_py() or ""))):
                    best = int(total[:, k].argmax())
                    names.append(self.langs[best])
                    scores.append(min(1.0, total[best, k] / letters[k]))
                else:
                    names.append(UND)
                    scores.append(0.0)
        return names, np.array(scores)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 350, batch: int = 256, seed: int = 7) -> Network:
    """Backpropagation through time on windows (WIDTH, n) of languages y, by Adam."""
    rng = np.random.default_rng(seed)
    n_langs, f = len(langs), np.float32
    e = rng.normal(0, 0.3, (2, 3 * HIDDEN, 256)).astype(f)
    e[:, : 2 * HIDDEN] = 0.5 + 0.3 * e[:, : 2 * HIDDEN]
    u = rng.normal(0, 0.3, (2, 3 * HIDDEN, HIDDEN)).astype(f)
    o = rng.normal(0, 0.3, (n_langs, 2 * HIDDEN + 1)).astype(f)
    params = [e, u, o]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.bincount(y, minlength=n_langs) / max(len(y), 1)
    cost = (1 / np.sqrt(np.maximum(share, 1e-6))).astype(f)
    H = HIDDEN
    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], batch)
        xb, yb = x[:, pick], y[pick]
        weight = (_letter[xb] * cost[yb]).astype(f)
        weight /= max(weight.sum(), 1e-6)
        h = np.zeros((2, H, batch), f)
        seen, hs = [], np.empty((2, WIDTH, H, batch), f)
        for t in range(WIDTH):
            add = np.stack([e[0][:, xb[t]], e[1][:, xb[WIDTH - 1 - t]]])
            a = u @ h
            gate = np.clip(a[:, : 2 * H] + add[:, : 2 * H], 0, 1)
            c = np.clip(gate[:, H:] * a[:, 2 * H :] + add[:, 2 * H :], -1, 1)
            seen.append((h, gate, a[:, 2 * H :], c))
            h = h + gate[:, :H] * (c - h)
            hs[0, t], hs[1, WIDTH - 1 - t] = h[0], h[1]
        both = np.concatenate([hs[0], hs[1], np.ones((WIDTH, 1, batch), f)], 1)
        z = o @ both
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[:, yb, np.arange(batch)] -= 1
        p *= weight[:, None, :]
        go = np.einsum("tlb,thb->lh", p, both, optimize=True)
        back = o.T[: 2 * H] @ p  # (WIDTH, 2 * H, batch)
        gu, gx = np.zeros_like(u), np.empty((2, 3 * H, WIDTH, batch), f)
        dh = np.zeros((2, H, batch), f)
        for t in range(WIDTH - 1, -1, -1):
            dh[0] += back[t, :H]
            dh[1] += back[WIDTH - 1 - t, H:]
            old, gate, ac, c = seen[t]
            dc = dh * gate[:, :H] * (np.abs(c) < 1)
            dz = dh * (c - old)
            dr = dc * ac
            open_ = (gate > 0) & (gate < 1)
            da = np.concatenate([dz * open_[:, :H], dr * open_[:, H:], dc * gate[:, H:]], 1)
            gx[:, : 2 * H, t], gx[:, 2 * H :, t] = da[:, : 2 * H], dc
            gu += da @ old.transpose(0, 2, 1)
            dh = dh * (1 - gate[:, :H]) + u.transpose(0, 2, 1) @ da
        ge = np.zeros_like(e)
        for d, order in enumerate((xb, xb[::-1])):
            flat = order.ravel()
            for k in range(3 * H):
                ge[d, k] = np.bincount(flat, gx[d, k].ravel(), 256)
        grads = [ge, gu, go]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, mm, vv in zip(params, grads, m, v, strict=True):
            g = g / max(1.0, norm)
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            q -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Network(langs, *[np.ascontiguousarray(p) for p in params])


def train(docs: DataFrame, max_rows: int = MAX_ROWS, windows_each: int = WINDOWS_EACH) -> Network | None:
    """From documents with a lang whose crc32 of doc_id mod 4 isn't 2: a sample of max_rows of them by a hash of the id, of each windows_each windows at most, spread over the whole text."""
    d = packed(docs, "doc_id", "text", "lang").where("lang is not null and text is not null").where(crc_mod("doc_id", 4) != 2)
    # the sample's ids first, so that only its texts are carried: max_rows rows at most
    pick = d.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(max_rows).select("doc_id").distinct()
    chosen = d.join(F.broadcast(pick), "doc_id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, wins = [], []
            for i, _, buf, offs in chunks(b.column("text")):
                x, row = cut(buf, offs)
                first = np.searchsorted(row, np.arange(len(offs)))
                for r in range(len(offs) - 1):
                    n = first[r + 1] - first[r]
                    for k in np.unique(np.linspace(0, n - 1, windows_each).astype(int)) if n else ():
                        at.append(i + r)
                        wins.append(x[:, first[r] + k].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), b.column("lang").take(pa.array(at, pa.int64())), pa.array(wins, pa.binary())], ["doc_id", "lang", "win"])

    rows = chosen.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(windows, "doc_id string, lang string, win binary")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "win").limit(max_rows * windows_each).select("lang", "win").collect()
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(r["win"], np.uint8) for r in got], 1).astype(np.intp)
    return fit(x, np.array([langs.index(r["lang"]) for r in got]), langs)


def labels(text: Column, model: Network | None) -> Column:
    """A struct of lang_pred and score of the whole text."""
    if model is None:
        return F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(column: pa.Array) -> pa.Array:
        names, scores = model.label(column)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return of(F.coalesce(text, F.lit("")))


def identify(docs: DataFrame, max_rows: int = MAX_ROWS, windows_each: int = WINDOWS_EACH) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang)."""
    model = train(docs, max_rows, windows_each)
    d = packed(docs, "doc_id", "text")
    return d.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), labels(F.col("text"), model).alias("l")).select("doc_id", "held_out", "l.lang_pred", "l.score")
