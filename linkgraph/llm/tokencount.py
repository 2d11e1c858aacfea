"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word; dynamic programming carries,
for each end, the best score and how many pieces it takes. Its rules are those of the exact unigram
tokenizer: words begin with the blank's sign, a character that is no piece itself may stand for
itself at the least score less 10 and counts as its bytes (or as one unknown piece with unknown
neighbours, if the vocabulary has no bytes), and among equal scores the piece that begins first wins.

Null and empty texts have no tokens. Every row is counted alone; repeated rows get the same count.
Texts and words of any length are read in whole. Columns other than doc_id and text don't matter,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

BLANK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, twice this at most, and the longest of them.
REMEMBER, LONGEST = 300_000, 32


def read_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in order of ids from a sentence-piece model file."""

    def fields(data: bytes):
        i = 0

        def varint() -> int:
            nonlocal i
            out = shift = 0
            while True:
                byte = data[i]
                i += 1
                out |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return out

        while i < len(data):
            key = varint()
            kind = key & 7
            if kind == 0:
                value = varint()
            elif kind == 2:
                n = varint()
                value = data[i : i + n]
                i += n
            else:
                n = 4 if kind == 5 else 8
                value = data[i : i + n]
                i += n
            yield key >> 3, value

    out = []
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                piece = dict(fields(value))
                out.append((piece[1].decode("utf8"), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    return out


@dataclass
class Counter:
    pieces: list[tuple[str, float]]
    old: dict = field(default_factory=dict)
    new: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in self.pieces:
            scores[piece] = score
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(s for _, s in self.pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        # whole scores add up exactly, so a line feed that is in no piece parts a word into independent ones
        self.parted = self.bytes and all(float(s).is_integer() for s in scores.values()) and not any("\n" in p for p in scores)

    def viterbi(self, word: str) -> int:
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            ends[end + 1].append(match)  # the longest of an end comes first
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top = None
            for length, score in ends[e]:
                s = best[e - length] + score
                if top is None or s > top:
                    top, start, is_unknown = s, e - length, False
            c = word[e - 1]
            if c not in self.single:
                s = best[e - 1] + self.unknown
                if top is None or s > top:
                    top, start, is_unknown = s, e - 1, True
            best[e], unknown[e] = top, is_unknown
            count[e] = count[start] + (1 if not is_unknown else len(c.encode("utf8", "surrogatepass")) if self.bytes else 0 if unknown[start] else 1)
        return count[n]

    def word(self, word: str) -> int:
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.viterbi(word)
            if len(word) <= LONGEST:
                if len(self.new) >= REMEMBER:
                    self.old, self.new = self.new, {}
                self.new[word] = found
        return found

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        words = (text[1:] if text[0] == BLANK else text).split(BLANK)
        known, total = self.new.get, 0
        for w in words:
            if self.parted and "\n" in w:
                first, *rest = w.split("\n")
                total += self.word(BLANK + first) + len(rest)
                for r in rest:
                    if r:
                        total += self.word(r)
                continue
            w = BLANK + w
            n = known(w)
            if n is None:
                n = self.word(w)
                known = self.new.get
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(pieces: tuple) -> Counter:
    return Counter(list(pieces))


def tokens(text: Column, spark, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; the vocabulary is read by the driver and broadcast (its file is under 10 MB)."""
    pieces = tuple(read_pieces(path))
    assert sum(len(p) for p, _ in pieces) < 10_000_000, "vocabulary too large to broadcast"
    shared = spark.sparkContext.broadcast(pieces)

    @F.arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        counter = _counter(shared.value)
        return pa.array([counter.text(t) for t in column.to_pylist()], pa.int64())

    return of(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens for each row of docs (doc_id, text)."""
    d = packed(docs, "doc_id", "text")
    return d.select("doc_id", tokens(F.col("text"), docs.sparkSession, path).alias("n_tokens"))
