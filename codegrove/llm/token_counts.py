"""Token counts by a tokenizer compiled to a finite-state transducer.

A byte-pair vocabulary in which any two neighbours whose concatenation is a piece may merge, best score first and then
leftmost, encodes each prefix of a text in a way that depends on a bounded suffix: the last piece of a prefix is the one
suffix piece that is compatible with the last piece of what precedes it. A state therefore holds the suffixes of the text
read so far that begin some piece, and for each the last piece before it and the count of tokens up to it, relative to
the count so far. States are found as texts need them and kept in a table (state, character) -> (state, tokens), so that
the transducer is deterministic and its transitions carry the change of the token count.

Texts are cut into chunks, which advance side by side, one character a step. A chunk's state map is kept for the state it
was entered by: the first guess is the state reached from the start over the few characters before the chunk. Maps of a
document compose where one's end state is the next one's start state; in the scan over a document's chunks those that do
not fit are mapped again from the right state, until all compose. Counts add up.

Edge cases: a null text counts as empty, an empty text has no tokens; characters without a piece count one token per
UTF-8 byte; texts of any length are read whole; repeated rows count alike; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

CHUNK, WARM = 512, 24
#: Entries of the transition table beyond which it starts anew.
MOST = 40_000_000
SPACE = "▁"
LIMIT = 4096


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = s = 0
    while True:
        r |= (b[i] & 127) << s
        s += 7
        i += 1
        if b[i - 1] < 128:
            return r, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def read_model(path: str) -> tuple[dict[str, float], bool]:
    """Scores of the ordinary pieces, and whether a space is put before a text."""
    scores, prefix = {}, True
    for f, v in _fields(Path(path).read_bytes()):
        if f == 1:
            piece = dict(_fields(v))
            if piece.get(3, 1) == 1:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
            elif piece[3] in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
        elif f == 3:
            spec = dict(_fields(v))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only models that leave the text as it is are supported")
            prefix = bool(spec.get(3, 1))
        elif f == 2:
            spec = dict(_fields(v))
            if spec.get(3, 1) != 2 or not spec.get(35, 0):
                raise ValueError("only byte-pair models with byte fallback are supported")
    return scores, prefix


class Transducer:
    """States are found on demand. State 0 is the start; it is entered again behind each character without a piece."""

    def __init__(self, path: str):
        self.scores, self.prefix = read_model(path)
        self.starts = {p[:k] for p in self.scores for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.scores))
        self.alphabet = {p for p in self.scores if len(p) == 1}
        if any(set(p) - self.alphabet for p in self.scores):
            raise ValueError("a piece has a character that is none")
        #: A space behind another character always starts a new token.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.made: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.moves: dict[tuple[str, str], tuple[list[tuple[int, str]], list[int], str]] = {}
        self.letters: list[str] = []
        self.column = np.full(0x110000, -1, np.int32)
        self.width = 64
        self._clear()

    def _clear(self) -> None:
        #: A state: its suffixes that begin a piece are given by the longest; for each the piece before it ("" for none that matters) and the count up to it, relative; longest first.
        self.states: list[tuple[str, tuple[tuple[str, int], ...]]] = [("", (("", 0),))]
        self.number = {self.states[0]: 0}
        #: At state * width + column: the next state * 32 + the change of the count + 16, or -1.
        self.table = np.full(1024 * self.width, -1, np.int32)

    def merges(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """Merges by score, leftmost first, of a short text without unknown characters: the parts, and for each merge its score and the first and last part behind it."""
        parts = list(text)
        score, first, last = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            can = [self.scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = can.index(top := max(can))
            if top == -np.inf:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            score.append(top)
            first.append(parts[0])
            last.append(parts[-1])
        return parts, score, first, last

    def fit(self, a: str, b: str) -> bool:
        """Whether a and b are neighbours in the encoding of their concatenation: no merge joins a's last and b's first part while both are made."""
        found = self.fits.get((a, b))
        if found is None:
            for p in (a, b):
                if p not in self.made:
                    self.made[p] = self.merges(p)[1:]
            (sa, _, la), (sb, fb, _) = self.made[a], self.made[b]
            i = j = 0
            while True:
                over = self.scores.get(la[i] + fb[j])
                left, right = sa[i] if i < len(sa) else -np.inf, sb[j] if j < len(sb) else -np.inf
                if over is not None and over > left and over >= right:
                    found = False
                    break
                if left == right == -np.inf:
                    found = True
                    break
                if left >= right:
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = found
        return found

    def reachable(self, p: str) -> bool:
        if p not in self.whole:
            self.whole[p] = self.merges(p)[0] == [p]
        return self.whole[p]

    def move(self, suffix: str, letter: str) -> tuple[list[tuple[int, str]], list[int], str]:
        """For a suffix and the next character: which marks end a piece, which stay, and the new suffix."""
        if (suffix, letter) not in self.moves:
            text = suffix + letter
            lengths = [n for n in range(len(suffix), 0, -1) if suffix[len(suffix) - n :] in self.starts] + [0]
            ends = [(k, p) for k, n in enumerate(lengths) if (p := text[len(text) - n - 1 :]) in self.scores and self.reachable(p)]
            stay = [k for k, n in enumerate(lengths) if text[len(text) - n - 1 :] in self.starts]
            self.moves[suffix, letter] = ends, stay, text[len(text) - lengths[stay[0]] - 1 :]
        return self.moves[suffix, letter]

    def step(self, state: int, column: int) -> None:
        """Find the transition of a state by a character."""
        letter = self.letters[column]
        if letter not in self.alphabet:
            new, added = self.states[0], len(letter.encode("utf-8", "replace"))
        else:
            suffix, marks = self.states[state]
            ends, stay, longest = self.move(suffix, letter)
            for k, piece in ends:
                before, rel = marks[k]
                if not before or self.fit(before, piece):
                    added = rel + 1
                    break
            else:
                raise AssertionError(f"no last piece behind {suffix + letter!r}")
            if self.splits and letter == SPACE and suffix[-1:] not in ("", SPACE):
                new = (SPACE, (("", -1), (SPACE, 0)))  # what precedes is settled
            else:
                new = (longest, (*((marks[k][0], marks[k][1] - added) for k in stay), (piece, 0)))
        if (to := self.number.get(new)) is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
            if len(self.states) * self.width > len(self.table):
                self.table = np.concatenate((self.table, np.full(max(len(self.table) // 2, self.width), -1, np.int32)))
        self.table[state * self.width + column] = to * 32 + added + 16

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """Columns of the characters. Tables that have grown past their bound start anew; a state is found again when it is needed."""
        at = self.column[codes]
        if len(at) and at.min() < 0:
            for c in np.unique(codes[at < 0]).tolist():
                self.column[c] = len(self.letters)
                self.letters.append(chr(c))
            at = self.column[codes]
        if len(self.letters) > self.width or len(self.states) * self.width > MOST:
            while len(self.letters) > self.width:
                self.width *= 2
            self._clear()
            if len(self.fits) > 2_000_000:
                self.fits.clear()
        return at

    def advance(self, cols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Map each chunk cols[begin:end] from its state: end states and token counts. Chunks advance side by side."""
        order = np.argsort(begin - end, kind="stable")
        at, state, total = begin[order], state[order], np.zeros(len(order), np.int32)
        length = (end - begin)[order]
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for k, n in enumerate(live.tolist()):
            c = cols[at[:n] + k]
            i = state[:n] * self.width + c
            to = self.table[i]
            if to.min() < 0:
                miss = np.unique(i[to < 0])
                for x in miss.tolist():
                    self.step(*divmod(x, self.width))
                to = self.table[i]
            total[:n] += to & 31
            state[:n] = to >> 5
        out_s, out_t = np.empty_like(state), np.empty(len(order), np.int64)
        out_s[order], out_t[order] = state, total - 16 * length
        return out_s, out_t

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole texts."""
        texts = [(SPACE + t if self.prefix and t else t or "").replace(" ", SPACE) for t in texts]
        cols = self.columns(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        n = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(texts)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = start[doc] + k * CHUNK
        end = np.minimum(begin + CHUNK, start[doc] + size[doc])
        entered = np.zeros(len(doc), np.int64)
        entered[k > 0] = self.advance(cols, begin[k > 0] - WARM, begin[k > 0], entered[k > 0])[0]
        left, total = self.advance(cols, begin, end, entered)
        while True:  # the scan: map those again that were entered by another state
            redo = np.flatnonzero((k > 0) & (entered != np.concatenate(([0], left[:-1]))))
            if not len(redo):
                break
            entered[redo] = left[redo - 1]
            left[redo], total[redo] = self.advance(cols, begin[redo], end[redo], entered[redo])
        return np.bincount(doc, weights=total, minlength=len(texts)).astype(np.int64)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row's whole text; `path` names the tokenizer's file on every machine."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(machine.tokens(texts))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
