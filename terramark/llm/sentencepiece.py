r"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary is read once on the driver from a model file whose path is a parameter; the trie's
arrays are broadcast, bounded by the vocabulary. A unigram model's scores are used as they are. A
model of merges has ranks in their place, whose sums mean nothing: its pieces get the logarithm of
their probability under Zipf's law for their rank, so that the best path is the likeliest
segmentation under that law. Nothing is trained. Blanks become the marker
U+2581 and a marker is put in front; since no piece has a marker behind another character, each
run of markers with the characters up to the next marker can be segmented by itself, and the best
segmentation of the whole text is the chain of theirs. Characters that no piece covers cost the
lowest score less 10 and are written as their UTF-8 bytes' pieces.

Defined cases: a null text gives null ids, an empty text none. A marker character that a text
itself contains is written in bytes, so that decoding gives back every text exactly. Surrogates
can't occur in Spark's strings. Repeated rows give equal rows; other columns pass through.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import short_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words of up to so many bytes are segmented side by side, longer ones one by one.
SIDE_BY_SIDE = (12, 20, 36, 64)
#: A worker forgets the words it has segmented when there are more than so many.
KNOWN_WORDS = 100_000


def double_array(keys: list[tuple[bytes, int]]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a trie: the child of state s by byte c is t = base[s] + c + 1 if
    check[t] == s; value[t] is the key's number or -1."""
    tree: dict = {}
    for key, number in keys:
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = number
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], free = 0, 1
    todo = [(0, tree)]
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        codes = sorted(c + 1 for c in node if c >= 0)
        if not codes:
            continue
        at, tried, taken = max(free - codes[0], 0), 0, 0
        while True:
            if at + 300 > len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            if check[at + codes[0]] < 0:
                if all(check[at + c] < 0 for c in codes):
                    break
            else:
                taken += 1
            tried += 1
            at += 1
        if taken >= 0.9 * tried:  # hardly a free place up to here: later searches start here
            free = max(free, at + codes[0])
        base[state] = at
        for c in codes:
            check[at + c] = state
        for c in codes:
            todo.append((at + c, node[c - 1]))
    return base, check, value


def zipf_scores(ranks: list[float], kinds: list[str]) -> list[float]:
    """log(1 / (k * sum of all 1 / i)) for the k-th normal piece by descending score; others 0."""
    order = sorted((i for i, k in enumerate(kinds) if k == "normal"), key=lambda i: (-ranks[i], i))
    total = math.log(sum(1 / (k + 1) for k in range(len(order)))) if order else 0.0
    scores = [0.0] * len(ranks)
    for k, i in enumerate(order):
        scores[i] = -math.log(k + 1) - total
    return scores


class Vocabulary:
    """Pieces, scores and the trie."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: normal, byte or other (control, unknown and unused pieces)."""
        if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds) if k == "normal"):
            raise ValueError("a piece has a marker behind another character")
        normal = [(p.encode(), i) for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal" and p]
        self.scores = list(scores)
        self.unknown = min((scores[i] for _, i in normal), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = [-1] * 256
        self.raw: list[bytes | None] = [None] * len(pieces)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif k == "normal":
                self.raw[i] = p.replace(MARK, " ").encode()
        if min(self.byte_ids) < 0:
            raise ValueError("byte fallback needs a piece for each byte")
        self.arrays = tuple(np.array(x + [-1] * 300, np.int32) for x in double_array(normal))
        self.score_array = np.array(scores)
        self.byte_array = np.array(self.byte_ids, np.int32)
        raw = [r or b"" for r in self.raw]
        self.raw_flat = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.cumsum([0, *map(len, raw)])
        self.forget()

    @classmethod
    @functools.cache
    def read(cls, path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in ids]
        scores = [m.get_score(i) for i in ids]
        # Log probabilities add up to one over the normal pieces; ranks are whole numbers down to minus thousands.
        if sum(math.exp(x) for x, k in zip(scores, kinds) if k == "normal") > 1.5 or all(x == int(x) for x in scores):
            scores = zipf_scores(scores, kinds)
        return cls([m.id_to_piece(i) for i in ids], scores, kinds)

    def best_path(self, word: str) -> tuple[int, ...]:
        """Viterbi: the pieces of the highest sum of scores; earlier starts win ties."""
        data = word.encode()
        n, scores = len(data), self.scores
        base, check, value = (memoryview(x) for x in self.arrays)
        best: list[float | None] = [None] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            first = data[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, s, single = best[i], 0, False
            for j in range(i, n):
                t = base[s] + data[j] + 1
                if check[t] != s:
                    break
                s = t
                v = value[s]
                if v >= 0:
                    score, to = here + scores[v], j + 1
                    if best[to] is None or score > best[to]:
                        best[to], back[to], piece[to] = score, i, v
                    if to == i + width:
                        single = True
            if not single:
                score, to = here + self.unknown, i + width
                if best[to] is None or score > best[to]:
                    best[to], back[to], piece[to] = score, i, -1
            i += width
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.byte_ids[c] for c in reversed(data[back[n]:n])]
            n = back[n]
        return tuple(reversed(out))

    def forget(self) -> None:
        """No word is known but the empty one, which stands for a marker of the text itself."""
        self.known, self.flat, self.at = {"": 0}, np.array([self.byte_ids[c] for c in MARK.encode()], np.int32), np.array([0, 3])

    def __getstate__(self):
        return self.__dict__ | {"known": {"": 0}, "flat": self.flat[:3], "at": self.at[:2]}

    def _side_by_side(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """best_path of each word, all words advancing together: flat ids and their words' numbers."""
        base, check, value = self.arrays
        n = np.array([len(w) for w in words])
        data = np.zeros((len(words), n.max()), np.uint8)
        data[np.arange(n.max()) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        best = np.full((len(words), n.max() + 1), -np.inf)
        back, piece = np.zeros(best.shape, np.int16), np.full(best.shape, -1, np.int32)
        best[:, 0] = 0.0

        def offer(rows: np.ndarray, to: np.ndarray, score: np.ndarray, start: int, number: np.ndarray) -> None:
            higher = score > best[rows, to]
            rows, to = rows[higher], to[higher]
            best[rows, to], back[rows, to], piece[rows, to] = score[higher], start, number[higher]

        for i in range(n.max()):
            rows = np.flatnonzero((i < n) & ((data[:, i] & 0xC0) != 0x80))
            single = np.zeros(len(words), bool)
            live, s = rows, np.zeros(len(rows), np.int32)
            for j in range(i, n.max()):
                inside = j < n[live]
                live, s = live[inside], s[inside]
                t = base[s] + data[live, j] + 1
                ok = check[t] == s
                live, s = live[ok], t[ok]
                if not len(live):
                    break
                v = value[s]
                hit = v >= 0
                r = live[hit]
                offer(r, np.full(len(r), j + 1), best[r, i] + self.score_array[v[hit]], i, v[hit])
                single[r[i + width[r, i] == j + 1]] = True
            r = rows[~single[rows]]
            offer(r, i + width[r, i], best[r, i] + self.unknown, i, np.full(len(r), -1, np.int32))
        parts, rows, at = [], np.arange(len(words)), n.copy()
        while len(rows):
            start = back[rows, at].astype(np.int64)
            parts.append((rows, at, start, piece[rows, at]))
            rows, at = rows[start > 0], start[start > 0]
        row, end, start, number = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((end, row))
        row, end, start, number = row[order], end[order], start[order], number[order]
        times = np.where(number >= 0, 1, end - start)
        nth = _ragged(start, times)
        number, row = np.repeat(number, times), np.repeat(row, times)
        raw = number < 0
        number[raw] = self.byte_array[data[row[raw], nth[raw]]]
        return number, row

    def best_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words one after the other, and where each word's begin."""
        coded = [w.encode() for w in words]
        size = np.array([len(w) for w in coded])
        ids, owners, low = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for high in SIDE_BY_SIDE:
            at = np.flatnonzero((size > low) & (size <= high))
            if len(at):
                number, row = self._side_by_side([coded[i] for i in at])
                ids.append(number)
                owners.append(at[row])
            low = high
        for i in np.flatnonzero(size > low):
            ids.append(np.array(self.best_path(words[i]), np.int32))
            owners.append(np.full(len(ids[-1]), i))
        flat, owner = np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; each word is segmented once while it is known."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        number, had = self.known, len(self.known)
        found, sizes = [], []
        for text in texts:
            words = []
            for k, part in enumerate(text.split(MARK)):
                if k:
                    words += [""]
                part = part.replace(" ", MARK)
                words += _WORDS.findall(MARK + part if not k and text else part)
            found += [number.setdefault(w, len(number)) for w in words]
            sizes.append(len(words))
        if len(number) > had:
            flat, at = self.best_paths(list(itertools.islice(number, had, None)))
            self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + at[1:]])
        flat, at = self.flat, self.at
        word = np.array(found, np.int64)
        length = at[word + 1] - at[word]
        ids = flat[_ragged(at[word], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(sizes)] if sizes else []
        return np.split(ids, ends)[:len(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.asarray(ids, np.int64)
        start = self.raw_at[ids]
        data = self.raw_flat[_ragged(start, self.raw_at[ids + 1] - start)].tobytes().decode("utf-8", "replace")
        return data[1:] if data[:1] == " " else data


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(length.sum())


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def tokenised(docs: DataFrame, path: str = MODEL_PATH, text_col: str = "text") -> DataFrame:
    """`docs` with token_ids, n_tokens, n_bytes_tokens and round_trip (the ids decode to the text)."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @F.pandas_udf("token_ids array<int>, n_tokens int, n_byte_tokens int, round_trip boolean")
    def both(texts: pd.Series) -> pd.DataFrame:
        v = shared.value
        low, high = min(v.byte_ids), max(v.byte_ids)
        rows, ids = [], iter(v.encode_all([t for t in texts if t is not None]))
        for t in texts:
            if t is None:
                rows.append((None, None, None, None))
                continue
            x = next(ids)
            rows.append((x, len(x), int(((x >= low) & (x <= high)).sum()), v.decode(x) == t))
        return pd.DataFrame(rows, columns=["token_ids", "n_tokens", "n_byte_tokens", "round_trip"]).astype(
            {"n_tokens": "Int32", "n_byte_tokens": "Int32", "round_trip": "boolean"})

    found = docs.withColumn("__terramark_tokens", both(docs[text_col].cast("string")))
    names = ["token_ids", "n_tokens", "n_byte_tokens", "round_trip"]
    return found.select(*[found[c] for c in docs.columns if c not in names], *[F.col(f"__terramark_tokens.{c}") for c in names])


def decoded(frame: DataFrame, path: str = MODEL_PATH, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """`frame` with the text that its ids stand for; null ids give null."""
    shared = frame.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(x) for x in ids], dtype=object)

    return frame.withColumn(text_col, decode(frame[ids_col]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
