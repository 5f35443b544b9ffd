r"""Language ID by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton. A text is parsed
from left to right into the longest phrases that occur in the sample; the language that needs the
fewest phrases, weighted by the bits that point into its sample, wins. Whole texts are parsed:
they are cut into segments of SEGMENT symbols that step through the automata side by side (a cut
ends a phrase in every language alike).

Bounds of the fit, as parameters: `docs_per_language` labelled documents of at most `doc_chars`
characters, `sample_symbols` symbols per language, `max_languages` languages. The sample's
documents are those of smallest hash of their id, so the fit doesn't depend on partitioning.

Defined cases: learned from are only documents with text, a lang, an id and crc32(id as text)
mod 4 other than 2. Null text, text without a letter, or no learned language give `und` and score
0. Ties go to the language that sorts first. A null id is never held out. The prediction reads
the text alone. Other columns pass through unchanged in `with_language`.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import short_batches

DOCS_PER_LANGUAGE, DOC_CHARS, SAMPLE_SYMBOLS, MAX_LANGUAGES = 64, 4096, 24_000, 256
SEGMENT = 512
NEW_PHRASE = 1 << 30


def letters(text: str) -> bytes:
    """Lower-cased UTF-8 in which each byte that is no letter's becomes a blank."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKED)


_BLANKED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _single_blanks(x: np.ndarray) -> np.ndarray:
    """A mask that keeps the first blank of each run of blanks."""
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return keep


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the start, every path from it is a substring."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


def step_table(text: bytes, symbol: np.ndarray, width: int) -> np.ndarray:
    """One step of parsing for each state and symbol: the next row's offset, with NEW_PHRASE
    where the phrase can't be extended and the next one starts at this symbol."""
    go = suffix_automaton(text)
    table = np.full((len(go) + 1, width), -1, np.int32)  # in the last row no phrase is open
    for s, edges in enumerate(go):
        for c, t in edges.items():
            table[s, symbol[c]] = t * width
    start = np.where(table[0] < 0, len(go) * width, table[0]) + NEW_PHRASE
    return np.where(table < 0, start.astype(np.int32), table).ravel()


@functools.lru_cache(maxsize=1)
def _parsers(samples: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, list[np.ndarray], int]:
    used = sorted(set(b"".join(s for _, s in samples)))
    symbol = np.full(256, len(used), np.uint8)  # the last symbol occurs in no sample
    symbol[used] = np.arange(len(used))
    width = len(used) + 1
    return symbol, [step_table(s, symbol, width) for _, s in samples], width


def phrase_counts(samples: tuple[tuple[str, bytes], ...], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) phrases, and the symbols of each text."""
    symbol, tables, width = _parsers(samples)
    coded = [letters(t) for t in texts]
    flat = np.frombuffer(b"".join(coded), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in coded])
    keep = _single_blanks(flat)
    flat, owner = symbol[flat[keep]], owner[keep]
    size = np.bincount(owner, minlength=len(texts))
    per_text = -(-size // SEGMENT)
    seg_owner = np.repeat(np.arange(len(texts)), per_text)
    nth = np.arange(len(seg_owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    seg_len = np.minimum(SEGMENT, size[seg_owner] - nth * SEGMENT)
    grid = np.zeros((len(seg_owner), SEGMENT), np.uint8)
    grid[np.arange(SEGMENT) < seg_len[:, None]] = flat
    order = np.argsort(-seg_len, kind="stable")
    grid, seg_len, seg_owner = np.ascontiguousarray(grid[order].T), seg_len[order], seg_owner[order]
    active = np.searchsorted(-seg_len, -np.arange(SEGMENT), side="left")  # segments longer than t
    out = np.zeros((len(texts), len(tables)), np.int64)
    for k, table in enumerate(tables):
        state, count = np.full(len(seg_len), len(table) - width, np.int32), np.zeros(len(seg_len), np.int32)
        for t in range(SEGMENT):
            a = active[t]
            if not a:
                break
            step = table[state[:a] + grid[t, :a]]
            count[:a] += step >> 30
            state[:a] = step & (NEW_PHRASE - 1)
        out[:, k] = np.bincount(seg_owner, count, len(texts)).astype(np.int64)
    return out, size


def predict(samples: tuple[tuple[str, bytes], ...], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score: how far the winner's cost lies below the runner-up's, from 0 to 1."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    if not at or not samples:
        return lang, score
    counts, _ = phrase_counts(samples, [texts[i] for i in at])
    cost = counts * np.array([math.log2(2 + len(s)) for _, s in samples])
    best = np.argmin(cost, axis=1)
    for i, b in zip(at, best):
        lang[i] = samples[b][0]
    if len(samples) > 1:
        two = np.sort(cost, axis=1)[:, :2]
        score[at] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    else:
        score[at] = 1.0
    return lang, score


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, doc_chars: int = DOC_CHARS,
        sample_symbols: int = SAMPLE_SYMBOLS, max_languages: int = MAX_LANGUAGES) -> tuple[tuple[str, bytes], ...]:
    """(language, sample) pairs: at most max_languages * sample_symbols bytes on the driver."""
    learn = docs.filter((_remainder(docs["doc_id"]) != 2) & docs["lang"].isNotNull() & docs["text"].isNotNull())
    learn = learn.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("order"), "text")
    sizes = learn.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return ()
    # Thin out by hash first, to about four times the sample: no window ever sees all of a language.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 4 * docs_per_language / r["count"]))])
    thin = learn.filter((F.shiftrightunsigned("order", 11) / float(1 << 53)) < share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("order", "doc_id", F.xxhash64("text"))
    rows = (thin.select("lang", "order", "doc_id", F.substring("text", 1, doc_chars).alias("text"))
            .withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= docs_per_language)
            .orderBy("lang", "nth").collect())
    found: dict[str, bytes] = {}
    for r in rows:
        x = np.frombuffer(b" " + letters(r["text"]), np.uint8)
        found[r["lang"]] = (found.get(r["lang"], b"") + x[_single_blanks(x)].tobytes())[:sample_symbols]
    return tuple(sorted(found.items()))


def with_language(docs: DataFrame, samples: tuple[tuple[str, bytes], ...],
                  lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the predicted language and its score."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        lang, score = predict(samples, [None if t is None else str(t) for t in texts])
        return pd.DataFrame({"lang": lang, "score": score})

    found = docs.withColumn("__terramark_guess", guess(docs["text"].cast("string")))
    return found.withColumn(lang_col, F.col("__terramark_guess.lang")).withColumn(score_col, F.col("__terramark_guess.score")).drop("__terramark_guess")


def identified(docs: DataFrame) -> DataFrame:
    """`docs` without those whose language can't be told; `lang` holds the prediction."""
    found = with_language(docs, fit(docs), "__terramark_lang", "__terramark_score").filter("__terramark_lang != 'und'")
    return found.withColumn("lang", F.col("__terramark_lang")).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False))
    texts = docs.select("doc_id", held.alias("held_out"), "text")
    return with_language(texts, fit(docs)).drop("text")
