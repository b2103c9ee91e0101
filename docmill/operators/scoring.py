"""How well answers and citations are grounded in each other and in their chunks.

The score of two texts is their best window similarity: the shorter text is compared with windows
of its length in the longer one, and similarity is 100 * (1 - d / (n + m)) with d the number of
insertions and deletions; a text that is contained scores 100, an empty one 0. Definition and
invariants are ours: 0 <= score <= 100, containment <=> 100, symmetric in its arguments.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("answer_citation_score", "chunk_citation_score", "citation_score")])


#: Windows that are compared together.
LANES = 1 << 16


def _masks(short: str, long: str, words: int) -> np.ndarray:
    """For each character of ``long``, the places at which ``short`` has it, as bits of 64-bit words."""
    places: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    known = np.zeros((len(places) + 1, words), np.uint64)
    number = {}
    for k, (c, bits) in enumerate(places.items(), 1):
        number[c] = k
        known[k] = np.frombuffer(bits.to_bytes(8 * words, "little"), np.uint64)
    return known[[number.get(c, 0) for c in long]]


def best_windows(pairs: list[tuple[str, str]]) -> list[int]:
    """For each pair of a short and a long text, the longest common subsequence of the short one with any window of its length.

    The bit-parallel recurrence runs over all windows of all pairs at once, a lane each, a character
    of the window a step; pairs whose short texts need equally many 64-bit words go together.
    """
    out = [0] * len(pairs)
    by_words: dict[int, list[int]] = {}
    for k, (short, _) in enumerate(pairs):
        by_words.setdefault(-(-len(short) // 64), []).append(k)
    for words, own in by_words.items():
        own.sort(key=lambda k: -len(pairs[k][0]))
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for k in own:
            short, long = pairs[k]
            masks, windows = _masks(short, long, words), len(long) - len(short) + 1
            for start in range(0, windows, LANES):
                part = masks[start : min(start + LANES, windows) + len(short) - 1]
                waiting.append((k, part))
                held += len(part) - len(short) + 1
                if held >= LANES:
                    _run(pairs, waiting, words, out)
                    waiting, held = [], 0
        if waiting:
            _run(pairs, waiting, words, out)
    return out


def _run(pairs: list[tuple[str, str]], parts: list[tuple[int, np.ndarray]], words: int, out: list[int]) -> None:
    """The recurrence over the windows of ``parts``, sorted by falling length of their short texts."""
    sizes = np.array([len(pairs[k][0]) for k, _ in parts])
    lanes = np.array([len(m) for _, m in parts]) - sizes + 1
    ends = np.cumsum(lanes)
    masks = np.concatenate([m for _, m in parts]).T.copy()
    base = np.concatenate([[0], np.cumsum([len(m) for _, m in parts])[:-1]])
    at = np.arange(ends[-1]) + np.repeat(base - (ends - lanes), lanes)
    free = np.full((words, ends[-1]), ~np.uint64(0))  # a bit per character of the short text that no common subsequence has used
    for step in range(sizes[0]):
        n = ends[np.searchsorted(-sizes, -step, "left") - 1]  # of the lanes whose text is longer than this
        carry = None
        for w in range(words):
            v = free[w, :n]
            used = v & masks[w, at[:n] + step]
            total = v + used
            over = total < used
            if carry is not None:
                total += carry
                over |= (total == 0) & carry
            carry = over
            free[w, :n] = total | (v ^ used)
    left = np.zeros(ends[-1], np.int64)
    for w in range(words):
        bits = np.clip(sizes - 64 * w, 0, 64)
        full = np.array([(1 << int(b)) - 1 for b in bits], np.uint64)
        left += np.bitwise_count(free[w] & np.repeat(full, lanes))
    common = np.maximum.reduceat(np.repeat(sizes, lanes) - left, ends - lanes)
    for (k, _), best in zip(parts, common):
        out[k] = max(out[k], int(best))


def ratios(pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Best window similarity of pairs of texts, 0 to 100, over every window."""
    known, open_ = {}, {}
    for a, b in pairs:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short or short in long:
            known[a, b] = 100 if short else 0
        else:
            open_[a, b] = (short, long)
    best = best_windows(list(open_.values()))
    return known | {pair: min(99, round(100 * n / len(short))) for (pair, (short, _)), n in zip(open_.items(), best)}


def partial_ratio(a: str | None, b: str | None) -> int:
    """Best window similarity of two texts, 0 to 100."""
    return ratios({(a, b)})[a, b] if a and b else 0


def citation_scores(citations, chunks, answer: str | None, alpha: float = 0.7, beta: float = 0.3) -> tuple[float, float, float]:
    """(answer score, chunk score, weighted score) of one row; zeros without citations, or without chunks and answer."""
    return batch_scores([citations], [chunks], [answer], alpha, beta)[0]


def batch_scores(citations: Iterable, chunks: Iterable, answers: Iterable, alpha: float = 0.7, beta: float = 0.3) -> list[tuple[float, float, float]]:
    """:func:`citation_scores` of many rows; each different pair of texts is compared once."""
    rows, wanted = [], set()
    for own, around, said in zip(citations, chunks, answers):
        cited = [c for c in (own if own is not None else []) if c is not None]
        texts = [t for t in (around if around is not None else []) if t]
        if not cited or (not texts and not said):
            rows.append(None)
            continue
        rows.append((cited, texts, said))
        wanted.update((c, t) for c in cited for t in (*texts, *([said] if said else ())))
    ratio = ratios(wanted)
    out = []
    for row in rows:
        if row is None:
            out.append((0.0, 0.0, 0.0))
            continue
        cited, texts, said = row
        by_answer = sum(ratio[c, said] if said else 0 for c in cited) / len(cited)
        by_chunk = sum(max((ratio[c, t] for t in texts), default=0) for c in cited) / len(cited)
        out.append((float(by_answer), float(by_chunk), alpha * by_chunk + beta * by_answer))
    return out


def _check(alpha: float, beta: float) -> None:
    if not (0 <= alpha <= 1 and 0 <= beta <= 1):
        raise ValueError("alpha and beta must lie between 0 and 1")


def scores(citations: Column, chunks: Column, answer: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    """STRUCT of the three scores, by Arrow batches."""
    _check(alpha, beta)

    @F.pandas_udf(SCORES)
    def score(c: pd.Series, t: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(batch_scores(c, t, a, alpha, beta), columns=SCORES.names)

    return score(citations, chunks, answer)


def scored(prepared: DataFrame, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """The evaluation table with its three score columns, replaced if there; no row is dropped."""
    out = prepared.withColumn("_s", scores(F.col("citations"), F.col("chunks"), F.col("ground_truth_answer"), alpha, beta))
    return out.withColumns({n: F.col(f"_s.{n}") for n in SCORES.names}).drop("_s")


def containment(citations: Column, chunks: Column, answer: Column, alpha: float = 0.7, beta: float = 0.3) -> dict[str, Column]:
    """The scores where only containment counts: 100 for a citation contained in a chunk, or in or containing the answer."""
    _check(alpha, beta)
    cited = F.filter(F.coalesce(citations, F.array().cast("array<string>")), lambda c: c.isNotNull())
    texts = F.filter(F.coalesce(chunks, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    said = F.coalesce(answer, F.lit(""))
    either = lambda x, y: (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    share = lambda hit: F.aggregate(F.transform(cited, lambda c: F.when(hit(c), 100.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.size(cited)
    nothing = (F.size(cited) == 0) | ((F.size(texts) == 0) & (said == ""))
    by_answer = F.when(nothing, 0.0).otherwise(share(lambda c: either(c, said)))
    by_chunk = F.when(nothing, 0.0).otherwise(share(lambda c: F.exists(texts, lambda t: either(c, t))))
    return {"answer_citation_score": by_answer, "chunk_citation_score": by_chunk, "citation_score": alpha * by_chunk + beta * by_answer}


def grounded(prepared: DataFrame, least: float) -> DataFrame:
    """Rows whose citation score reaches ``least``."""
    return prepared.where(F.col("citation_score") >= least)
