"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Look-alikes of Latin letters (Cyrillic, then Greek) and digits or signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum of the pond")


class _Fold(dict):
    """For str.translate, filled as characters come: look-alikes, substitutes and full-width forms to Latin, other signs to a space."""

    def __missing__(self, code: int):
        c = chr(code - 0xFEE0) if 0xFF01 <= code <= 0xFF5E else chr(code)
        c = c.lower()
        c = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c))
        self[code] = c if c.isalpha() else "" if code in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF) else " "
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words, each with a space before and after."""
    return f" {text.translate(_FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """weights: of word beginnings (each starts with a space; it ends with one if only the whole word counts).
    bias, slope: of the logistic over the log of the weight for every 100 words."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def _density(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Weight for every 100 words: of the terms that begin a word the weightiest counts; matches inside an exception don't."""
    if not len(automaton):
        return 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(folded):
        start = end - n + 1
        if weight is None:
            spared.append((start, end))
        else:
            best[start] = max(best.get(start, 0.0), weight)
    total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))
    return 100 * total / max(20, folded.count(" ") - 1) if total else 0.0


def _prefixes(folded: str, least: int, most: int) -> set[str]:
    out: set[str] = set()
    for word in set(folded.split()):
        out.update(f" {word[:k]}" for k in range(least, min(most, len(word) - 1) + 1))
        out.add(f" {word} ")
    return out


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, least_df: float = 0.01, least_weight: float = 2.5, lengths: tuple[int, int] = (4, 8), exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn the lexicon from labelled rows, at most ``most_rows`` of each label, the first by hash of doc_id.

    Terms are words and word beginnings of ``lengths`` letters that stand in ``least_df`` of the toxic texts at least,
    so there are at most 1 / ``least_df`` times as many as a toxic text has on average; their weight is the log-odds of standing in a toxic text, and terms under
    ``least_weight`` or no better than a shorter beginning go. The logistic is fitted on the same rows. Rows with a
    null id, label or text are left out; with no toxic rows the lexicon is empty and the score low everywhere.
    """
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    ids = [known.where(F.col("toxic") == v).orderBy(rank, "doc_id").limit(most_rows) for v in (1, 0)]
    # 2 * most_rows ids at most
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text is not null").join(F.broadcast(ids[0].union(ids[1])), "doc_id")

    count, point = T.emitter("term string, n long"), T.emitter("x double, toxic int")

    def candidates(batches):
        df: Counter = Counter()
        for part in T.slices(batches):
            for t in part.column("text").to_pylist():
                df.update(_prefixes(fold(t), *lengths))
        yield count({"term": list(df), "n": list(df.values())})

    toxic = texts.where("toxic = 1")
    n_toxic = int(known.where("toxic = 1").limit(most_rows).count())
    often = toxic.select("text").mapInArrow(candidates, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, least_df * n_toxic))
    found = {r.term: r.n for r in often.collect()}
    if not found:
        return Lexicon({}, exceptions)

    def clean_df(batches):
        df, n = Counter(), 0
        for part in T.slices(batches):
            for t in part.column("text").to_pylist():
                df.update(found.keys() & _prefixes(fold(t), *lengths))
                n += 1
        yield count({"term": ["", *df], "n": [n, *df.values()]})

    clean = {r.term: r.n for r in texts.where("toxic = 0").select("text").mapInArrow(clean_df, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_clean = clean.pop("", 0)
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in found.items()}
    weights: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        shorter = max((weights[term[:k]] for k in range(2, len(term)) if term[:k] in weights), default=-1.0)
        if odds[term] >= least_weight and odds[term] > shorter + 1.0:
            weights[term] = round(odds[term], 4)
    draft = Lexicon(weights, exceptions)

    def density(batches):
        automaton = draft.automaton()
        for part in T.slices(batches):
            x = [_density(fold(t), automaton) for t in part.column("text").to_pylist()]
            yield point({"x": x, "toxic": part.column("toxic")})

    sample = texts.select("text", "toxic").mapInArrow(density, "x double, toxic int").toPandas()
    return Lexicon(weights, exceptions, *_logistic(np.log1p(sample.x.to_numpy()), sample.toxic.to_numpy()))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope by Newton steps with a small ridge."""
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) and density (weight for every 100 words) of every whole text of ``docs`` (doc_id, text); a null text is an empty one.

    Rows stay one to one, nothing but the text decides.
    """

    emit = T.emitter("doc_id long, score double, density double")

    def run(batches):
        automaton = lexicon.automaton()
        for part in T.slices(batches):
            x = np.log1p([_density(fold(t), automaton) for t in part.column("text").to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * x, -30, 30)))
            yield emit({"doc_id": part.column("doc_id"), "score": s, "density": np.expm1(x)})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, density double")


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
