"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much are rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = ("all rights reserved", "licensed under", "released under", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "powered by", "click here", "subscribe to our", "sign up for", "share on", "copyright ©", "permission is hereby granted", "spdx-license-identifier")
#: Words of navigation lines, lower case.
NAVIGATION = ("home", "menu", "login", "log in", "sign in", "register", "search", "next", "previous", "back", "contact", "about", "about us", "sitemap", "read more", "archive", "faq", "help")


@dataclass(frozen=True)
class LineRules:
    """Parameters of the rules.

    terminal: a line of at least ``punctuated_from`` words that doesn't end in one of these fails (titles and items are
    shorter; the last line of a text may be cut and is spared). separators: more than ``most_separators`` of the words
    being one of them makes a navigation line, as does a line of any length that is navigation entries and nothing
    else. symbols: more than ``most_symbols`` of the characters. shouting: more than ``most_upper`` of the
    cased letters upper case in a line of ``upper_from`` of them or more; scripts without case can't shout. most_lost: share of word characters that a document
    may lose.
    """

    terminal: str = ".!?…:;\"'”’»)]。！？」』؟۔।॥"
    punctuated_from: int = 5
    separators: tuple[str, ...] = ("|", "»", "›", "•", "·", ">", "/", "»»")
    most_separators: float = 0.2
    most_symbols: float = 0.15
    most_upper: float = 0.7
    upper_from: int = 20
    boilerplate: tuple[str, ...] = BOILERPLATE
    navigation: tuple[str, ...] = NAVIGATION
    most_lost: float = 0.5
    pattern: re.Pattern = field(init=False, compare=False)
    menu: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "pattern", re.compile("|".join(map(re.escape, self.boilerplate)) or r"(?!)"))
        entry = "|".join(map(re.escape, sorted(self.navigation, key=len, reverse=True))) or r"(?!)"
        object.__setattr__(self, "menu", re.compile(rf"[\W_]*(?:{entry})(?:[\W_]+(?:{entry}))*[\W_]*"))

    def failed(self, line: str, last: bool) -> str:
        """Name of the rule that the line fails, or an empty string."""
        words = line.split()
        if not words:
            return ""
        if sum(w in self.separators for w in words) > self.most_separators * len(words):
            return "navigation"
        low = line.lower()
        if self.menu.fullmatch(low):
            return "navigation"
        if self.pattern.search(low):
            return "boilerplate"
        if sum(line.count(c) for c in SYMBOLS) > self.most_symbols * len(line):
            return "symbols"
        upper = sum(map(str.isupper, line)) if low != line else 0
        if upper > self.most_upper * self.upper_from:
            cased = upper + sum(map(str.islower, line))
            if cased >= self.upper_from and upper > self.most_upper * cased:
                return "shouting"
        if len(words) >= self.punctuated_from and not last and words[-1][-1] not in self.terminal:
            return "punctuation"
        return ""


def _measures(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The whole-text counts of a slice, without per-word Python."""
    buf, at = T.raw(part.column("text"))
    words = T.Words(buf, at)
    space, n = T._SPACE[buf], np.diff(words.doc)
    chars = T.per_doc(~space & ((buf & 0xC0) != 0x80), at)
    symbols = T.per_doc(np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8)), at)

    # words in windows of 8 that occur twice or more in their text
    h, doc = words.hashes(), T.doc_of(words.doc)
    repeated = np.zeros(len(part), np.int64)
    if len(h) >= 8:
        starts = np.flatnonzero(doc[: len(h) - 7] == doc[7:])
        keys = T.mix(T.rolling(h, 8)[starts] ^ T.mix(doc[starts].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        edge = np.zeros(len(h) + 1, np.int32)
        hit = starts[order[same]]
        edge[hit] += 1
        np.subtract.at(edge, hit + 8, 1) if len(hit) else None
        repeated = T.per_doc(np.cumsum(edge[:-1]) > 0, words.doc)

    # lines with a word that equal an earlier line of the text
    breaks = np.flatnonzero(buf == 0x0A)
    cuts = np.unique(np.concatenate([at, breaks + 1]))
    duplicate = np.zeros(len(part), np.int64)
    if len(cuts) > 1 and len(words):
        has = np.searchsorted(words.start, cuts[1:]) > np.searchsorted(words.start, cuts[:-1])
        of = np.searchsorted(at, cuts[:-1], "right") - 1
        body = buf[buf != 0x0A]
        gone = np.concatenate([[0], np.cumsum(buf == 0x0A)])
        code = T.pieces(body, cuts - gone[cuts]).dictionary_encode().indices.to_numpy().astype(np.int64)
        of, code = of[has], code[has]
        distinct = np.unique(of * (code.max() + 1) + code) if len(code) else np.zeros(0, np.int64)
        duplicate = np.bincount(of, minlength=len(part)) - np.bincount(distinct // (code.max() + 1), minlength=len(part)) if len(code) else duplicate
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicate, "n_repeat_words": repeated}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Clean every text of ``docs`` (doc_id, text) line by line.

    Returns doc_id, text (the lines that passed, joined by newlines), n_lines, n_lines_removed, removed (rule names,
    in line order), kept_chars (characters in words of the lines that passed), the counts of the whole text,
    base_failed (under 20 words, or over 30 % of the words in repeated windows) and kept. A null text is an empty one:
    it has no words, so it fails. Rows stay one to one: repeated rows and null ids come back as they are. One task
    holds one slice of texts at a time.
    """
    schema = "doc_id long, text string, n_lines long, n_lines_removed long, removed array<string>, kept_chars long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"

    emit = T.emitter(schema)

    def run(batches):
        for part in T.slices(batches):
            counts = _measures(part)
            out: dict[str, list] = {k: [] for k in ("text", "n_lines", "n_lines_removed", "removed", "kept_chars")}
            for text in part.column("text").to_pylist():
                lines = text.split("\n")
                verdicts = [rules.failed(line, i == len(lines) - 1) for i, line in enumerate(lines)]
                kept = [line for line, v in zip(lines, verdicts) if not v]
                out["text"].append("\n".join(kept))
                out["n_lines"].append(len(lines))
                out["removed"].append([v for v in verdicts if v])
                out["n_lines_removed"].append(len(out["removed"][-1]))
            kept_buf, kept_at = T.raw(pa.array(out["text"], pa.large_string()))
            out["kept_chars"] = T.per_doc(~T._SPACE[kept_buf] & ((kept_buf & 0xC0) != 0x80), kept_at)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            lost = counts["word_chars"] - out["kept_chars"] > rules.most_lost * counts["word_chars"]
            yield emit({"doc_id": part.column("doc_id")} | out | counts | {"base_failed": failed, "kept": ~failed & ~lost})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
