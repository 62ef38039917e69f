"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digit or sign substitutions inside words to letters.
The lexicon has whole words and word beginnings (written with a final *). It starts from seeds; further
entries and all weights are learned from labelled rows: weights are smoothed log odds. A match inside an
exception phrase doesn't count. The sum of weights, as such and for each hundred words, gives the score by a logistic fit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, by_text, in_one_task, sample_texts

# Letters that look like Latin ones, and signs that stand for letters inside words.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝвкмнтґαεορτυνικχηωßł", "aeopcyxijsdhqwbkmhtraeoptuvikxnwbl", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
SEEDS = ("idiot*", "stupid*", "moron*", "loser*", "trash", "scum*", "pathetic", "disgusting", "worthless", "clown", "imbecile*", "jerk", "bastard*", "dumbass*", "scumbag*")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid question", "sore loser bracket")

#: Labelled rows the lexicon is learned from, at most.
SAMPLE_ROWS = 4_000
#: An entry's rate among other rows, at most this share of its rate among toxic rows.
IMPURE = 0.2
#: What a row that isn't toxic takes from an entry's worth, in toxic rows (both as rates).
PENALTY = 4.0
#: Word beginnings tried as entries, in letters.
SHORTEST, LONGEST = 4, 10

_glyphs = str.maketrans(HOMOGLYPHS)
_signs = str.maketrans(SUBSTITUTES)
_run = re.compile(r"[\w@$!]+")
_sign = re.compile(r"[0-9@$!]")
_words = re.compile(r"[^\W_]+").findall
_count = re.compile(WORD).findall


def _letters_for_signs(m: re.Match) -> str:
    """A run of word characters and signs with its substitutions undone, if it has a letter; signs at its end stay."""
    run = m[0]
    body = run.rstrip("@$!")
    if not any(c.isalpha() for c in body) or not _sign.search(body):
        return run
    return body.translate(_signs) + run[len(body) :]


def fold(text: str) -> str:
    """Lower case, Latin look-alikes and substituted letters, in one pass; a word's length stays the same for nearly all texts."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_glyphs)
    return _run.sub(_letters_for_signs, text) if _sign.search(text) else text


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: bias, by log(1 + weight), by weight for each hundred words, by whether anything matched
    fit: tuple[float, float, float, float] = (-4.0, 2.0, 0.2, 2.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "fit": self.fit, "_machine": None}

    def machine(self):
        """One automaton for entries and exception phrases."""
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                self._machine.add_word(entry.rstrip("*"), (len(entry.rstrip("*")), entry.endswith("*"), w))
            for phrase in self.exceptions:
                if phrase not in self._machine:
                    self._machine.add_word(phrase, (len(phrase), False, None))
            self._machine.make_automaton()
        return self._machine

    def weight(self, text: str) -> tuple[float, int]:
        """Sum of the weights of all matches that stand outside exception phrases, and their number."""
        folded = fold(text)
        hits, spared, n = [], [], len(folded)
        for last, (size, open_, w) in self.machine().iter(folded):
            first = last - size + 1
            if first and folded[first - 1].isalnum() or not open_ and last + 1 < n and folded[last + 1].isalnum():
                continue
            (spared if w is None else hits).append((first, last, w))
        if spared:
            # Exception phrases in order of their beginnings, each kept only if it ends later than all before; so
            # of those that begin at or before a hit the last one kept reaches furthest.
            starts, ends = [], []
            for a, z, _ in sorted(spared):
                if not ends or z > ends[-1]:
                    starts.append(a)
                    ends.append(z)
            at = [bisect_right(starts, h[0]) - 1 for h in hits]
            hits = [h for h, i in zip(hits, at, strict=True) if i < 0 or ends[i] < h[1]]
        best: dict[int, float] = {}  # of entries that begin at one place the heaviest counts
        for first, _, w in hits:
            best[first] = max(w, best.get(first, 0.0))
        return sum(best.values()), len(best)

    def inputs(self, text: str) -> list[float]:
        w, n = self.weight(text) if text else (0.0, 0)
        return [1.0, math.log1p(w), min(5.0, 100 * w / max(20, len(_count(text)))) if n else 0.0, float(n > 0)]

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.fit, self.inputs(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn(texts: list[str], toxic: list[int], seeds: tuple[str, ...] = SEEDS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Entries and weights from labelled texts.

    Candidates are words and word beginnings. Those found in toxic rows nearly only are taken greedily, the one that
    explains most toxic rows not yet explained, less a penalty for other rows, first, and of beginnings with the same rows the longest.
    """
    n_toxic, n_rest = sum(toxic), len(toxic) - sum(toxic)
    one: dict[str, str] = {}  # each word is held once, however many rows have it
    words = [{one.setdefault(w, w) for w in _words(fold(text or ""))} for text in texts]
    least = max(2, n_toxic // 500)
    # Entries by length: a beginning is counted only if the one a letter shorter was frequent in toxic rows.
    in_toxic: Counter = Counter()
    for k in range(SHORTEST, LONGEST + 2):
        own: Counter = Counter()
        for found, y in zip(words, toxic, strict=True):
            if y:
                own.update({w[:k] if k <= LONGEST else w + "$" for w in found if k == SHORTEST <= len(w) or len(w) >= min(k, SHORTEST) and in_toxic[w[: min(k - 1, len(w), LONGEST)]] and (k > LONGEST or len(w) >= k)})
        in_toxic.update({c: n for c, n in own.items() if n >= least})
    in_rest: Counter = Counter()
    rows = []
    for found, y in zip(words, toxic, strict=True):
        entries = {e for w in found for e in (w + "$", *(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))) if e in in_toxic}
        if y:
            rows.append(entries)
        else:
            in_rest.update(entries)
    # A candidate's rate among other rows must be far below its rate among toxic ones.
    clean = {c for c, n in in_toxic.items() if (in_rest[c] + 0.5) * max(1, n_toxic) <= IMPURE * n * max(1, n_rest)}
    holders: dict[str, set[int]] = {c: set() for c in clean}
    for i, entries in enumerate(rows):
        for c in entries & clean:
            holders[c].add(i)
    weights: dict[str, float] = {}
    size = {c: len(h) for c, h in holders.items()}
    cost = {c: PENALTY * in_rest[c] * n_toxic / max(1, n_rest) for c in clean}
    open_rows = set(range(len(rows)))
    while holders:
        c = max(holders, key=lambda c: (size[c] - cost[c], len(c), c))
        own = holders.pop(c) & open_rows
        if len(own) < size[c]:  # an older count: put back what is left
            if len(own) >= least and len(own) > cost[c]:
                holders[c], size[c] = own, len(own)
            continue
        if len(own) < least or len(own) <= cost[c]:
            continue
        open_rows -= own
        weights[c[:-1] if c.endswith("$") else c + "*"] = math.log((in_toxic[c] + 0.5) / (n_toxic + 1)) - math.log((in_rest[c] + 0.5) / (n_rest + 1)) if n_rest else 1.0
    for seed in seeds:
        key = seed.rstrip("*") if seed.endswith("*") else seed + "$"
        a, b = in_toxic[key], in_rest[key]
        w = math.log((a + 2) / (n_toxic + 4)) - math.log((b + 0.5) / (n_rest + 4)) if a + b else 3.0
        if w > 0 and seed not in weights:
            weights[seed] = w
    lexicon = Lexicon({c: min(8.0, max(0.5, w)) for c, w in weights.items()}, exceptions)
    if n_toxic and n_rest:
        lexicon.fit = tuple(_logistic(np.array([lexicon.inputs(t or "") for t in texts]), np.array(toxic, float)))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Ridge-penalised logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - penalty @ b
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, grad)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in b]


def train(docs: DataFrame, labelled: DataFrame, *, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns from at most `rows` labelled rows, half of them toxic if there are as many, in one executor task that the bound makes fit."""
    return in_one_task(sample_texts(docs, labelled, label_col, rows, id_col, text_col), learn, lambda: learn([], []))


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text. Null and empty texts match nothing and get the lowest score."""
    return by_text(docs, lambda t: (lexicon.score(t),), [("score", "double")], id_col, text_col)


def score_column(lexicon: Lexicon, text_col: str = "text") -> Column:
    """The score as a column, so that rows can be filtered where they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def toxicity_score(text: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t or "") for t in text])

    return toxicity_score(F.col(text_col))
