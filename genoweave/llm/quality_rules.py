"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into 2^16 features. Two multinomials over the features are
counted, one over the trusted documents and one over the whole corpus, both smoothed by PRIOR counts dealt out as the corpus
has them. A document's
score is the mean over its n-grams of log p(target) - log p(corpus); so it doesn't grow with length. A
document is kept if its score reaches a fixed threshold: no sampling, so reruns agree.

A word enters as its shape: its letters become a mark for lower case, first upper, upper or mixed case,
digits become 0, other characters stay, and plain words also carry their length in threes. Vocabulary
differs between documents, but markup, symbol and capital-letter junk show in the shapes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, by_text

FEATURES = 1 << 16
#: Counts that the corpus's own shares add to both multinomials.
PRIOR = 1000.0
WINDOW = 8
#: Longer words aren't remembered.
LONG = 64
#: Mean log-likelihood ratio an n-gram from which a document is kept.
THRESHOLD = -0.15
SYMBOLS = "#*$%&|<>"

_word = re.compile(WORD).findall
_letters = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """What a word looks like: abc, Abc and ABC become a, A and AA; digits 0; a repeat of the whole word isn't seen here."""
    if word.isalpha():
        return ("a" if word.islower() else "A" if word[1:].islower() or len(word) == 1 else "B" if word.isupper() else "C") + str(min(12, len(word)) // 3)
    return re.sub(r"\d+", "0", _letters.sub(lambda m: "a" if m[0].islower() else "A" if m[0][1:].islower() or len(m[0]) == 1 else "B" if m[0].isupper() else "C", word))


class Features:
    """Hashes of words and of their shapes, remembered for up to `most` words of no more than LONG characters; so memory is bounded in bytes."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        known = self.known
        try:
            pairs = [known[w] for w in words]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            new = {w: (xxhash.xxh3_64_intdigest(w), xxhash.xxh3_64_intdigest(_shape(w))) for w in set(words) if w not in known}
            pairs = [known.get(w) or new[w] for w in words]
            known.update((w, x) for w, x in new.items() if len(w) <= LONG)
        both = np.array(pairs, "uint64").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def features(shapes: np.ndarray) -> np.ndarray:
    """Feature numbers of all single words and neighbouring pairs."""
    pairs = (shapes[:-1] * _MULTIPLIER) ^ (shapes[1:] >> np.uint64(7))
    both = np.concatenate([shapes, pairs]) * _MULTIPLIER
    return (both >> np.uint64(48)).astype("int64")


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of `window` words that occur twice or more in the text, the first included."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    rolling = np.zeros(n, "uint64")
    for i in range(window):
        rolling = rolling * _MULTIPLIER + h[i : i + n]
    order = np.argsort(rolling, kind="stable")
    s = rolling[order]
    same = np.zeros(n, bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    if not same.any():
        return 0
    edges = np.zeros(len(h) + 1, "int64")
    at = order[same]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_figures(text: str, words: list[str], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


def count_features(docs: DataFrame, trusted: Column, *, text_col: str = "text") -> DataFrame:
    """feature, target, corpus: n-gram counts over the trusted rows and over all. At most FEATURES rows.

    Each task adds up its own rows first, so what is shuffled is bounded by tasks times FEATURES.
    """
    rows = docs.select(F.coalesce(trusted, F.lit(False)).alias("good"), F.col(text_col).alias("t"))

    def count(batches):
        import pandas as pd

        seen, sums = Features(), np.zeros((2, FEATURES), "int64")
        for batch in batches:
            for good, text in zip(batch["good"].tolist(), batch["t"].tolist(), strict=True):
                if text:
                    f = features(seen.hashes(_word(text))[1])
                    np.add.at(sums[1], f, 1)
                    if good:
                        np.add.at(sums[0], f, 1)
        at = np.flatnonzero(sums[1])
        yield pd.DataFrame({"feature": at, "target": sums[0][at], "corpus": sums[1][at]})

    part = rows.mapInPandas(count, "feature long, target long, corpus long")
    return part.groupBy("feature").agg(F.sum("target").alias("target"), F.sum("corpus").alias("corpus"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(target) - log p(corpus) of each feature. Without trusted documents all are 0."""
    both = np.zeros((2, FEATURES))
    for r in counts.toPandas().itertuples():  # FEATURES rows at most
        both[:, r.feature] = r.target, r.corpus
    if not both[0].sum():
        return np.zeros(FEATURES)
    smooth = both + PRIOR * np.maximum(both[1:], 0.1) / max(1.0, both[1].sum())
    p = smooth / smooth.sum(1, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def score(docs: DataFrame, ratios: np.ndarray, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base figures, base_failed, score and kept of every whole text.

    Null or empty text: no words, base_failed, score 0. Repeated rows are each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype("float32"))  # FEATURES numbers
    seen = Features()

    def one(text: str) -> tuple:
        words = _word(text)
        h, shapes = seen.hashes(words)
        base = base_figures(text, words, h)
        llr = float(shared.value[features(shapes)].mean()) if words else 0.0
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        return *base, failed, llr, not failed and llr >= threshold

    return by_text(docs, one, COLUMNS, id_col, text_col)


COLUMNS = [(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")]


def quality_rules(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts both multinomials, the corpus's over all rows, then scores every row.

    trusted: doc_id of the target's documents, a bounded sample (see common.sample_ids), so it is broadcast
    and texts are not shuffled. An empty table gives no rows; without trusted rows every score is 0.
    """
    good = trusted.select(F.col("doc_id").alias("__good")).distinct()
    marked = docs.select(id_col, text_col).join(F.broadcast(good), F.col(id_col) == F.col("__good"), "left")
    ratios = log_ratios(count_features(marked, F.col("__good").isNotNull(), text_col=text_col))
    return score(docs, ratios, threshold=threshold, id_col=id_col, text_col=text_col)
