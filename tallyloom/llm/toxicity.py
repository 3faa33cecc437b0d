"""Toxicity by a classifier chain of linear models.

The labels know toxic and not; the categories before that come from the data. Words that toxic training texts have
clearly more often fall into groups by the texts that they share, and a toxic text is of every category of which it has a
word. Categories are predicted in a fixed order, the label itself last. Each has a logistic model over the words and word
beginnings of a text and over the probabilities of all categories before it. In training those are out-of-fold
predictions, so a later model sees earlier ones as unsure as they will be on new texts.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import row_columns, text_of, with_row

#: Labelled rows that the chain learns from, taken by a hash of their id.
TRAIN_ROWS = 3000
#: Bytes of their texts at most.
TRAIN_BYTES = 64 << 20
FOLDS = 5
#: Texts that have a feature at least, and deviations that it is more frequent by in the class.
LEAST_TEXTS, LEAST_DEVIATION = 3, 3.0
#: Categories before the label itself.
KINDS = 3
RIDGE = 0.5
RARER = 4.0
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.5
LABEL = "toxic"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Words and their beginnings, the latter marked by a star."""
    words = set(words)
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}


@dataclass
class Chain:
    """For each category: the weights of its features, of earlier categories' probabilities, and the intercept."""

    categories: tuple[str, ...]
    weights: list[dict[str, float]] = field(default_factory=list)
    earlier: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def predict(self, features: set[str]) -> list[float]:
        out: list[float] = []
        for w, before, b in zip(self.weights, self.earlier, self.intercepts):
            z = b + sum(w[f] for f in sorted(features & w.keys())) + sum(a * p for a, p in zip(before, out))
            out.append(float(_logistic(z)))
        return out


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _select(present: list[np.ndarray], y: np.ndarray, rows: np.ndarray, many: int) -> np.ndarray:
    """Numbers of the features that are clearly more frequent in the class than out of it, among ``rows``.

    Only what speaks for a category counts, so a text with no such word, an empty one too, is left alone.
    """
    ones, zeros = rows[y[rows] == 1], rows[y[rows] == 0]
    if not len(ones) or not len(zeros):
        return np.empty(0, np.int64)
    in_ones = np.bincount(np.concatenate([present[i] for i in ones]), minlength=many)
    in_zeros = np.bincount(np.concatenate([present[i] for i in zeros]), minlength=many)
    share = (in_ones + in_zeros) / len(rows)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / len(ones) + 1 / len(zeros)))
    deviation = (in_ones / len(ones) - in_zeros / len(zeros)) / spread
    return np.flatnonzero((deviation >= LEAST_DEVIATION) & (in_ones + in_zeros >= LEAST_TEXTS))


def kinds_of(present: list[np.ndarray], toxic: np.ndarray, names: list[str], kinds: int = KINDS, known: np.ndarray | None = None) -> tuple[np.ndarray, list[frozenset[int]]]:
    """Labels (rows, kinds) of categories that the ``known`` rows themselves suggest, the most frequent first, and their words.

    The clearly toxic words are grouped by the cosine of the toxic texts that they occur in: the first centre is the most
    frequent word, each next one the word that is least like the centres so far. Rows that are not known have no part in it and no label.
    """
    known = np.arange(len(toxic)) if known is None else known
    out = np.zeros((len(toxic), kinds), np.int64)
    words = np.array([i for i in _select(present, toxic, known, len(names)) if not names[i].endswith("*")], np.int64)
    rows = known[toxic[known] == 1]
    if not len(words):
        return out, [frozenset()] * kinds
    has = np.zeros((len(words), len(rows)))
    for k, i in enumerate(rows):
        has[np.isin(words, present[i]), k] = 1
    unit = has / np.sqrt(np.maximum(has.sum(axis=1, keepdims=True), 1))
    centres = [int(has.sum(axis=1).argmax())]
    while len(centres) < min(kinds, len(words)):
        alike = (unit @ unit[centres].T).max(axis=1)
        alike[centres] = np.inf
        centres.append(int(alike.argmin()))
    means = unit[centres]
    for _ in range(20):
        group = (unit @ means.T).argmax(axis=1)
        sums = np.stack([unit[group == g].sum(axis=0) if (group == g).any() else means[g] for g in range(len(means))])
        means = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    found = np.stack([has[group == g].any(axis=0) if (group == g).any() else np.zeros(len(rows), bool) for g in range(len(means))], axis=1)
    order = np.argsort(-found.sum(axis=0), kind="stable")
    out[rows, : found.shape[1]] = found[:, order]
    groups = [frozenset(words[group == g].tolist()) for g in order]
    return out, groups + [frozenset()] * (kinds - len(groups))


def _aligned(labels: np.ndarray, groups: list[frozenset[int]], like: list[frozenset[int]]) -> np.ndarray:
    """The columns of ``labels`` in the order of the groups that theirs are most ``like``: only names are settled so."""
    free, place = list(range(len(groups))), {}
    pairs = sorted(((-len(a & b) / max(1, len(a | b)), i, j) for i, a in enumerate(like) for j, b in enumerate(groups)))
    for _, i, j in pairs:
        if i not in place and j in free:
            place[i] = j
            free.remove(j)
    return labels[:, [place[i] for i in range(len(like))]]


@dataclass
class _Design:
    """Presence of chosen features (a one at each ``owner``, ``column``), and dense columns: earlier probabilities and a constant."""

    owner: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    features: int

    @classmethod
    def of(cls, present: list[np.ndarray], rows: np.ndarray, chosen: np.ndarray, earlier: np.ndarray, many: int) -> _Design:
        place = np.full(many, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        column = place[np.concatenate([*(present[i] for i in rows), np.empty(0, np.int64)]).astype(np.int64)]
        owner = np.repeat(np.arange(len(rows)), [len(present[i]) for i in rows])
        kept = column >= 0
        return cls(owner[kept], column[kept], np.column_stack([earlier[rows], np.ones(len(rows))]), len(chosen))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.column], len(self.dense)) + self.dense @ w[self.features :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, r[self.owner], self.features), self.dense.T @ r])


def _fit(x: _Design, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients; the constant is hardly shrunk.

    The rarer class weighs ``RARER`` times as much as it would by its number, up to as much as the other.
    """
    ones = max(1, int(y.sum()))
    weight = np.where(y == 1, min(RARER, max(1.0, (len(y) - ones) / ones)), 1.0)
    shrink = np.full(x.features + x.dense.shape[1], RIDGE)
    shrink[-1] = 1e-3
    w = np.zeros(len(shrink))
    for _ in range(25):
        p = _logistic(x.times(w))
        curve = weight * p * (1 - p) + 1e-9
        rest = x.back(weight * (p - y)) + shrink * w
        move, way = np.zeros_like(w), rest.copy()
        size = first = rest @ rest
        for _ in range(200):
            if size <= 1e-16 * max(first, 1e-12):
                break
            bent = x.back(curve * x.times(way)) + shrink * way
            step = size / (way @ bent)
            move += step * way
            rest -= step * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _encoded(rows: Iterable[tuple[int, Iterable[str], int]]) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray]:
    """Names of the features that enough rows have, their numbers in each row, and the rows' folds and labels.

    Rows are taken one at a time and kept as numbers: the words of two rows are never held at once, nor a feature twice.
    """
    number: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    present, folds, labels = [], [], []
    for fold, words, label in rows:
        own: set[int] = set()
        for word in words:
            if word not in of_word:
                of_word[word] = [number.setdefault(f, len(number)) for f in sorted(features_of((word,)))]
            own.update(of_word[word])
        present.append(np.fromiter(own, np.int32, len(own)))
        folds.append(fold)
        labels.append(label)
    counts = np.bincount(np.concatenate([*present, np.empty(0, np.int32)]), minlength=len(number))
    names = sorted(f for f, i in number.items() if counts[i] >= LEAST_TEXTS)
    place = np.full(len(number), -1, np.int64)
    place[[number[f] for f in names]] = np.arange(len(names))
    present = [np.sort(at[at >= 0]) for at in (place[ids] for ids in present)]
    return names, present, np.array(folds, np.int64), np.array(labels, np.int64)


def train(rows: Iterable[tuple[int, Iterable[str], int]], kinds: int = KINDS, folds: int = FOLDS) -> Chain:
    """A chain from (fold number, words, label) of each row. Without rows every category is unlikely."""
    names, present, fold, toxic = _encoded(rows)
    chain = Chain((*(f"kind_{k + 1}" for k in range(kinds)), LABEL))
    if not len(toxic):
        chain.weights, chain.earlier, chain.intercepts = [{} for _ in chain.categories], [[] for _ in chain.categories], [-1.0 for _ in chain.categories]
        return chain
    fold %= folds
    every = np.arange(len(toxic))
    labels, groups = kinds_of(present, toxic, names, kinds)
    seen = [np.flatnonzero(fold != k) for k in range(folds)]
    # A fold's own models learn categories that its rows had no part in.
    apart = [np.column_stack([_aligned(*kinds_of(present, toxic, names, kinds, known), groups), toxic]) for known in seen]
    earlier = np.zeros((len(toxic), 0))
    for j, y in enumerate(np.column_stack([labels, toxic]).T):
        unseen = np.zeros(len(toxic))
        speaks = lambda y, rows: np.intersect1d(_select(present, y, rows, len(names)), _select(present, toxic, rows, len(names)))
        for k, known in enumerate(seen):
            rest, target = np.flatnonzero(fold == k), apart[k][:, j]
            if len(known) and len(rest):
                unseen[rest] = _unseen(present, target, known, rest, speaks(target, known), earlier, len(names))
        chosen = speaks(y, every)
        w = _fit(_Design.of(present, every, chosen, earlier, len(names)), y)
        chain.weights.append({names[i]: float(v) for i, v in zip(chosen, w)})
        chain.earlier.append(w[len(chosen) : -1].tolist())
        chain.intercepts.append(float(w[-1]))
        earlier = np.column_stack([earlier, unseen])
    return chain


def _unseen(present: list[np.ndarray], y: np.ndarray, seen: np.ndarray, rest: np.ndarray, chosen: np.ndarray, earlier: np.ndarray, many: int) -> np.ndarray:
    """Probabilities of ``rest`` by a model that knows ``seen`` alone, as must those who chose its features."""
    w = _fit(_Design.of(present, seen, chosen, earlier, many), y[seen])
    return _logistic(_Design.of(present, rest, chosen, earlier, many).times(w))


def _alone(chain: Chain) -> Chain:
    """``chain`` with features of its own: those it was learned with lie among all others and would keep their memory."""
    chain.weights = [{f.encode().decode(): v for f, v in w.items()} for w in chain.weights]
    return chain


def _give_back() -> None:
    """Hand what was freed back to the system, where the C library can: the driver goes on for long after a fit."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Chain:
    """A chain for ``labels.toxic`` from at most ``rows`` labelled documents of at most ``most_bytes`` bytes in all.

    The sample is the first by a hash of the id, and ends before the first text that does not fit; only its distinct words come to the driver.
    Its ids are bounded, so they are broadcast to the documents. Of rows that share an id one text counts, the one whose words sort first.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    sample = known.select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(sorted(words_of(t))) for t in texts], dtype=object)

    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    sizes = texts.groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("n"), F.first(F.xxhash64("doc_id")).alias("h")).collect()
    fits, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"], r["toxic"])):
        held += r["n"]
        if held > most_bytes:
            break
        fits.append((r["doc_id"], r["toxic"]))
    if not fits:
        return train([])
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(docs.sparkSession.createDataFrame(fits, sample.schema)), "doc_id")
    found = chosen.select("doc_id", "toxic", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("fold"), words("text").alias("words")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["words"]), reverse=True)
    once = {r["doc_id"]: r for r in found}
    del found
    chain = _alone(train((r["fold"], r["words"].split(), int(r["toxic"])) for _, r in sorted(once.items())))
    del once
    _give_back()
    return chain


def _with_probabilities(rows: DataFrame, chain: Chain) -> DataFrame:
    """``rows`` (with ``full_text``) and an array ``p`` of every category's probability."""
    shared = rows.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def probabilities(texts: pd.Series) -> pd.Series:
        model = shared.value
        useful = frozenset().union(*[w.keys() for w in model.weights])
        known: dict[str, tuple[str, ...]] = {}

        def of(text: str) -> list[float]:
            features: set[str] = set()
            for word in words_of(text):
                own = known.get(word)
                if own is None:
                    own = tuple(features_of((word,)) & useful)
                    if len(known) < 200_000:
                        known[word] = own
                features.update(own)
            return model.predict(features)

        return pd.Series([of(t) for t in texts])

    return rows.withColumn("p", probabilities("full_text"))


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, ``p_`` and the name of every category, ``score`` (the last category's) and ``toxic`` for every row.

    ``toxic`` is 1 from a score of a half. A null text counts as empty; repeated rows each give one; a null ``doc_id`` is kept;
    an empty table gives an empty result. Texts are read whole.
    """
    scored = _with_probabilities(docs.select("doc_id", text_of().alias("full_text")), chain)
    each = [F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)]
    last = F.col("p")[len(chain.categories) - 1]
    return scored.select("doc_id", *each, last.alias("score"), (last >= THRESHOLD).cast("int").alias("toxic"))


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the documents whose last category has a probability of a half or more.

    A null text counts as empty and stays, repeated rows stay or go together, and an empty table gives an empty one.
    """
    scored = _with_probabilities(with_row(docs, text_of().alias("full_text")), chain)
    kept = scored.where(F.col("p")[len(chain.categories) - 1] < THRESHOLD)
    return kept.select(*row_columns(kept))
