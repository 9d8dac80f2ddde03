"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the words and word beginnings of a text. Every labelled sentence that names a group is written again
with other groups' names in its place, and so are neutral sentences of a fixed list; changes of the score between a
sentence and its swapped forms are penalised, so that a neutral mention of a group does not raise it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, held_out, map_rows, only, small, stored

#: Names of groups that a swap exchanges; a parameter of fit().
IDENTITY_TERMS = (
    "women", "men", "gay", "lesbian", "straight", "transgender", "muslims", "christians", "jews", "hindus", "atheists",
    "black", "white", "asian", "latino", "immigrants", "refugees", "disabled", "deaf", "blind", "old", "young",
    "frauen", "männer", "muslime", "christen", "juden", "femmes", "hommes", "musulmans", "chrétiens", "juifs",
    "mujeres", "hombres", "musulmanes", "cristianos", "judíos",
)

#: Neutral sentences about each group, so that the penalty holds on any corpus; a parameter of fit().
TEMPLATES = (
    "{} live in this town", "many {} people work here", "she talked with {} neighbours", "the book is about {} families",
    "{} leben hier", "ein buch über {}", "{} habitent ici", "un livre sur les {}", "{} viven aquí", "un libro sobre {}",
)

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}']*")
SENTENCES = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 6)


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def features_of(found: list[str]) -> set[str]:
    """Distinct words, and beginnings of longer words (marked by a trailing *)."""
    distinct = set(found)
    return distinct | {w[:n] + "*" for n in BEGINNINGS for w in distinct if len(w) > n}


def features(text: str | None) -> set[str]:
    return features_of(words(text))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose_features(rows: DataFrame, most: int, at_least: int = 5) -> list[str]:
    """The `most` features with the largest chi-square between presence and label, counted over all of `rows`."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        held = {0: Counter(), 1: Counter()}

        def flush() -> Iterator[dict]:
            for label, counts in held.items():
                if counts:
                    yield {"feature": list(counts), "neg": [n * (1 - label) for n in counts.values()], "pos": [n * label for n in counts.values()]}
                    counts.clear()

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                held[label].update(features(text))
                if len(held[label]) > 400_000:
                    yield from flush()
        yield from flush()

    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return []
    table = map_rows(rows, count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    n, seen = float(n0 + n1), F.col("pos") + F.col("neg")
    gap = F.col("pos") * n - seen * float(n1)
    chi = gap * gap * n / (seen * (n - seen + 0.5) * (float(n0) * n1))
    top = table.filter(seen >= at_least).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(most)
    return sorted(r["feature"] for r in top.collect())


class Model:
    """Weights of features, a bias, and `swaps`: the pairs of a sentence and a swapped form that the fit has used."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, swaps: int = 0):
        self.weight, self.bias, self.swaps = dict(zip(names, map(float, weights))), float(bias), swaps

    def score(self, text: str | None) -> float:
        found = features(text)
        total = self.bias + math.fsum(sorted(self.weight[f] for f in found if f in self.weight))
        return float(sigmoid(total))


class Swapper:
    """Writes sentences again with other terms in place of one."""

    def __init__(self, terms: tuple[str, ...], each: int):
        self.terms = [tuple(words(t)) for t in terms]
        self.first: dict[str, list[int]] = {}
        for k, term in enumerate(self.terms):
            if term:
                self.first.setdefault(term[0], []).append(k)
        self.each = min(each, len(terms) - 1)

    def __call__(self, sentence: list[str]) -> Iterator[list[str]]:
        """`each` swapped forms for every place of a term: the next terms of the list."""
        for i, word in enumerate(sentence):
            for k in self.first.get(word, ()):
                term = self.terms[k]
                if tuple(sentence[i : i + len(term)]) == term:
                    for step in range(1, self.each + 1):
                        other = self.terms[(k + step) % len(self.terms)]
                        yield [*sentence[:i], *other, *sentence[i + len(term) :]]

    def changes(self, text: str | None, column: dict[str, int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """The columns that each swapped form of each of the text's sentences gains and loses."""
        found = []
        for sentence in SENTENCES.findall(text or ""):
            before = words(sentence)
            if not self.first.keys().isdisjoint(before):
                was = {column[f] for f in features_of(before) if f in column}
                for after in self(before):
                    now = {column[f] for f in features_of(after) if f in column}
                    found.append((tuple(sorted(now - was)), tuple(sorted(was - now))))
        return found


def fit(
    docs: DataFrame, labels: DataFrame, most_features: int = 4096, most_rows: int = 40_000, terms: tuple[str, ...] = IDENTITY_TERMS,
    templates: tuple[str, ...] = TEMPLATES, swaps_each: int = 3, penalty: float = 1.0, ridge: float = 1e-4, steps: int = 200,
) -> Model:
    """Fit on the labelled rows that are not held out, at most `most_rows` of them: those with the smallest hash of doc_id.

    The bound makes their ids and labels small enough to broadcast, so that no text is shuffled; the chosen rows are
    written once and read for features, counts and swaps. Each place of a term in a sentence of theirs, and in the
    templates, gives `swaps_each` swapped forms. Labels other than 0 and 1, null ones and unlabelled rows are not used.
    Without rows of both labels, or without a feature in five of them, nothing can be learned and the model calls no text
    toxic (all scores are near 0).
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    wanted = wanted.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = stored(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "labels-chosen")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.select("text", "label"), "labelled-texts", compression="zstd")
    names = choose_features(rows, most_features)
    names = sorted(set(names) | {f for t in terms if names for f in features(t)})
    column = {f: i for i, f in enumerate(names)}
    swap = Swapper(terms, swaps_each)

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [sorted(column[f] for f in features(t) if f in column) for t in batch["text"]]
            swapped = [Counter(swap.changes(t, column)) for t in batch["text"]]
            changes = [[{"gained": list(g), "lost": list(x), "times": n} for (g, x), n in c.items()] for c in swapped]
            yield {"label": batch["label"], "columns": found, "changes": changes}

    sample = map_rows(rows, encode, "label int, columns array<int>, changes array<struct<gained:array<int>,lost:array<int>,times:int>>").toArrow()
    y = sample["label"].to_numpy().astype(float)
    if not len(y) or not names or y.min() == y.max():
        return Model([], np.zeros(0), -30.0)
    changes: Counter = Counter()
    for row in sample["changes"].to_pylist():
        for c in row:
            changes[tuple(c["gained"]), tuple(c["lost"])] += c["times"]
    for template in templates:
        for term in terms:
            changes.update(swap.changes(template.format(term), column))
    w, bias = descend(sample["columns"].to_pylist(), y, changes, len(names), penalty, ridge, steps)
    return Model(names, w, bias, sum(changes.values()))


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every entry."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.fromiter((c for r in rows for c in r), np.int64, len(at))


class Loss:
    """Log loss + ridge + penalty x mean squared change of the score over all swapped sentences."""

    def __init__(self, rows: list[list[int]], y: np.ndarray, changes: dict, width: int, penalty: float, ridge: float):
        order = sorted(range(len(rows)), key=lambda i: (rows[i], y[i]))  # the same whatever order the rows came in
        self.y, self.width, self.penalty, self.ridge = y[order], width, penalty, ridge
        self.at, self.cols = flat([rows[i] for i in order])
        pairs = sorted(changes)
        self.swapped, self.swap_cols = flat([[*gained, *lost] for gained, lost in pairs])
        self.signs = np.array([s for gained, lost in pairs for s in [1.0] * len(gained) + [-1.0] * len(lost)])
        self.share = np.array([changes[p] for p in pairs], float) / max(1, sum(changes.values()))
        rare = max(1.0, (len(y) - y.sum()) / y.sum()) ** 0.5
        self.cost = np.where(self.y > 0, rare, 1.0)

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
        """The loss and its gradient by the weights and, last, the bias."""
        n = len(self.y)
        score = bias + np.bincount(self.at, w[self.cols], n)
        chance = np.clip(sigmoid(score), 1e-12, 1 - 1e-12)
        error = self.cost * (chance - self.y) / n
        change = np.bincount(self.swapped, self.signs * w[self.swap_cols], len(self.share))
        back = 2 * self.penalty * (self.share * change)[self.swapped] * self.signs
        grad = np.bincount(self.cols, error[self.at], self.width) + self.ridge * w + np.bincount(self.swap_cols, back, self.width)
        fit_loss = -(self.cost * np.where(self.y > 0, np.log(chance), np.log(1 - chance))).mean()
        return float(fit_loss + self.ridge * (w @ w) / 2 + self.penalty * (self.share @ change**2)), np.append(grad, error.sum())


def descend(rows: list[list[int]], y: np.ndarray, changes: dict, width: int, penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam."""
    loss = Loss(rows, y, changes, width, penalty, ridge)
    w, bias = np.zeros(width), math.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        _, grad = loss(w, bias)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; a null or empty text gets the model's prior.

    Repeated rows are scored one by one, texts are read whole, and other columns are not read.
    """

    def judge(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            scores = [model.score(t) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    rows = only(docs, "doc_id", "text").select("doc_id", held_out(), F.col("text").cast("string").alias("text"))
    return map_rows(rows, judge, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below `threshold`; batches are filtered as they are.

    A null or empty text gets the model's prior, repeated rows are judged one by one, and an empty table stays empty.
    """
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

    rows = exact(docs)
    return rows.mapInArrow(clean, rows.schema).toDF(*docs.columns)
