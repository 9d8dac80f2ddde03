"""Language identification by rank-order profiles (out-of-place distance between n-gram rankings)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_rows, only

#: A code point takes 21 bits of an n-gram's code; this one stands for whatever is not a letter.
BITS, GAP = 21, 1


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the letters, with one gap for each run of anything else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    line = np.concatenate(([GAP], np.where(letter, codes, GAP)[kept], [GAP]))
    two = (line[:-1] << BITS) | line[1:]
    three = (two[:-1] << BITS) | line[2:]
    gap_gap = (GAP << BITS) | GAP
    return np.concatenate((line[line != GAP], two[two != gap_gap], three[(two[:-1] != gap_gap) & (two[1:] != gap_gap)]))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_ngrams(batches: Iterator[dict], most: int = 1 << 20) -> Iterator[dict]:
    """Counts by language; what is held is merged, and sent on once it has `most` n-grams."""
    held: dict[str, list] = {}

    def flush(lang: str) -> dict:
        codes, counts = merged(held.pop(lang))
        return {"lang": [lang] * len(codes), "gram": codes.tolist(), "n": counts.tolist()}

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            codes = ngrams(text)
            if len(codes):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(codes, return_counts=True))
                if len(parts) >= 256 or sum(len(c) for c, _ in parts[-2:]) > most:
                    held[lang] = [merged(parts)]
                    if len(held[lang][0][0]) >= most:
                        yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def fit_profiles(docs: DataFrame, size: int = 300) -> dict[str, np.ndarray]:
    """For each language of the rows that are not held out, its `size` most frequent n-grams, in order.

    Counts cover all those rows; what is gathered is `size` codes a language. Ties go to the smaller code.
    """
    rows = only(docs, "doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = map_rows(rows, count_ngrams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in top.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


class Ranker:
    """Distances of a text to every profile at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)  # the last column: in no profile
        for row, lang in zip(self.ranks, self.langs):
            row[np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = ngrams(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.langs:
            return "und", 0.0
        codes, counts = np.unique(codes, return_counts=True)
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        at = np.where(self.grams[at] == top, at, len(self.grams))
        there = self.ranks[:, at]
        away = np.where(there < 0, self.size, np.abs(there - np.arange(len(top)))).sum(1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred and score (1: same ranking, 0: no n-gram shared) for every row.

    `und` with score 0 for null or empty texts, texts without a letter, and where no language was learned. Ties go to
    the first language by name. Repeated rows are judged one by one; other columns are not read.
    """

    def judge(batches: Iterator[dict]) -> Iterator[dict]:
        rank = Ranker(profiles, size)
        for batch in batches:
            found = [rank(text) for text in batch["text"]]
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    rows = only(docs, "doc_id", "text").select("doc_id", held_out(), F.col("text").cast("string").alias("text"))
    return map_rows(rows, judge, "doc_id long, held_out boolean, lang_pred string, score double")
