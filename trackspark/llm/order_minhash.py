"""MinHash near-dedup by Order MinHash, with candidates verified by banded alignment."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of, stored
from .near import SHINGLE, SIMILAR, linked, shingle_hashes, signed_hash, words_of
from .substrings import scramble

GOLD = np.uint64(0x9E3779B97F4A7C15)


def occurrence_labels(shingles: np.ndarray) -> np.ndarray:
    """How often each shingle came before, in text order."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    run = np.arange(len(ranked)) - np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    labels = np.empty(len(ranked), np.uint64)
    labels[order] = run
    return labels


def labelled_shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle and how often it came before."""
    shingles = shingle_hashes(words, size)
    return scramble(shingles + occurrence_labels(shingles) * GOLD)


def sketch(words: list[str], samples: int, picked: int, size: int = SHINGLE) -> list[int]:
    """One key a sample: the `picked` smallest occurrence-labelled shingles under its hash, in text order."""
    labelled = labelled_shingles(words, size)
    take = min(picked, len(labelled))
    numbers = np.arange(1, samples + 1, dtype=np.uint64)
    least = np.empty((samples, take), np.int64)
    for row, seed in zip(least, numbers * GOLD):
        row[:] = np.argpartition(scramble(labelled ^ seed), take - 1)[:take]
    least.sort(1)
    keys = numbers
    for column in least.T:
        keys = scramble(keys + labelled[column])
    return keys.view(np.int64).tolist()


def aligned(x: list, y: list, similar: float) -> bool:
    """Whether a banded alignment of two sequences matches at least `similar` of their union.

    The band is as wide as an alignment that good can stray, so nothing is lost by it. Rows are bit vectors: one
    addition does a whole row of the longest common subsequence.
    """
    if min(len(x), len(y)) < similar * max(len(x), len(y)):
        return False
    total = len(x) + len(y)
    need = math.ceil(similar * total / (1 + similar) - 1e-9)  # m matches of total - m in the union
    if sum((Counter(x) & Counter(y)).values()) < need:
        return False
    low, high_x, high_y = 0, len(x), len(y)
    while low < min(high_x, high_y) and x[low] == y[low]:
        low += 1
    while min(high_x, high_y) > low and x[high_x - 1] == y[high_y - 1]:
        high_x, high_y = high_x - 1, high_y - 1
    matched = low + len(x) - high_x
    x, y = x[low:high_x], y[low:high_y]
    if x and y and matched < need:
        band = max(len(x), len(y)) + matched - need
        places: dict = {}
        for i, item in enumerate(x):
            places[item] = places.get(item, 0) | 1 << i
        full = rows = (1 << len(x)) - 1
        window = (1 << (2 * band + 1)) - 1
        for j, item in enumerate(y):
            if item in places:
                here = rows & places[item] & (window << (j - band) if j >= band else window >> (band - j))
                rows = ((rows + here) | (rows - here)) & full
        matched += len(x) - rows.bit_count()
    return matched >= need


def alike(x: str, y: str, similar: float = SIMILAR, size: int = SHINGLE) -> bool:
    """Whether the word shingles of two texts align, in order, to `similar` of their union."""
    a, b = ([tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] for w in (words_of(x), words_of(y)))
    return aligned(a, b, similar)


def sketches(docs: DataFrame, samples: int, picked: int) -> DataFrame:
    """doc_id, node (hash of the words, null without any) and keys; copies in a batch have keys once."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            nodes, keys, seen = [], [], set()
            for text in batch["text"]:
                words = words_of(text)
                node = signed_hash(" ".join(words)) if words else None
                nodes.append(node)
                keys.append(sketch(words, samples, picked) if words and node not in seen else [])
                seen.add(node)
            yield {"doc_id": batch["doc_id"], "node": nodes, "keys": keys}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, node long, keys array<long>")


def classes(docs: DataFrame, samples: int = 16, picked: int = 3, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size and exact (a smaller doc_id has the same words).

    Texts are compared as lower-case words in shingles of five. Those with equal words are one node; nodes that share
    a key, all of them (see linked), are checked by banded alignment and linked from `similar` of their shingles' union
    on; classes are the components. Texts without a word, null ones too, are classes of their own; a text with fewer than five words is one
    shingle; doc_id is a key; an empty table gives an empty result; other columns are not read. A pair at 0.8 shares a key with probability over 0.9999.
    """
    rows = stored(sketches(docs, samples, picked), "order-sketches")
    nodes = rows.filter("node is not null")

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        chosen = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi")
        return docs.join(chosen.hint("merge"), "doc_id").select("node", "text")

    buckets = nodes.select("node", F.explode("keys").alias("key"))
    roots = linked(buckets, texts_of, lambda x, y: alike(x, y, similar), lambda text: labelled_shingles(words_of(text)), similar)
    heads = nodes.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(roots, "node", "left")
    heads = heads.withColumn("root", F.coalesce("root", "node"))
    heads = stored(heads, "class-heads", [roots], compression="zstd")
    whole = stored(heads.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")), "classes", compression="zstd")
    heads = stored(heads.join(whole, "root").select("node", "first", "class_id", "class_size"), "node-classes", [heads, whole], compression="zstd")
    rows = stored(rows.select("doc_id", "node"), "document-nodes", [rows], compression="zstd")
    out = rows.join(heads, "node", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("first").isNotNull() & (F.col("first") < F.col("doc_id"))).alias("exact"),
    )


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """classes() of documents whose ids may be null or repeat: every row is a document of its own."""
    docs, back = rows_of(docs)
    return back(classes(docs, **parameters), "doc_id", "class_id")


def first_of_each(docs: DataFrame, *columns: str, **parameters) -> DataFrame:
    """doc_id, text and `columns` of one document of each class, the one with the smallest doc_id."""
    docs, back = rows_of(docs, *columns)
    kept = stored(classes(docs, **parameters).filter("doc_id = class_id").select("doc_id"), "kept")
    return back(docs.join(kept, "doc_id", "left_semi"), "doc_id")
