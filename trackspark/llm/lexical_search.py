"""Ranked lexical search by Block-Max MaxScore over shards of the documents.

A shard is a few thousand documents of one task with posting lists of the queries' terms, in compressed blocks that tell
their greatest frequency and shortest document. A query's lists are put in order of the most that they can add; lists that
together cannot reach the tenth best score are not essential: documents come from the essential lists alone, and a block of
the others is only decompressed for documents that its maximum could still bring among the best. Shards are searched
one by one, each task keeps the best of its shards, and these are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, map_rows, only, original_id, stored, term_table

WORDS = term_table(digits=True)
#: Documents and bytes of text of a shard, and postings of a block.
SHARD_DOCS, SHARD_BYTES, BLOCK = 1 << 14, 48 << 20, 64
#: Queries of one pass over the documents, and the terms that they may have together.
QUERIES, MOST_TERMS = 20_000, 1 << 19

INDEX = (
    "ids array<long>, sizes array<long>, terms array<int>, counts array<int>, blocks array<int>, last array<int>, "
    "most array<int>, least array<long>, data array<binary>"
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def pack(docs: np.ndarray, tfs: np.ndarray) -> bytes:
    """Postings as the two widths, steps between documents, and frequencies, in as many bytes as the largest needs."""
    steps = np.diff(docs, prepend=0)
    a, b = (next(w for w in (1, 2, 4) if values.max() < 1 << 8 * w) for values in (steps, tfs))
    return bytes((a, b)) + steps.astype(f"<u{a}").tobytes() + tfs.astype(f"<u{b}").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = data[0], data[1]
    n = (len(data) - 2) // (a + b)
    return np.cumsum(np.frombuffer(data, f"<u{a}", n, 2), dtype=np.int64), np.frombuffer(data, f"<u{b}", n, 2 + a * n).astype(np.int64)


def shard(ids: list[int], sizes: list[int], terms: list[int], docs: list[int], tfs: list[int]) -> dict:
    """One row of the index from postings (term, document's place, frequency) in order of documents."""
    sizes_, term, doc, tf = (np.array(x, np.int64) for x in (sizes, terms, docs, tfs))
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    names, starts, counts = np.unique(term, return_index=True, return_counts=True)
    blocks = -(-counts // BLOCK)
    # where each block starts: its list's start and BLOCKs from there
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(blocks)[:-1])) * BLOCK, blocks) + np.arange(blocks.sum()) * BLOCK
    ends = np.minimum(at + BLOCK, np.repeat(starts + counts, blocks))
    row = {"ids": ids, "sizes": sizes, "terms": names, "counts": counts, "blocks": blocks, "last": doc[ends - 1]}
    row |= {"most": np.maximum.reduceat(tf, at), "least": np.minimum.reduceat(sizes_[doc], at)} if len(at) else {"most": [], "least": []}
    row["data"] = [pack(doc[a:b], tf[a:b]) for a, b in zip(at.tolist(), ends.tolist())]
    return {k: [v if isinstance(v, list) else v.tolist()] for k, v in row.items()}


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per shard: its documents with a term, their lengths in terms, and the blocks of the vocabulary's lists."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = shared.value
        ids, sizes, terms, places, tfs = [], [], [], [], []
        taken = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                counts = Counter(words := terms_of(text))
                if not words:
                    continue
                met = [t for t in counts if t in known]
                terms += [known[t] for t in met]
                tfs += [counts[t] for t in met]
                places += [len(ids)] * len(met)
                ids.append(doc_id)
                sizes.append(len(words))
                taken += len(text)
                if len(ids) == SHARD_DOCS or taken > SHARD_BYTES:
                    yield shard(ids, sizes, terms, places, tfs)
                    ids, sizes, terms, places, tfs = [], [], [], [], []
                    taken = 0
        if ids:
            yield shard(ids, sizes, terms, places, tfs)

    return map_rows(docs, run, INDEX)


def damped(sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of documents with so many terms: 25 + (75 * size * documents) div length."""
    if len(sizes) and 75 * documents * int(sizes.max()) >= 2**63:
        return np.array([25 + 75 * int(n) * documents // length for n in sizes], np.int64)
    return 25 + 75 * sizes * documents // length


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Grows with the frequency and falls with m, so that a block's greatest frequency and least m bound it."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """One row of the index under the collection's counts; blocks are decompressed when first asked for."""

    def __init__(self, row: dict, documents: int, length: int):
        self.ids = np.array(row["ids"], np.int64)
        self.m = damped(np.array(row["sizes"], np.int64), documents, length)
        self.place = {t: k for k, t in enumerate(row["terms"])}
        self.first = np.concatenate(([0], np.cumsum(np.array(row["blocks"], np.int64)))).astype(int)
        self.last, self.data = np.array(row["last"], np.int64), row["data"]
        self.bound = impact(np.array(row["most"], np.int64), damped(np.array(row["least"], np.int64), documents, length))
        self.bounds = np.maximum.reduceat(self.bound, self.first[:-1]) if len(self.bound) else self.bound
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of documents, and impacts."""
        if k not in self.opened:
            docs, tfs = unpack(self.data[k])
            self.opened[k] = docs, impact(tfs, self.m[docs])
        return self.opened[k]

    def best(self, query: list[tuple[int, int]], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of documents that may be among the `top` of (term, weight)s, given that `least` must be met."""
        lists = sorted((weight * int(self.bounds[self.place[t]]), weight, self.place[t]) for t, weight in query if t in self.place)
        upto = np.cumsum([0, *(bound for bound, _, _ in lists)])  # upto[k]: the most that the k smallest lists can add
        essential = int(np.searchsorted(upto[1:], least))  # those before it together stay below `least`
        score, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for _, weight, place in lists[essential:]:
            for k in range(self.first[place], self.first[place + 1]):
                docs, values = self.block(k)
                score[docs] += weight * values
                seen[docs] = True
        found = np.flatnonzero(seen)
        for k in range(essential, -1, -1):
            mine = score[found]
            if len(found) > top:
                least = max(least, int(np.partition(mine, -top)[-top]))
            found = found[mine + upto[k] >= least]
            if not k or not len(found):
                break
            _, weight, place = lists[k - 1]
            first, end = self.first[place], self.first[place + 1]
            block = first + np.searchsorted(self.last[first:end], found)
            inside = block < end
            most = np.where(inside, weight * self.bound[np.minimum(block, end - 1)], 0)
            open_ = score[found] + most + upto[k - 1] >= least  # the others are out, whatever their block holds
            found, block, inside = found[open_], block[open_], inside[open_]
            for b in np.unique(block[inside]):
                docs, values = self.block(int(b))
                asked = found[block == b]
                at = np.minimum(np.searchsorted(docs, asked), len(docs) - 1)
                score[asked] += np.where(docs[at] == asked, weight * values[at], 0)
        return score[found], found


def merged(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def search_block(docs: DataFrame, queries: list[tuple[object, dict[bytes, int]]], id_type: T.DataType, top: int) -> DataFrame:
    """The best documents of a block of queries (item_id, terms with their repeats)."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
    lists = stored(index(docs, vocabulary), "search-index", compression="zstd")
    total = lists.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, v: t + v)).alias("l")).first()
    documents, length = total["n"] or 0, total["l"] or 0
    held = lists.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weights = {r["terms"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1))) for r in held.collect()}  # a row per term of the queries
    wanted = [[(k, n * weights[k]) for t, n in terms.items() if (k := vocabulary[t]) in weights] for _, terms in queries]
    shared = spark.sparkContext.broadcast(wanted)
    names = [item_id for item_id, _ in queries]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        asked = shared.value
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for values in zip(*batch.values()):
                part = Shard(dict(zip(batch, values)), documents, length)
                for q, query in enumerate(asked):
                    scores, ids = heaps[q]
                    new, places = part.best(query, top, int(scores[-1]) if len(scores) == top else 1)
                    heaps[q] = merged(np.append(scores, new), np.append(ids, part.ids[places]), top)
        rows = [(q, names[q], *row) for q, (s, i) in enumerate(heaps) for row in zip(s.tolist(), i.tolist()) if row[0] > 0]
        if rows:
            yield dict(zip(("item", "item_id", "score", "doc_id"), map(list, zip(*rows))))

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_type), T.StructField("score", T.LongType()), T.StructField("doc_id", T.LongType())])
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = map_rows(lists, run, schema, most=1 << 40).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return found.select("item_id", "rank", original_id(), "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item by the sum of w * (10^9 tf div (1000 tf + 8 m)) over
    its terms, repeats included, with score above 0; equal scores by ascending doc_id.

    Items are asked in blocks of QUERIES, each in one pass over all documents. Null texts have no terms; a null doc_id comes
    first among equal scores; repeated rows are documents (or items) of their own; an item without results has no row;
    empty tables give an empty result; other columns are not read.
    """
    docs = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = only(items, "item_id", "text")
    id_type = items.schema["item_id"].dataType
    rows = ((r["item_id"], Counter(terms_of(r["text"]))) for r in items.toLocalIterator())
    found = None
    while block := list(islice(rows, 1)):
        terms = len(block[0][1])
        while len(block) < QUERIES and terms < MOST_TERMS and (more := list(islice(rows, 1))):
            block += more
            terms += len(more[0][1])
        part = search_block(docs, block, id_type, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = [T.StructField("item_id", id_type), *(T.StructField(c, t()) for c, t in (("rank", T.IntegerType), ("doc_id", T.LongType), ("score", T.LongType)))]
        return docs.sparkSession.createDataFrame([], T.StructType(schema))
    return found
