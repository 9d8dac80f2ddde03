"""Near-duplicates: pairs from buckets, their check by text, and components by a distributed union-find."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, map_rows, stored
from .substrings import scramble

WORD = re.compile(r"\w+")
SHINGLE, SIMILAR = 5, 0.8


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def signed_hash(text: str) -> int:
    found = xxhash.xxh3_64_intdigest(text.encode())
    return found - 2**64 if found >= 2**63 else found


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each `size`-word shingle, in text order; of all words where there are fewer."""
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        total = scramble(total + one[i : i + n])
    return total


def shingles_of(lists: list[list[str]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes() of several word lists, each of `size` words or more, one after another, and where each starts."""
    lengths = np.array([len(words) for words in lists])
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lists)), np.uint64, int(lengths.sum()))
    total = np.zeros(len(one) - size + 1, np.uint64)
    for i in range(size):
        total = scramble(total + one[i : i + len(total)])
    counts = lengths - size + 1
    starts = np.cumsum(counts) - counts
    return total[np.arange(counts.sum()) + np.repeat(np.cumsum(lengths) - lengths - starts, counts)], starts


def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, node) sorted: each node with the first and with the previous node of its key, the key, and whether three or more rows came before."""
    key = leader = before = None
    count = 0
    for batch in batches:
        keys, nodes = (c.to_numpy() for c in batch.columns)
        if not len(keys):
            continue
        here = np.arange(len(keys))
        starts = np.append(keys[0] != key, keys[1:] != keys[:-1])
        at = np.maximum.accumulate(np.where(starts, here, -1))
        leaders = np.where(at < 0, nodes[0] if leader is None else leader, nodes[at])
        previous = np.append(nodes[0] if before is None else before, nodes[:-1])
        places = np.where(at < 0, here + count, here - at)
        new = ~starts & (nodes != previous)
        key, leader, before, count = keys[-1], leaders[-1], nodes[-1], int(places[-1]) + 1
        far = new & (previous != leaders)
        columns = (np.append(leaders[new], previous[far]), np.append(nodes[new], nodes[far]), np.append(keys[new], keys[far]), np.append(places[new], places[far]) > 2)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "key", "deep"])


def bucket_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs of nodes to check first, from `key` and `node` columns: two at most for each row, never all of a bucket.

    `deep` is true on a row or more of each bucket of four nodes or more: only there do nodes remain that haven't met.
    Nodes of a bucket are in the order of a hash of both, so that in each bucket that two nodes share they have other
    leaders and neighbours. Copies are one node and each task sends it once, so that a key's rows don't grow with the
    number of copies.
    """
    rows = buckets.select("key", "node").repartition(F.col("key")).sortWithinPartitions("key", F.xxhash64("key", "node"), "node")
    return rows.mapInArrow(pair_up, "a long, b long, key long, deep boolean")


def open_nodes(met: DataFrame, roots: DataFrame) -> DataFrame:
    """`node` and `root` of the buckets of four nodes or more that are in several components.

    From the bucket_pairs(): each node of such a bucket has met the first one there.
    """
    keys = stored(met.filter("deep").select("key").distinct(), "deep-buckets")
    members = met.join(keys, "key").select("key", F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left")
    members = stored(members.select("key", "node", F.coalesce("root", "node").alias("root")), "bucket-members", compression="zstd")
    drop(keys)
    apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    apart = stored(apart, "open-buckets")
    return stored(members.join(apart, "key", "left_semi").select("node", "root").distinct(), "open-bucket-nodes", [members, apart])


#: Words of 64 parity bits of a set.
MARKS = tuple(f"m{i}" for i in range(16))
MARKED = "node long, root long, tokens array<long>, " + ", ".join(f"{m} long" for m in MARKS)


def marks(tokens: np.ndarray) -> list[int]:
    """1024 bits, as longs: each is set if an odd number of the tokens falls on it.

    Where the marks of two sets differ in d bits, the sets differ in d tokens or more.
    """
    found = np.zeros(len(MARKS), np.uint64)
    np.bitwise_xor.at(found, (tokens >> np.uint64(60)).astype(np.int64), np.uint64(1) << (tokens & np.uint64(63)))
    return found.view(np.int64).tolist()


def prefix_pairs(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs a < b of nodes of different roots that can share `similar` of their tokens' union, from node, root, tokens
    (distinct) and their MARKS.

    With the tokens of each node ordered from the rarest on, the first one that two such nodes share is among the first
    n - similar * n + 1 of each, and from it on both have as many tokens left as they must share. Nodes meet by such a
    token and a class of sizes, so that those that only share what is common don't meet, and make a pair, once, at the
    first token that they share if their marks differ in no more bits than their sets may in tokens. Nothing is lost by it.
    The largest root of a list meets the others of the list alone, so that a large component isn't held against itself.
    """
    often = stored(rows.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1"), "token-counts")
    ranked = rows.select("node", F.explode("tokens").alias("token")).join(often, "token")
    ranked = ranked.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "token"))), lambda t: t["token"]).alias("ranked"))
    ranked = ranked.join(rows.select("node", "root", *MARKS, F.size("tokens").alias("size")), "node")
    shared = F.size("ranked")  # the other tokens are the node's own and come first
    firsts = F.slice("ranked", 1, F.greatest(F.lit(0), shared - F.ceil(similar * F.col("size") - 1e-9) + 1).cast("int")).alias("firsts")
    of_node = ("node", "root", *MARKS, "size")
    heads = ranked.select(*of_node, shared.alias("shared"), firsts).select(*of_node, "shared", "firsts", F.posexplode("firsts").alias("at", "token"))
    heads = heads.select(*of_node, (F.col("shared") - F.col("at")).alias("left"), F.slice("firsts", F.lit(1), F.col("at")).alias("before"), "token")
    heads = stored(heads, "token-heads", [often], compression="zstd")

    def size_class(column: Column) -> Column:
        return F.floor(F.log(column) / math.log(1.1)).cast("int")

    # a partner t of a node of n tokens, t <= n, has similar * n or more, and similar * (n + t) / (1 + similar) <= left;
    # the smaller one of a pair meets at a token only if it can share what two sets of its size must
    least, most = F.ceil(similar * F.col("size") - 1e-9), F.least(F.col("size"), F.floor(F.col("left") * (1 + similar) / similar - F.col("size") + 1e-9))
    large = heads.filter(least <= most).withColumn("class", F.explode(F.sequence(size_class(least), size_class(most))))
    small = heads.filter(F.col("left") >= 2 * similar * F.col("size") / (1 + similar) - 1e-9).withColumn("class", size_class(F.col("size")))
    # nodes of one root need not meet: a list of one root goes, and those of a list's largest root only meet the others
    by_root = small.groupBy("token", "class", "root").count().groupBy("token", "class").agg(F.max_by("root", "count").alias("main"))
    by_root = stored(by_root, "token-roots", compression="zstd")
    main = F.col("root") == F.col("main")
    small = small.join(by_root, ["token", "class"]).withColumn("other", ~main)
    large = large.join(by_root, ["token", "class"]).withColumn("other", F.explode(F.when(main, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    x, y = large.drop("main").alias("x"), small.drop("main").alias("y")
    both = F.col("x.size") + F.col("y.size")
    need = similar * both / (1 + similar) - 1e-9
    apart = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in MARKS[1:]), F.bit_count(F.col(f"x.{MARKS[0]}").bitwiseXOR(F.col(f"y.{MARKS[0]}"))))
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.other") == F.col("y.other")) & (F.col("x.root") != F.col("y.root"))
        & ((F.col("x.size") > F.col("y.size")) | (F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")))
        & (F.least("x.left", "y.left") >= need) & (apart <= both - 2 * need) & ~F.arrays_overlap("x.before", "y.before"),
    )
    return stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")), "prefix-pairs", [heads, by_root])


def linked(buckets: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similar: Callable[[str, str], bool], tokens: Callable[[str], np.ndarray], share: float) -> DataFrame:
    """`node` and `root` of the nodes, from `key` and `node`, that are similar to another one of their buckets.

    First each node meets two others of each bucket. Where a bucket of four nodes or more is then in several components,
    all its nodes meet again by the tokens of their texts (see prefix_pairs), so that no link between two nodes of a
    bucket is lost. texts_of(pairs) gives the `node` and `text` of the nodes in pairs (a, b); similar texts must share
    `share` of the union of their distinct `tokens`.
    """
    met = stored(bucket_pairs(buckets), "bucket-pairs", compression="zstd")
    pairs = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    texts = stored(texts_of(pairs), "node-texts", compression="zstd")
    links = stored(checked(pairs, texts, similar), "checked")
    roots = components(links)
    drop(links)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [np.unique(tokens(text)) for text in batch["text"]]
            yield {"node": batch["node"], "root": batch["root"], "tokens": [f.view(np.int64) for f in found]} | dict(zip(MARKS, zip(*map(marks, found))))

    apart = open_nodes(met, roots)
    drop(met)
    opened = map_rows(texts.join(apart, "node").select("node", "root", "text"), run, MARKED)
    opened = stored(opened, "open-nodes", [apart], compression="zstd")
    if opened.isEmpty():
        drop(pairs, texts, opened)
        return roots
    again = prefix_pairs(opened, share)
    more = stored(again.join(pairs, ["a", "b"], "left_anti"), "more-pairs", [again, opened, pairs])
    more = stored(checked(more, texts, similar), "more-checked", [more, texts])
    return joined_roots(roots, more)


def joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The roots (stored) of components with `more` links (stored) between them."""
    if more.isEmpty():
        drop(more)
        return roots
    hooked = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(hooked.unionByName(more))
    drop(roots, more)
    return found


def checked(pairs: DataFrame, texts: DataFrame, similar: Callable[[str, str], bool]) -> DataFrame:
    """The pairs (a, b) whose texts, from `node` and `text`, are similar."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            good = [(a, b) for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]) if similar(x, y)]
            yield {"a": [a for a, _ in good], "b": [b for _, b in good]}

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return map_rows(both.select("a", "b", "x", "y"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """`node` and `root` (smallest node of its component) of every node with a link (a, b), stored.

    Large-star and small-star rounds: each node's neighbours are hooked to its smallest one until nothing changes. Every
    round is a grouped minimum and a join, written to the shared folder. The minima are a table before they are joined,
    so that Spark can split the links of a large component's root over tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, sign = stored(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == sign:
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own), "roots", [edges])
        sign = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star", [least, edges])
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", [least, large])


def jaccard(x: str, y: str, size: int = SHINGLE) -> float:
    """Exact similarity of the word-shingle sets."""
    a, b = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (words_of(x), words_of(y)))
    return len(a & b) / len(a | b)
