"""N-gram Jaccard join with set-relation skipping, and the components of its links.

Documents with equal sets are one node. Every set lists a quarter of its shingles, the first ones by hash, of which any two
linked sets share a known part; sets of which fewer are listed elsewhere have no links. Each of the others is first
compared with the one that looks most like it. What these links connect need not be compared again: where enough of a
set's lists still hold sets of other components, such sets meet by their rarest shingles, in lists split into blocks by
size of set, of which a set skips those that its position in the list rules out. The overlaps of a set with the members of
a component are derived from its overlap with one set of the component, by what each member has more and less than that
one; most are decided by the counts alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, drop, map_rows, only, original_id, stored
from .near import MARKED, MARKS, bucket_pairs, components, joined_roots, marks, prefix_pairs
from .substrings import scramble

WIDTH = 4
#: Bands and rows of the signatures that give the first pairs, least hashes by which these are compared, and how many must be equal.
BANDS, ROWS, SKETCH, ALIKE = 8, 4, 32, 20
NUMBERS = scramble(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes in ascending order; of all words where there are fewer, none without."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(one))
    total = np.full(len(one) - size + 1, len(one) if len(one) < width else width, np.uint64)
    for i in range(size):
        total = scramble(total + one[i : i + len(total)])
    return np.unique(total)


def firsts(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The tokens that a set lists: with sets that share `percent` of their union, shared_firsts() or more are in common."""
    n = len(tokens)
    return tokens[: n - -(-percent * n // 100) - (-n // 10)]


def shared_firsts(n: str, percent: int) -> Column:
    """How many of the firsts() of a set of `n` tokens any linked set lists too.

    A list is longer by a tenth of its set than what two linked sets need to have one token in common, so that they have
    the smaller tenth in common; a linked set has `percent` of n tokens at least.
    """
    return F.ceil(F.col(n) * percent / 1000)


def document_sets(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, key (of the text), n, set (128 bits, null for none) and heads (first shingles) of every row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(text) for text in batch["text"]]
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            heads = [firsts(s, percent).view(np.int64) if len(s) else None for s in sets]
            yield {"doc_id": batch["doc_id"], "key": batch["key"], "n": list(map(len, sets)), "set": names, "heads": heads}

    return map_rows(docs, run, "doc_id long, key long, n long, set binary, heads array<long>")


def band_keys(tokens: np.ndarray) -> list[int]:
    """A key per band, of the least values of ROWS hash functions: alike sets share one, others seldom."""
    least = np.array([(tokens * (factor | np.uint64(1)) + shift).min() for factor, shift in NUMBERS.reshape(-1, 2)]).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.T:
        keys = scramble(keys + row)
    return keys.view(np.int64).tolist()


def sets_of(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """node, tokens and band_keys(), read again from the document (doc_id, key) of each node."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(text) for text in batch["text"]]
            yield {"node": batch["node"], "tokens": [s.view(np.int64) for s in sets], "keys": list(map(band_keys, sets))}

    return map_rows(docs.join(heads.hint("merge"), ["doc_id", "key"]).select("node", "text"), run, "node long, tokens array<long>, keys array<long>")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sets in ascending order."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1) if len(y) else np.zeros(0, np.int64)
    return int((y[at] == x).sum()) if len(y) else 0


def ascending(tokens: list[int]) -> np.ndarray:
    return np.array(tokens, np.int64).view(np.uint64)


def with_tokens(pairs: DataFrame, sets: DataFrame, **sides: str) -> DataFrame:
    """`pairs` with the tokens of its node columns under the names given; merged at any size, as both grow with the input."""
    for column, name in sides.items():
        pairs = pairs.join(sets.select(F.col("node").alias(column), F.col("tokens").alias(name)).hint("merge"), column)
    return pairs


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, their sizes and what they share, of each pair."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x, y = batch.pop("x"), batch.pop("y")
            yield batch | {"na": list(map(len, x)), "nb": list(map(len, y)), "both": [overlap(ascending(p), ascending(q)) for p, q in zip(x, y)]}

    return map_rows(with_tokens(pairs, sets, a="x", b="y").select("a", "b", "x", "y"), run, "a long, b long, na long, nb long, both long")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """b, root, nb, and what b has less and more than its root."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x, y = ([ascending(t) for t in batch.pop(c)] for c in ("x", "y"))
            less, more = ([np.setdiff1d(p, q, assume_unique=True).view(np.int64) for p, q in zip(*sides)] for sides in ((y, x), (x, y)))
            yield batch | {"nb": list(map(len, x)), "less": less, "more": more}

    found = with_tokens(members, sets, b="x", root="y").select("b", "root", "x", "y")
    return map_rows(found, run, "b long, root long, nb long, less array<long>, more array<long>")


def derived(pairs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b), from the overlap of a with the root of b: once for all b of a component.

    What a shares with b is what it shares with the root, less its part in what b lacks, plus its part in what b has more.
    Where the sizes of these decide, a isn't read again.
    """
    pairs = stored(pairs.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b")), "set-pairs", [pairs], compression="zstd")
    base = stored(overlaps(pairs.select("a", F.col("root").alias("b")).distinct(), sets), "root-overlaps", compression="zstd")
    changes = stored(differences(pairs.select("b", "root").distinct(), sets), "set-changes", compression="zstd")
    known = pairs.join(base.select("a", F.col("b").alias("root"), "na", F.col("both").alias("base")), ["a", "root"]).join(changes, ["b", "root"])
    # 100 * both >= percent * (na + nb - both)
    need = percent * (F.col("na") + F.col("nb"))
    surely = (100 + percent) * (F.col("base") - F.size("less")) >= need
    maybe = (100 + percent) * (F.col("base") + F.size("more")) >= need
    known = stored(known.filter(maybe).withColumn("surely", surely), "set-answers", [pairs, base, changes], compression="zstd")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            good = []
            for a, b, na, nb, both, less, more, x in zip(*batch.values()):
                x = ascending(x)
                both += overlap(x, ascending(more)) - overlap(x, ascending(less))
                if 100 * both >= percent * (na + nb - both):
                    good.append((a, b))
            yield {"a": [a for a, _ in good], "b": [b for _, b in good]}

    open_ = with_tokens(known.filter("not surely"), sets, a="x").select("a", "b", "na", "nb", "base", "less", "more", "x")
    return stored(known.filter("surely").select("a", "b").unionByName(map_rows(open_, run, "a long, b long")), "more-set-links", [known])


def first_pairs(sets: DataFrame) -> DataFrame:
    """a, b: each set b with the two sets before it that share most of their SKETCH least hashes, of those that it meets under
    its band keys."""
    met = bucket_pairs(sets.select("node", F.explode("keys").alias("key"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    least = sets.select("node", F.slice("tokens", 1, SKETCH).alias("tokens"))
    alike = with_tokens(met, least, a="x", b="y").select("a", "b", F.size(F.array_intersect("x", "y")).alias("alike"), F.least(F.size("x"), F.size("y")).alias("of"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("alike", "a")), asc=False), 1, 2)
    return alike.filter(F.col("alike") * SKETCH >= F.col("of") * ALIKE).groupBy("b").agg(most.alias("most")).select(F.explode("most.a").alias("a"), "b")


def open_pairs(entries: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that share enough lists, by their rarest shingles (see prefix_pairs)."""
    placed = stored(entries.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "list-roots", compression="zstd")
    mixed = stored(placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token"), "mixed-lists")
    nodes = placed.join(mixed.hint("merge"), "token", "left_semi").groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.count("*").alias("lists"))
    nodes = stored(nodes.filter(F.col("lists") >= shared_firsts("n", percent)).select("node", "root"), "open-sets", [placed, mixed])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield batch | dict(zip(MARKS, zip(*(marks(ascending(t)) for t in batch["tokens"]))))

    rows = sets.join(nodes.hint("merge"), "node").dropDuplicates(["node"]).select("node", "root", "tokens")
    rows = stored(map_rows(rows, run, MARKED), "open-tokens", [nodes], compression="zstd")
    pairs = prefix_pairs(rows, percent / 100)
    drop(rows)
    return pairs


def jaccard_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, its own included) of every row.

    Documents link when their sets of distinct four-word shingles (lower-case A to Z, all words where there are fewer) share
    `percent` of their union or more; all links count, none is estimated. Texts without words, null ones too, have no
    shingles and no links. Rows that repeat a doc_id are documents of their own; null ids count as none and come back null; an
    empty table gives an empty result; other columns are not read. Shingles are compared by 64-bit hashes within a pair,
    sets by 128 bits.
    """
    docs = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    found = stored(document_sets(docs, percent), "document-sets", compression="zstd")
    known = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    nodes = found.filter("n > 0").groupBy("set").agg(F.min(F.struct("doc_id", "key")).alias("head"), F.min(known).alias("least"))
    nodes = stored(nodes.select("set", "head.*", "least").withColumn("node", F.monotonically_increasing_id()), "set-nodes", compression="zstd")
    lists = found.join(nodes.select("node", "doc_id", "key"), ["doc_id", "key"]).select("node", "n", F.explode("heads").alias("token"))
    shared = stored(lists.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1").select("token"), "shared-heads", compression="zstd")
    entries = stored(lists.join(shared, "token").distinct(), "list-entries", compression="zstd")
    wanted = entries.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("lists")).filter(F.col("lists") >= shared_firsts("n", percent)).select("node")
    wanted = stored(wanted, "wanted-sets")
    listed = entries
    entries = entries.join(wanted.hint("merge"), "node", "left_semi")  # merged at any size, as all grow with the input
    sets = stored(sets_of(docs, nodes.join(wanted, "node").select("node", "doc_id", "key")), "node-sets", compression="zstd")

    met = stored(first_pairs(sets), "first-pairs")
    links = overlaps(met, sets).filter((100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb")))
    links = stored(links.select("a", "b"), "set-links", [met])
    roots = components(links)
    drop(links)
    roots = joined_roots(roots, derived(open_pairs(entries, roots, sets, percent), roots, sets, percent))
    drop(listed, shared, wanted, sets)

    whole = stored(nodes.select("set", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-sets", [nodes, roots], compression="zstd")
    least = stored(whole.groupBy("root").agg(F.min("least").alias("component_id")), "set-components", compression="zstd")
    named = stored(whole.join(least, "root").select("set", "component_id"), "named-sets", [whole, least], compression="zstd")
    return found.join(named, "set", "left").select(original_id(), F.col("n").alias("n_shingles"), F.coalesce("component_id", original_id()).alias("component_id"))
