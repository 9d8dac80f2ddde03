"""Source divergence audit: how far the words of a language's sources are from each other and from the language.

A term's smoothed share in a group depends on its count there alone, so the terms of a group are kept as bitmaps of term
positions, one for each count. For two groups, the bits that a bitmap of the one and a bitmap of the other have in common
are the terms of that pair of counts; their number times the difference of the two shares, summed over the pairs of
counts, is the divergence. Terms that a group lacks are what its bitmaps leave over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, only, stored, term_table

TERMS = term_table(digits=False)
#: Terms of a block, sources whose pairs one row of a block takes, and words that are compared in one go.
BLOCK, TILE, AT_ONCE = 1024, 256, 1 << 21
#: A task's counts are handed on when they take about so many bytes.
MOST_BYTES = 96 << 20
#: Terms and documents are counted in one number: documents from this bit on.
DOCS = 44


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), summed up within tasks as far as memory allows."""

    def rows(found: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("lang", "source", "term", "n", "docs")}
        for (lang, source), group in found.items():
            out["lang"] += [lang] * len(group)
            out["source"] += [source] * len(group)
            out["term"] += [t.decode() for t in group]
            out["n"] += [v & (1 << DOCS) - 1 for v in group.values()]
            out["docs"] += [v >> DOCS for v in group.values()]
        return out

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        found: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for key, text in zip(zip(batch["lang"], batch["source"]), batch["text"]):
                raw = text.encode().translate(TERMS)
                counts, group = Counter(raw.split()), found.setdefault(key, {})
                before = len(group)
                for term, n in counts.items():
                    group[term] = group.get(term, 0) + n + (1 << DOCS)
                new = len(group) - before
                size += new * (150 + len(raw) // (len(counts) or 1))
                if size > MOST_BYTES:
                    yield rows(found)
                    found, size = {}, 0
        yield rows(found)

    counts = map_rows(docs, run, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(n: str | Column, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * terms)), exact for any count."""
    n = F.col(n) if isinstance(n, str) else n
    above, below = F.lit(10**9).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)"), (F.col(total) + 5 * F.col(terms)).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def placed(kept: DataFrame) -> DataFrame:
    """The kept terms (lang, term, all_n) with the block (size, part) and the position in it of each.

    A block holds about BLOCK terms with counts of one power of two, so that its groups have few counts; which of the blocks
    of that size is told by a hash of the term. No task sees all terms of a language.
    """
    kept = kept.withColumn("size", F.floor(F.log2("all_n")).cast("int"))
    parts = stored(kept.groupBy("lang", "size").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "audit-parts")
    kept = kept.join(parts, ["lang", "size"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts")).drop("parts")
    return kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", "size", "part").orderBy("term")) - 1)


def joint_values(size: int, owner: np.ndarray, share: np.ndarray, bits: np.ndarray, none: np.ndarray, first: int, end: int) -> np.ndarray:
    """For groups first to before end and all groups: the differences of shares summed over a block's `size` terms.

    Level k, a row of `bits`, holds the terms of one count in group owner[k], where their share is share[k]; `none` is each
    group's share of terms that it lacks.
    """
    groups = len(none)
    held = np.bitwise_count(bits).sum(1, dtype=np.int64)
    total = np.zeros(groups, np.int64)
    np.add.at(total, owner, held)
    out = np.zeros((end - first, groups), np.int64)
    step = max(1, AT_ONCE // max(1, bits.size))
    for a in range(first, end):
        value, both, left = out[a - first], np.zeros(groups, np.int64), held.copy()
        mine = np.flatnonzero(owner == a)
        for k in range(0, len(mine), step):
            level = mine[k : k + step]
            joint = np.bitwise_count(bits[level][:, None] & bits[None]).sum(2, dtype=np.int64)
            np.add.at(value, owner, (joint * np.abs(share[level][:, None] - share[None])).sum(0))
            met = np.zeros((len(level), groups), np.int64)
            np.add.at(met, (slice(None), owner), joint)
            value += ((held[level][:, None] - met) * np.abs(share[level][:, None] - none[None])).sum(0)
            both += met.sum(0)
            left -= joint.sum(0)
        np.add.at(value, owner, left * np.abs(share - none[a]))
        value += (size - total[a] - total + both) * np.abs(none[a] - none)
    return out


def block_values(blocks: DataFrame) -> DataFrame:
    """lang, a, b (a before b) and value of each pair of groups over a block of terms, for one TILE of the groups a.

    From lang, groups (array of source and `none`, in order of source), tile, size and cells (array of source, share, word,
    bits); without a block, size and cells are null and all values are 0.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for lang, groups, tile, size, cells in zip(*batch.values()):
                place = {g["source"]: k for k, g in enumerate(groups)}
                none = np.array([g["none"] for g in groups], np.int64)
                levels: dict[tuple[int, int], int] = {}  # counts of like shares may share a level: the share is all that matters
                row = [levels.setdefault((place[c["source"]], c["share"]), len(levels)) for c in cells or ()]
                bits = np.zeros((len(levels), -(-(size or 0) // 64)), np.uint64)
                if row:
                    np.bitwise_or.at(bits, (row, [c["word"] for c in cells]), np.array([c["bits"] for c in cells], np.int64).view(np.uint64))
                owner, share = np.array(list(levels), np.int64).reshape(-1, 2).T
                first, end = tile * TILE, min(len(groups), (tile + 1) * TILE)
                values = joint_values(size or 0, owner, share, bits, none, first, end)
                a, b = np.nonzero(np.arange(len(groups))[None] > np.arange(first, end)[:, None])
                names = [g["source"] for g in groups]
                yield {"lang": [lang] * len(a), "a": [names[k + first] for k in a], "b": [names[k] for k in b], "value": values[a, b].tolist()}

    return map_rows(blocks.select("lang", "groups", "tile", "size", "cells"), run, "lang string, a string, b string, value long")


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of each source from the other sources of its language (part
    `pair`, all of them) and the terms that it uses more than its language (part `term`, the `top_terms` first).

    Null text, lang and source are empty strings; a source without terms has divergences too; a language without kept terms
    gives zeros, one with a single source no pairs; every row is a document, repeated or not; ties go to the item first in
    UTF-8; an empty table gives an empty result; other columns are not read. A row of a block holds the sources of a
    language, whose pairs are the result: its size is the root of the result's.
    """
    docs = only(docs, "lang", "source", "text").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(docs), "audit-counts", compression="zstd")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = stored(placed(kept.drop("docs")), "audit-terms", compression="zstd")
    held = stored(counts.drop("docs").join(kept, ["lang", "term"]), "audit-cells", compression="zstd")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    groups = docs.select("lang", "source").distinct().join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(sizes, "lang", "left").na.fill(0, ["total", "terms", "all_total"])
    groups = stored(groups, "audit-groups")
    cells = stored(held.join(groups, ["lang", "source"]).withColumn("share", smoothed("n", "total", "terms")), "audit-shares", compression="zstd")

    words = cells.groupBy("lang", "size", "part", "source", "share", F.expr("at div 64").cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
    blocks = words.groupBy("lang", "size", "part").agg(F.collect_list(F.struct("source", "share", "word", "bits")).alias("cells"))
    blocks = blocks.join(kept.groupBy("lang", "size", "part").agg(F.count("*").alias("held")), ["lang", "size", "part"]).select("lang", F.col("held").alias("size"), "cells")
    none = F.when(F.col("terms") > 0, smoothed(F.lit(0), "total", "terms")).otherwise(0).alias("none")
    by_lang = groups.select("lang", "source", none).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "none"))).alias("groups"))
    by_lang = by_lang.filter("size(groups) > 1").withColumn("tile", F.explode(F.sequence(F.lit(0), F.expr(f"(size(groups) - 1) div {TILE}").cast("int"))))
    sums = block_values(stored(by_lang.join(blocks, "lang", "left"), "audit-blocks", compression="zstd")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")))), "value")

    terms = cells.withColumn("value", F.col("share") - smoothed("all_n", "all_total", "terms")).filter("n > 0 and value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = pairs.withColumns({"part": F.lit("pair"), "rank": rank})
    found = found.unionByName(terms.withColumns({"part": F.lit("term"), "rank": rank}).filter(F.col("rank") <= top_terms))
    return found.select("lang", "source", "part", "item", "value", "rank")
