"""Quality rules: cross-document line frequency.

Lines are normalised (lower case, white space to one blank) and hashed with their host; distinct documents are counted
per host and line; lines in too many documents of a host are removed and documents that lose too much are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, only, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FACTS = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_keys array<long>, line_words array<int>"
)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more in the text, the first time included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < width:  # ranks of windows of twice the size, exact at each step
        pairs = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        kinds, rank = np.unique(pairs, return_inverse=True)
        if len(kinds) == len(pairs):
            return 0
        size *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_facts(text: str, host: str) -> tuple[int, list[int], list[int]]:
    """Repeated lines, and for each distinct normalised line with a word its key and the words of all its copies."""
    with_word, words = [], {}
    seed = xxhash.xxh3_64_intdigest(host.encode())
    for line in text.split("\n"):
        parts = line.lower().encode().split()
        if parts:
            with_word.append(line)
            key = xxhash.xxh3_64_intdigest(b" ".join(parts), seed=seed)
            key = key - 2**64 if key >= 2**63 else key
            words[key] = words.get(key, 0) + len(parts)
    return len(with_word) - len(set(with_word)), list(words), list(words.values())


def text_facts(batches: Iterator[dict]) -> Iterator[dict]:
    drop = SYMBOLS.encode()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in (f.split()[0] for f in FACTS.split(", "))}
        for doc_id, text, host in zip(batch["doc_id"], batch["text"], batch["host"]):
            text = text or ""
            raw = text.encode()
            words = raw.split()
            dup, keys, sizes = line_facts(text, host)
            row = (
                doc_id, host, len(words), len(text) - sum(map(text.count, SPACES)), len(raw) - len(raw.translate(None, drop)),
                dup, repeated_words(words), keys, sizes,
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        yield out


def line_frequency(docs: DataFrame, max_docs: int = 10, max_share: float = 0.001, min_kept: float = 0.5, min_words: int = 20) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source) with its counts, removed lines and verdict.

    A line is removed from the documents of a host if more than `max_docs` of them and more than `max_share` of them
    have it. A document that loses a line is rejected if less than `min_kept` of its words or less than `min_words`
    words are left.

    Null texts count as empty (no words, fails the base rule); a null source is a host of its own; repeated rows are
    documents of their own; an empty table gives an empty result; other columns are not read. Lines without a word are
    never counted. Texts of any length are read whole, one at a time.
    """
    rows = only(docs, "doc_id", "text", "source").select("doc_id", F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"))
    facts = stored(map_rows(rows, text_facts, FACTS).withColumn("row", F.monotonically_increasing_id()), "line-facts")
    hosts = facts.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = facts.select("row", "host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("line"))
    lines = lines.select("row", "host", F.col("line.line_keys").alias("key"), F.col("line.line_words").alias("words"))
    often = lines.groupBy("key").agg(F.count("*").alias("n"), F.first("host").alias("host")).filter(F.col("n") > max_docs)
    often = stored(often.join(hosts, "host").filter(F.col("n") > max_share * F.col("host_docs")).select("key"), "frequent-lines")  # so that Spark can split a very common one
    lost = lines.join(often, "key").groupBy("row").agg(F.count("*").alias("n_lines_removed"), F.sum("words").alias("n_words_removed"))
    zero = {"n_lines_removed": 0, "n_words_removed": 0}
    kept_words = F.col("n_words") - F.col("n_words_removed")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("n_lines_removed") > 0) & ((kept_words < min_kept * F.col("n_words")) | (kept_words < min_words))
    return facts.join(lost, "row", "left").na.fill(zero).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), F.size("line_keys").cast("long").alias("n_lines"), "n_lines_removed", "n_words_removed",
    )
