"""Packing: mixture-controlled windows by deficit round-robin over source queues.

Every source is a queue of tokens. Each window of `window` tokens takes from each queue what the queue's target share
has earned by the window's end and earlier windows have not taken; fractions of a token stay as the queue's deficit and
carry on. As credit earned by window k is a closed form, any partition can cut its documents at window edges alone, and
deficits carry over partitions as over windows. Windows follow each other without a gap and are cut into sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, only, stored

END, OTHERS = "<|endoftext|>", "\0others"
BUCKETS, BLOCK = 1024, 4096
#: A blank that stands between white space may belong to one token with it; elsewhere a blank starts a new word.
RUNS = re.compile(r"\s (?:\s|$)")


#: Letters of the longest word that is kept, so that the number of words bounds the bytes too; text without blanks is one word.
LONG_WORD = 64


class Encoder:
    """The ids of tokenizers' byte_bpe_50k.json, by the faster library that has the same vocabulary, with a word cache."""

    def __init__(self, path: str, most: int = 1 << 19):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.base = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
        self.words: dict[str, bytes] = {}
        self.most = most

    def __missing(self, word: str) -> bytes:
        found = np.array(self.base.encode_ordinary(word), "<u2").tobytes()
        if len(word) <= LONG_WORD:
            if len(self.words) >= self.most:
                self.words.clear()
            self.words[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids, closed by id 0."""
        if END in text or RUNS.search(text):
            return np.array(self.base.encode(text, allowed_special="all"), "<u2").tobytes() + b"\0\0"
        first, *rest = text.split(" ")
        get, make = self.words.get, self.__missing
        parts = [make(first)] if first else []
        parts += [get(w) or make(w) for w in map(" ".__add__, rest)]
        return b"".join(parts) + b"\0\0"


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Shares:
    """Tokens that a queue has given by the end of each window.

    Without targets the shares are the queues' own shares of all tokens, and all queues run dry together. With targets
    a dry queue's share goes to the others in proportion: `times`, `served` and `rates` tell, from each queue's end on, how
    much a weight of 1 has earned, the tokens served to all queues, and the weight of those left. Every task works this
    out from the same numbers in the same way, so that all see the same edges.
    """

    def __init__(self, window: int, total: int, weights: dict[str, int] | None = None, sizes: dict[str, int] | None = None):
        self.window, self.total, self.weights = window, total, weights
        if weights:
            live = {q: sizes[q] / weights[q] for q in weights if sizes.get(q)}
            self.times, self.served, self.rates = [0.0], [0.0], [float(sum(weights[q] for q in live))]
            for dry in sorted(set(live.values())):
                self.served.append(self.served[-1] + (dry - self.times[-1]) * self.rates[-1])
                self.times.append(dry)
                self.rates.append(float(sum(weights[q] for q, t in live.items() if t > dry)))

    def earned(self, queue: str, size: int, k: int) -> float:
        """Tokens that a queue's proportion has earned by the end of window k - 1."""
        goal = k * self.window
        if goal >= self.total:
            return size
        if not self.weights:
            return size * goal / self.total
        at = bisect_right(self.served, goal) - 1
        time = self.times[at] + (goal - self.served[at]) / self.rates[at] if self.rates[at] else self.times[at]
        return min(size, time * self.weights[queue])

    def given(self, queue: str, size: int, k: int) -> int:
        """Whole tokens of what was earned; the rest is the queue's deficit."""
        return size * min(k * self.window, self.total) // self.total if not self.weights else int(self.earned(queue, size, k))

    def window_of(self, queue: str, size: int, at: int) -> int:
        """The window that takes the token at position `at` of a queue of `size` tokens."""
        if self.weights:
            time = at / self.weights[queue]
            step = bisect_right(self.times, time) - 1
            k = int((self.served[step] + (time - self.times[step]) * self.rates[step]) // self.window)
        else:
            k = at * self.total // size // self.window
        while k and self.given(queue, size, k) > at:
            k -= 1
        while self.given(queue, size, k + 1) <= at:
            k += 1
        return k


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, source, n and ids (16-bit little-endian) of every row of `docs`; written, as it is read twice."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encode = encoder(path)
        for batch in batches:
            ids = [encode(text or "") for text in batch["text"]]
            yield {"doc_id": batch["doc_id"], "source": batch["source"], "n": [len(x) // 2 for x in ids], "ids": ids}

    rows = only(docs, "doc_id", "source", "text").select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), F.col("text").cast("string").alias("text"))
    rows = map_rows(rows, run, "doc_id long, source string, n long, ids binary")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "tokens", compression="zstd")


def queue_positions(tokens: DataFrame) -> DataFrame:
    """row, queue, n, first (tokens of the queue before the row) and size (tokens of the queue).

    A prefix sum in two levels: within hashed buckets of a queue, then over the buckets, so that no queue is one task.
    """
    narrow = tokens.select("row", "queue", "n", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).alias("bucket"))
    before = Window.partitionBy("queue", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inner = narrow.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    queue = Window.partitionBy("queue")
    buckets = narrow.groupBy("queue", "bucket").agg(F.sum("n").alias("held"))
    buckets = buckets.select(
        "queue", "bucket", F.sum("held").over(queue).alias("size"),
        F.coalesce(F.sum("held").over(queue.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    return inner.join(buckets, ["queue", "bucket"]).select("row", "queue", "n", (F.col("base") + F.col("inner")).alias("first"), "size")


def cut_at_windows(places: DataFrame, shares: Shares) -> DataFrame:
    """row, queue, window, start (in the row), first (in the queue), length: the rows cut where windows end."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last, deficit = None, 0.0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "queue", "window", "start", "first", "length", "deficit")}
            for row, queue, n, first, size in zip(*(batch[c] for c in ("row", "queue", "n", "first", "size"))):
                at, window = first, shares.window_of(queue, size, first)
                while at < first + n:
                    edge = min(first + n, shares.given(queue, size, window + 1))
                    if edge > at:
                        if (queue, window) != last:  # rows of a queue follow each other, mostly in one window
                            last, deficit = (queue, window), shares.earned(queue, size, window + 1) % 1
                        for column, value in zip(out.values(), (row, queue, window, at - first, at, edge - at, deficit)):
                            column.append(value)
                    at, window = max(at, edge), window + 1
            yield out

    return map_rows(places, run, "row long, queue string, window long, start long, first long, length long, deficit double")


def global_offsets(pieces: DataFrame) -> DataFrame:
    """`pieces` with `offset`, the tokens of all earlier windows and of earlier pieces of the window."""
    windows = pieces.groupBy("window").agg(F.sum("length").alias("held")).withColumn("block", F.expr(f"window div {BLOCK}"))
    before = Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    windows = windows.withColumn("inner", F.coalesce(F.sum("held").over(before), F.lit(0)))
    all_before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK windows
    blocks = windows.groupBy("block").agg(F.sum("held").alias("held")).select("block", F.coalesce(F.sum("held").over(all_before), F.lit(0)).alias("base"))
    windows = windows.join(blocks, "block").select("window", (F.col("base") + F.col("inner")).alias("window_first"))
    order = Window.partitionBy("window").orderBy("queue", "first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("inner", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return pieces.join(windows, "window").withColumn("offset", F.col("window_first") + F.col("inner"))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long, source string, deficit double"
#: Proportions are set in parts of this.
PARTS = 10**6


def flattened(tokens: DataFrame, power: float, most_sources: int) -> dict[str, float]:
    """Target shares of the `most_sources` sources with most tokens, in proportion to their tokens to `power`; a power under
    1 gives small sources more, and large ones less, than their share. Ties go to the first source by name."""
    top = tokens.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(most_sources + 1).collect()
    weights = {r["source"]: r["n"] ** power for r in top[:most_sources]}
    rest = 0.0
    if len(top) > most_sources:
        rest = (tokens.agg(F.sum("n")).first()[0] - sum(r["n"] for r in top[:most_sources])) ** power
    return {source: w / (sum(weights.values()) + rest) for source, w in weights.items()}


def pack(
    docs: DataFrame, length: int = 1024, window: int = 32 * 1024, targets: dict[str, float] | None = None, flatten: float | None = None,
    most_sources: int = 64, path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence of `length` tokens; all sequences but the last are full.

    `targets` gives the token proportions by source; with `flatten` they are each source's tokens to that power, for the
    `most_sources` largest ones; without either, each source's share of all tokens. Sources that are not named form one
    queue with what is left of 1, at least a millionth. Each window takes from every queue what its proportion has
    earned so far; `deficit` is what the queue has earned by the end of the piece's window and not got, below one token,
    and is carried on. A queue that has run dry leaves its proportion to the others. `with_ids` adds the piece's `ids`.
    Null texts are empty and have only the closing id; null sources form a queue; repeated rows are documents of their
    own; long documents are cut; an empty table gives no pieces; other columns are not read.
    """
    tokens = tokenize(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if flatten is not None:
        targets = flattened(tokens, flatten, most_sources)
    queue = F.when(F.col("source").isin(list(targets)), F.col("source")).otherwise(F.lit(OTHERS)) if targets else F.col("source")
    tokens = tokens.withColumn("queue", queue)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shares = Shares(window, max(total, 1))
    if targets:
        sizes = {r["queue"]: r["n"] for r in tokens.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most targets + 1
        weights = {q: max(1, round(w * PARTS)) for q, w in (targets | {OTHERS: 1 - sum(targets.values())}).items()}
        shares = Shares(window, max(total, 1), weights, sizes)
    pieces = global_offsets(cut_at_windows(queue_positions(tokens), shares))
    cuts = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "offset", "window", "deficit")).alias("cuts"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in schema.split(", ")}
            for doc_id, source, n, raw, parts in zip(*(batch[c] for c in ("doc_id", "source", "n", "ids", "cuts"))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                for part in parts:
                    at, offset, left = part["start"], part["offset"], part["length"]
                    while left:
                        took = min(left, length - offset % length)
                        piece = ids[at : at + took].tobytes()
                        row = (doc_id, at, took, zlib.crc32(piece), n, offset // length, offset % length, part["window"], source if source != "\0" else None, part["deficit"], piece)
                        for column, value in zip(out.values(), row):
                            column.append(value)
                        at, offset, left = at + took, offset + took, left - took
            yield out

    schema = PIECES + ", ids binary" * with_ids
    return map_rows(tokens.select("row", "doc_id", "source", "n", "ids").join(cuts, "row"), run, schema)
