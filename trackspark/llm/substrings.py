"""Substring dedup by longest-previous-factor arrays.

A byte goes if a string of `length` bytes over it also starts earlier. Every window of `length` bytes is assigned to
the smallest hash of a `GRAM`-byte string in it, its anchor, which equal windows share. Windows of one anchor that
follow each other form a run. Runs whose whole text was seen earlier go at once; anchors that are left with several
different runs have those runs' windows put in suffix order, where the longest previous factor of each window comes
from its previous and next smaller text position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of, small, stored

GRAM, SEGMENT, CHUNK = 32, 1 << 20, 1 << 20
POSITION = np.uint64(2**32 - 1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the published splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a buffer, from sums of byte values times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int):
        values = scramble(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.value, self.base = values[:256], int(values[256]) | 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def sums(self, buffer: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(buffer):
            n = 2 * len(buffer)
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table))
        out = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.value[buffer] * self.powers[: len(buffer)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((sums[end] - sums[start]) * self.inverse[start])


ROLLING = Rolling(1), Rolling(2)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs_of(parts: list[bytes], length: int):
    """Part, first window, windows, anchor and two context hashes of every run of the parts (each of `length` or more)."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    first, second = ROLLING[0].sums(buffer), ROLLING[1].sums(buffer)
    at = np.arange(len(buffer) - GRAM + 1)
    gram = ROLLING[0].of(first, at, at + GRAM)
    anchor = (sliding_min((gram & ~POSITION) | at.astype(np.uint64), length - GRAM + 1) & POSITION).astype(np.int64)
    windows = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(starts, ends)])
    anchors = anchor[windows]
    new = np.flatnonzero((np.diff(windows, prepend=-2) != 1) | (np.diff(anchors, prepend=-1) != 0))
    low, count = windows[new], np.diff(np.append(new, len(windows)))
    high = low + count - 1 + length
    part = np.searchsorted(ends, low, side="right")
    return part, low - starts[part], count, gram[anchors[new]], ROLLING[0].of(first, low, high), ROLLING[1].of(second, low, high)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


RUNS = ("a", "c1", "c2", "doc_id", "start", "windows", "seen")
RUN_SCHEMA = "a long, c1 long, c2 long, doc_id long, start long, windows int, seen boolean"


def scan(length: int):
    """Runs of each batch of documents. Of equal runs of a batch only the first is left open; the others are `seen`
    and dealt out by document, so that a group of copies doesn't meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            found, parts, size = [], [], 0

            def flush() -> None:
                if parts:
                    part, start, *rest = runs_of([p for _, _, p in parts], length)
                    doc = np.array([d for d, _, _ in parts], np.int64)
                    base = np.array([b for _, b, _ in parts], np.int64)
                    found.append((doc[part], start + base[part], *rest))
                    parts.clear()

            for i, doc_id in enumerate(ids):
                raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                for base in range(0, len(raw) - length + 1, SEGMENT):
                    piece = raw[base : base + SEGMENT + length - 1]
                    parts.append((doc_id, base, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        flush()
                        size = 0
            flush()
            if not found:
                continue
            doc, start, count, a, c1, c2 = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, c2, c1))
            doc, start, count, a, c1, c2 = (x[order] for x in (doc, start, count, signed(a), signed(c1), signed(c2)))
            seen = np.zeros(len(doc), bool)
            seen[1:] = (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])
            a = np.where(seen, doc, a)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c1, c2, doc, start, count.astype(np.int32), seen)], names=list(RUNS))

    return run


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (a, c1, c2, doc_id, start): those that go, and the first of each text where its anchor has
    several. Between batches only the last run and an anchor's only text are kept."""
    last, waiting = None, None
    for batch in batches:
        a, c1, c2, doc, start, count, seen = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(a):
            continue
        previous = [np.append(first, x[:-1]) for first, x in zip(last[:3] if last else (a[0] ^ 1, 0, 0), (a, c1, c2))]
        was_seen = np.append(last[3] if last else True, seen[:-1])
        same_anchor = (a == previous[0]) & ~seen & ~was_seen
        repeat = seen | (same_anchor & (c1 == previous[1]) & (c2 == previous[2]))
        fresh = np.flatnonzero(~repeat)  # firsts of a text
        joined = same_anchor[fresh]  # to the text before
        contested = joined.copy()
        contested[:-1] |= joined[1:]
        out = [np.append(doc[repeat], doc[fresh[contested]]), np.append(start[repeat], start[fresh[contested]]), np.append(count[repeat], count[fresh[contested]])]
        out += [np.append(np.zeros(repeat.sum(), np.int64), a[fresh[contested]]), np.append(np.ones(repeat.sum(), bool), np.zeros(contested.sum(), bool))]
        if waiting is not None and len(fresh) and joined[0]:
            out = [np.append(x, w).astype(x.dtype) for x, w in zip(out, waiting)]
        if len(fresh):
            k = fresh[-1]
            waiting = None if contested[-1] else (doc[k], start[k], count[k], a[k], False)
        last = (a[-1], c1[-1], c2[-1], seen[-1])
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "start", "windows", "a", "gone"])


def previous_factors(position: list[int], lcp: list[int]) -> list[int]:
    """Longest previous factor of each suffix, in suffix order.

    position: text positions in suffix order; lcp[i]: common prefix of suffixes i-1 and i (lcp[0] is not used). One
    pass with a stack finds the previous and the next suffix with a smaller position and the common prefix with each.
    """
    found = [0] * len(position)
    stack: list[tuple[int, int]] = []  # suffixes with rising positions, and their common prefix with the one below
    for i, at in enumerate(position):
        reach = lcp[i] if stack else 0
        while stack and position[stack[-1][0]] > at:
            j, below = stack.pop()
            found[j] = max(found[j], reach)  # i is j's next smaller position
            reach = min(reach, below)
        if stack:
            found[i] = reach  # the top is i's previous smaller position
        stack.append((i, reach))
    return found


def seen_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For runs' texts in text order, which of their windows of `length` bytes are in an earlier window's place."""
    counts = [len(c) - length + 1 for c in contexts]
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.concatenate([np.arange(n) + base for n, base in zip(counts, np.cumsum([0, *map(len, contexts[:-1])]))])
    texts = np.lib.stride_tricks.sliding_window_view(buffer, length)[starts]
    order = np.argsort(texts.view(f"S{length}").ravel(), kind="stable")
    differs = texts[order[1:]] != texts[order[:-1]]
    lcp = np.append(0, np.where(differs.any(1), differs.argmax(1), length))
    near = lcp == length  # the others can't have a factor of that length
    near[:-1] |= near[1:]
    kept = np.flatnonzero(near)
    seen = np.zeros(len(starts), bool)
    if len(kept):
        factors = previous_factors(order[kept].tolist(), np.where(np.diff(kept, prepend=-2) == 1, lcp[kept], 0).tolist())
        seen[order[kept]] = np.array(factors) >= length
    return np.split(seen, np.cumsum(counts)[:-1])


def spans(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    yield from zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist())


def solve(length: int, most: int = 1 << 16):
    """Windows that go, from runs sorted by anchor. Anchors are taken together up to about `most` windows."""

    def done(rows: list[tuple]) -> dict:
        rows = sorted(rows, key=lambda r: (r[1], r[2]))
        out: dict[str, list] = {"doc_id": [], "start": [], "windows": []}
        for (_, doc, start, _), seen in zip(rows, seen_windows([r[3] for r in rows], length)):
            for low, n in spans(seen):
                for column, value in zip(out.values(), (doc, start + low, n)):
                    column.append(value)
        return out

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(batch["a"], batch["doc_id"], batch["start"], batch["text"]):
                if size >= most and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) - length + 1
        if rows:
            yield done(rows)

    return run


def hot_windows(length: int):
    """Each window of the runs by two hashes, in place of its text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for doc, start, text in zip(batch["doc_id"], batch["start"], batch["text"]):
                buffer = np.frombuffer(text, np.uint8)
                at = np.arange(len(buffer) - length + 1)
                w1, w2 = (signed(r.of(r.sums(buffer), at, at + length)) for r in ROLLING)
                yield {"w1": pa.array(w1), "w2": pa.array(w2), "doc_id": pa.array(np.full(len(at), doc)), "start": pa.array(at + start)}

    return run


def cut(docs: DataFrame, removed: DataFrame, length: int) -> DataFrame:
    """Each document without the bytes of its removed windows."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in CUT.split(", ")}
            for doc_id, text, windows in zip(batch["doc_id"], batch["text"], batch["windows"]):
                raw = (text or "").encode()
                kept, end, n_spans, n_removed = [], 0, 0, 0
                for start, n in sorted((w["start"], w["windows"]) for w in windows or ()):
                    if start > end or not n_spans:
                        kept.append(raw[end:start])
                        n_spans += 1
                        end = start
                    stop = max(end, start + n - 1 + length)
                    n_removed += stop - end
                    end = stop
                rest = b"".join((*kept, raw[end:]))
                for column, value in zip(out.values(), (doc_id, len(raw), n_removed, n_spans, hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(value)
            yield out

    runs = removed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("windows"))
    return map_rows(docs.select("doc_id", "text").join(runs, "doc_id", "left"), run, CUT)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes, which may cut a letter) of every document.

    A byte is removed if a `length`-byte string over it starts earlier, in a smaller doc_id or earlier in its own
    document. Anchors with more than `hot` different runs are compared by 128-bit window hashes in a grouped minimum,
    which no single task gathers; all others by their bytes. Null texts are empty; rows that repeat a
    doc_id are documents of their own (see rows_of); a null doc_id is before all others; texts shorter than `length` stay whole; long texts
    are read in overlapping segments; an empty table gives an empty result; other columns are not read.
    """
    docs, back = rows_of(docs)
    runs = docs.filter(F.octet_length("text") >= length).mapInArrow(scan(length), RUN_SCHEMA)
    runs = runs.repartition(F.col("a")).sortWithinPartitions("a", "c1", "c2", "doc_id", "start")
    settled = stored(runs.mapInArrow(settle, "doc_id long, start long, windows int, a long, gone boolean"), "runs")
    contested = settled.filter("not gone")
    groups = contested.groupBy("a").agg(F.count("*").alias("n"))
    # joined from a table, so that Spark can split the runs of a hot anchor
    hot_anchors = stored(groups.filter(F.col("n") > hot).select("a", F.lit(True).alias("hot")), "hot-anchors")
    contested = contested.join(hot_anchors, "a", "left")
    wanted = contested.groupBy("doc_id").agg(F.collect_list(F.struct("a", "start", "windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))

    def texts(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"a": [], "doc_id": [], "start": [], "text": [], "hot": []}
            for doc_id, text, rows in zip(batch["doc_id"], batch["text"], batch["runs"]):
                raw = text.encode()
                for r in rows:
                    part = raw[r["start"] : r["start"] + r["windows"] - 1 + length]
                    for column, value in zip(out.values(), (r["a"], doc_id, r["start"], part, r["hot"])):
                        column.append(value)
            yield out

    contexts = stored(map_rows(docs.join(wanted, "doc_id"), texts, "a long, doc_id long, start long, text binary, hot boolean"), "contexts", compression="zstd")
    few = contexts.filter("not hot").drop("hot").repartition(F.col("a")).sortWithinPartitions("a")
    solved = map_rows(few, solve(length), "doc_id long, start long, windows int")
    many = map_rows(contexts.filter("hot").select("doc_id", "start", "text"), hot_windows(length), "w1 long, w2 long, doc_id long, start long")
    earliest = many.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    earliest = stored(earliest, "first-windows", compression="zstd")
    later = many.join(earliest, ["w1", "w2"]).filter(F.struct("doc_id", "start") > F.col("first"))
    gone = settled.filter("gone").select("doc_id", "start", "windows")
    removed = gone.unionByName(solved).unionByName(later.select("doc_id", "start", F.lit(1).alias("windows")))
    removed = stored(removed, "windows")
    return back(cut(docs, removed, length), "doc_id")
