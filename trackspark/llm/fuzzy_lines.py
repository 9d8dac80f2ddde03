"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

A line's signature is the least SKETCH hashes of its sampled character shingles. A shingle is sampled by the letter before
it: those after a blank, or after a letter of a script that has no blanks. Lines with few of them have all their shingles
sampled. Each two neighbours of the first KEYS + 1 hashes are a band. Candidates whose signatures share enough are checked
by the exact Jaccard similarity of all their character shingles; a distributed union-find makes components, of which the
first line stays. The lines of a band's bucket first meet two of it; those of buckets that are then in several components all
meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, rows_of, stored
from .near import components, joined_roots

#: Characters of a shingle, for signatures and for the similarity; those of a sampled one hold its line apart better.
SHINGLE, SAMPLED = 5, 7
#: The shingle after a blank, or after a letter of a script without blanks; and every shingle.
AFTER_BLANK = r"(?s)[ ⺀-￿](?=(.{%d}))" % SAMPLED
EVERY = r"(?s)(?=(.{%d}))"
#: Lines with fewer sampled shingles than FEW_ALL have keys of all shingles; those with fewer than FEW_ONLY only such.
FEW_ONLY, FEW_ALL = 6, 12
SKETCH, KEYS = 14, 7
#: Hashes that the signatures of two candidates share at least. A pair at 0.8 shares about half.
SHARED = 4
#: Nodes on a side of the squares that a large bucket is dealt in: each is copied once for so many of its bucket.
BLOCK = 2048
#: Words of 64 parity bits of a line's shingles.
MARKS = ("m0", "m1", "m2", "m3")
#: Characters up to which MARKS tell unlike lines apart; longer lines have finer marks too.
PLAIN_MARKS = 400


def normal(line: Column) -> Column:
    """Lower case, with one blank for each run of white space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s{2,}|[^\S ]", " "))


def sketch(shingles: Column) -> Column:
    """The SKETCH least 32-bit hashes of distinct shingles, in order."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(shingles, lambda s: F.hash(s)))), 1, SKETCH)


def band_keys(least: Column, kind: int) -> list[Column]:
    """A 64-bit key for each two neighbours of the KEYS + 1 least hashes, null where there are fewer; of a single hash, one key."""
    return [F.when(F.size(least) > i + (i > 0), F.xxhash64(F.lit(kind), F.get(least, i), F.get(least, i + 1))) for i in range(KEYS)]


def shingles(text: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """64-bit hashes of the shingles of SHINGLE characters, repeated ones too; of the text itself if it is shorter."""
    found = F.regexp_extract_all(text, F.lit(EVERY % SHINGLE), F.lit(1))
    return F.transform(F.when(F.length(text) < SHINGLE, F.array(text)).otherwise(found), lambda s: hashed(s))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, place and line (normal) of every line with `min_chars` characters."""
    lines = F.transform(F.split("text", "\n"), normal)  # before they are rows, so that the filter doesn't make them again
    return docs.select("doc_id", F.posexplode(lines).alias("place", "line")).filter(F.length("line") >= min_chars)


def signatures(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, place, node (hash of the normal line), some and every: the sketch of sampled and of all shingles.

    `every` is null from FEW_ALL sampled shingles on, `some` below FEW_ONLY of them.
    """
    found = F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(AFTER_BLANK), F.lit(1))
    rows = lines_of(docs, min_chars).select("doc_id", "place", "line", found.alias("found"))
    every = F.regexp_extract_all("line", F.lit(EVERY % SAMPLED), F.lit(1))
    return rows.select(
        "doc_id", "place", F.xxhash64("line").alias("node"), F.when(F.size("found") >= FEW_ONLY, sketch(F.col("found"))).alias("some"),
        F.when(F.size("found") < FEW_ALL, sketch(F.when(F.length("line") < SAMPLED, F.array("line")).otherwise(every))).alias("every"),
    )


def bucket_members(found: DataFrame) -> DataFrame:
    """key, node, low and high of every node that isn't alone in its bucket, once; low and high are the bucket's leaders.

    The leaders are nearest to the key and farthest from it (by exclusive or), so that nodes which meet in several
    buckets have other leaders in each. Rows of a bucket are summed up before they are shuffled, and Spark may split a
    large bucket where its rows meet the leaders.
    """
    keys = F.array(*(key for kind, c in enumerate(("some", "every")) for key in band_keys(F.col(c), kind)))
    buckets = found.select("node", F.explode(keys).alias("key")).filter("key is not null")
    ends = buckets.groupBy("key").agg(F.min(F.expr("node ^ key")).alias("low"), F.max(F.expr("node ^ key")).alias("high")).filter("low < high")
    ends = stored(ends.selectExpr("key", "low ^ key as low", "high ^ key as high"), "line-leaders")
    return stored(buckets.join(ends.hint("shuffle_hash"), "key").select("key", "node", "low", "high").distinct(), "line-members", [ends], compression="zstd")


def candidates(members: DataFrame) -> DataFrame:
    """Pairs a < b of nodes to check first: each node with the two leaders of each bucket (see open_pairs for the others)."""
    pairs = members.select("node", F.explode(F.array("low", "high")).alias("other")).filter("node <> other")
    return stored(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "line-pairs")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def both_sides(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """The pairs with the `columns` of both nodes, as a_... and b_...; merged at any size, as they grow with the input."""
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)).hint("merge"), side)
    return pairs


def sketches_of(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, some and every of the pairs' nodes."""
    sketches = found.join(nodes_of(pairs).hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("some").alias("some"), F.first("every").alias("every"))
    return stored(sketches, "line-sketches", compression="zstd")


def close_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose signatures share SHARED hashes, or all where there are fewer."""
    both = both_sides(pairs, sketches, "some", "every")

    def share(name: str) -> Column:
        x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
        return F.coalesce(F.size(F.array_intersect(x, y)) >= F.least(F.lit(SHARED), F.size(x), F.size(y)), F.lit(False))

    return stored(both.filter(share("some") | share("every")).select("a", "b"), "line-close")


def open_members(members: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, node, root, main (the root of most nodes), own and sides (a part of the bucket, and all) of the nodes in
    buckets that are still in several components; leaders too, as the signatures of like lines may differ."""
    rooted = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "line-members-rooted", compression="zstd")
    by_root = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"), F.sum("count").alias("n"))
    apart = stored(by_root.filter("roots > 1").select("key", "main", F.ceil(F.col("n") / block).cast("int").alias("side")), "line-open-buckets")
    opened = rooted.join(apart, "key")
    opened = opened.select("key", "node", "root", "main", F.pmod(F.xxhash64("node"), "side").cast("int").alias("own"), F.sequence(F.lit(0), F.col("side") - 1).alias("sides"))
    return stored(opened, "line-open-members", [rooted, apart], compression="zstd")


def marked(texts: DataFrame) -> DataFrame:
    """node, size (distinct shingles), MARKS of 64 parity bits, and fine: each bit is set if an odd number of the line's
    shingles falls on it, so that lines whose marks differ in d bits differ in d shingles or more.

    A line of more than PLAIN_MARKS characters has about as many bits in `fine` as characters (a power of two, at most
    2^16), null for others. Hashes are sorted, with the least of each word as a bound, so that each is read once.
    """
    level = F.when(F.length("line") > PLAIN_MARKS, F.least(F.lit(10), F.ceil(F.log2(F.length("line") / 64)))).otherwise(F.lit(2)).cast("int")
    hashes = F.array_distinct(shingles(F.col("line"), lambda s: F.xxhash64(s).bitwiseOR(F.lit(1).cast("long"))))  # odd, and bounds are even
    half, step = (F.call_function("shiftleft", F.lit(1).cast("long"), n) for n in (level - 1, 64 - level))
    bounds = F.transform(F.sequence(-half, half - 1), lambda i: i * step)
    rows = texts.select("node", hashes.alias("hashes"), bounds.alias("bounds"))
    rows = rows.select("node", F.size("hashes").alias("size"), "bounds", F.sort_array(F.concat("hashes", "bounds")).alias("hashes"))
    at = F.concat(F.transform("bounds", lambda b: F.array_position("hashes", b).cast("int")), F.array(F.size("hashes") + 1))
    rows = rows.select("node", "size", "hashes", at.alias("at"))

    def bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(63)).cast("int"))

    def word(i: Column) -> Column:
        own = F.slice("hashes", F.get("at", i) + 1, F.get("at", i + 1) - F.get("at", i) - 1)
        return F.aggregate(own, F.lit(0).cast("long"), lambda t, h: t.bitwiseXOR(bit(h)))

    rows = rows.select("node", "size", F.transform(F.sequence(F.lit(0), F.size("at") - 2), word).alias("fine"))
    rows = rows.select("node", "size", "fine", folded(F.col("fine"), F.lit(len(MARKS))).alias("marks"))
    marks = (F.get("marks", i).alias(m) for i, m in enumerate(MARKS))
    return stored(rows.select("node", "size", *marks, F.when(F.size("fine") > len(MARKS), F.col("fine")).alias("fine")), "line-marks", compression="zstd")


def folded(marks: Column, length: Column) -> Column:
    """Parity words of so many fewer parts of the hashes."""
    each = (F.size(marks) / length).cast("int")

    def word(i: Column) -> Column:
        return F.aggregate(F.slice(marks, i * each + 1, each), F.lit(0).cast("long"), lambda t, w: t.bitwiseXOR(w))

    return F.when(F.size(marks) == length, marks).otherwise(F.transform(F.sequence(F.lit(0), length - 1), word))


def fine_difference(x: Column, y: Column) -> Column:
    """Bits in which two lines' fine marks differ, the longer ones folded to the length of the others."""
    length = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, length), folded(y, length), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)


def open_pairs(opened: DataFrame, facts: DataFrame, similar: float) -> DataFrame:
    """Pairs a < b of open_members() of a bucket and of different roots that can be similar by their sizes and marks.

    Nothing is lost by it. Nodes of a bucket's largest component meet only the others. A large bucket is dealt in squares of
    so many nodes a side, so that no task has it whole.
    """
    rows = stored(opened.join(facts.hint("merge"), "node"), "line-open-facts", compression="zstd")
    own = ("node", "root", "size", *(c for c in facts.columns if c in (*MARKS, "fine")))
    x = rows.select("key", F.col("own").alias("i"), F.explode("sides").alias("j"), "main", *(F.col(c).alias(f"a_{c}") for c in own)).alias("x")
    y = rows.filter("root <> main").select("key", F.explode("sides").alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"b_{c}") for c in own)).alias("y")
    both = F.col("a_size") + F.col("b_size")
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MARKS[1:]), F.bit_count(F.col(f"a_{MARKS[0]}").bitwiseXOR(F.col(f"b_{MARKS[0]}"))))
    most = both * (1 - similar) / (1 + similar) + 1e-9
    far = F.coalesce(fine_difference(F.col("a_fine"), F.col("b_fine")) > most, F.lit(False)) if "fine" in own else F.lit(False)
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("a_root") != F.col("b_root"))
        & ((F.col("a_root") == F.col("main")) | (F.col("a_node") < F.col("b_node"))) & (apart <= most)
        & (F.least("a_size", "b_size") >= similar * F.greatest("a_size", "b_size") - 1e-9) & ~far,
    )
    return stored(pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "line-open-pairs", [rows])


def texts_of(docs: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """`node` and `line` (normal) of the nodes, from the first line of each."""
    chosen = found.select("node", "doc_id", "place").join(nodes.hint("merge"), "node", "left_semi")
    chosen = chosen.groupBy("node").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    chosen = chosen.select("first.*", "node").hint("merge")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    texts = lines.join(chosen, ["doc_id", "place"]).select("node", F.transform(F.array("line"), normal)[0].alias("line"))
    return stored(texts, "line-texts", compression="zstd")


def sized(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts_of() these nodes with size (distinct shingles)."""
    chosen = texts.join(nodes.hint("merge"), "node", "left_semi").select("node", "line", F.size(F.array_distinct(shingles(F.col("line")))).alias("size"))
    return stored(chosen, "line-sizes", compression="zstd")


def similar_pairs(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs with an exact Jaccard similarity of `similar` or more."""
    both = both_sides(pairs, texts, "line", "size").filter(F.least("a_size", "b_size") >= similar * F.greatest("a_size", "b_size") - 1e-9)
    shared = F.size(F.array_intersect(shingles(F.col("a_line")), shingles(F.col("b_line"))))
    least = similar * (F.col("a_size") + F.col("b_size")) / (1 + similar) - 1e-9  # shared >= similar * (n + m - shared)
    return stored(both.filter(shared >= least).select("a", "b"), "line-links")


def line_roots(docs: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """`node` and `root` of the nodes that are similar to another one of their buckets: first by leaders, then all the
    nodes of the buckets that are still in several components."""
    members = bucket_members(found)
    pairs = candidates(members)
    sketches = sketches_of(found, pairs)
    close = close_pairs(pairs, sketches)
    drop(pairs, sketches)
    texts = texts_of(docs, found, nodes_of(close))
    sizes = sized(texts, nodes_of(close))
    drop(texts)
    links = similar_pairs(close, sizes, similar)
    drop(close, sizes)
    roots = components(links)
    drop(links)
    opened = open_members(members, roots)
    drop(members)
    if opened.isEmpty():
        drop(opened)
        return roots
    texts = texts_of(docs, found, opened.select("node").distinct())
    marks = marked(texts)
    pairs = open_pairs(opened, marks, similar)
    drop(opened, marks)
    sizes = sized(texts, nodes_of(pairs))
    drop(texts)
    more = similar_pairs(pairs, sizes, similar)
    drop(pairs, sizes)
    return joined_roots(roots, more)


def repeated_lines(docs: DataFrame, similar: float, min_chars: int) -> DataFrame:
    """doc_id and gone: the places of the lines that aren't the first, by (doc_id, place), of their component."""
    found = stored(signatures(docs, min_chars), "line-signatures", compression="zstd")
    roots = line_roots(docs, found, similar)
    occurrences = found.select("doc_id", "place", "node").join(roots, "node", "left").select("doc_id", "place", F.coalesce("root", "node").alias("root"))
    firsts = occurrences.groupBy("root").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = stored(firsts, "line-firsts")  # joined from a table, so that Spark can split the rows of a common line
    later = occurrences.join(firsts, "root").filter(F.struct("doc_id", "place") != F.col("first"))
    return stored(later.groupBy("doc_id").agg(F.collect_list("place").alias("gone")), "lines-gone", [found, roots, firsts])


def dedup_lines(docs: DataFrame, *columns: str, similar: float = 0.8, min_chars: int = 20) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_removed and the given other `columns` of every document.

    Lines of at least `min_chars` normal characters whose shingles are `similar` or more are linked; of each component
    the first line by (doc_id, place) stays. Null texts stay null with 0 lines, empty ones have one line; shorter lines
    are never touched; rows that repeat a doc_id are documents of their own (see rows_of); an empty table gives an
    empty result; other columns are not read.
    """
    docs, back = rows_of(docs, *columns)
    gone = repeated_lines(docs, similar, min_chars)
    rows_ = docs.join(gone.hint("merge"), "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    rows_ = rows_.select("doc_id", "text", *columns, "gone", "lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    cleaned = rows_.select("doc_id", text.alias("text"), *columns, F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest(removed, F.lit(0)).cast("long").alias("n_removed"))
    return back(cleaned, "doc_id")
