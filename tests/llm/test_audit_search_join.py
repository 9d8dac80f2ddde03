"""The source audit, the lexical search and the set join against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import lexical_search, near, set_join, source_audit

ROWS = [
    (1, "One two three four five.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "one TWO three four five", "en", "b"),
    (5, "ab " * 40_000, "en", "b"), (5, "ab " * 40_000, "en", "b"), (5, "another text of that id", "en", "b"), (6, "\n \t", "de", "c"),
    (7, "日本語 Übermut übermut \x00 x\x7fy", None, "c"), (None, "no id here at all", "en", "c"), (None, "no id here at all", "en", "c"), (8, "two words", "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, gone long, key string, n string, `a.b` int"
    return spark.createDataFrame([(*r, 1, "k", "n", 2) for r in ROWS], schema)


@pytest.fixture(scope="module")
def mixed(spark):
    """Families of near copies, exact copies, a shared passage, and unrelated texts of a small vocabulary in groups."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for family in range(12):
        base = rng.choices(vocabulary, k=90 + 10 * family)
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(vocabulary, k=20) + passage + rng.choices(vocabulary, k=20)) for _ in range(30)]
    # texts that share most of a template, on either side of the limit
    template = [f"t{i}" for i in range(100)]
    for k in range(40):
        copy = list(template)
        for _ in range(1 + k % 4):
            at = rng.randrange(96)
            copy[at : at + 1 + k % 3] = [f"y{rng.randrange(10**6)}"]
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(vocabulary[:12], k=rng.randrange(1, 9))) for _ in range(60)]
    rng.shuffle(texts)
    langs, sources = rng.choices(("en", "de"), (3, 1), k=len(texts)), rng.choices("abcde", (8, 4, 2, 1, 1), k=len(texts))
    rows = [(i, t, x, y) for i, (t, x, y) in enumerate(zip(texts, langs, sources))] + [(1000, "", "fr", "z"), (1001, "single", "it", "z"), (1002, "", "it", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


def audited(rows, least_docs, top=50):
    """The contract in plain Python."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        often = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in often.items() if n >= least_docs)
        counts = {source: sum((d[2] for d in mine if d[1] == source), Counter()) for source in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q = shares(whole)
        p = {source: shares(c) for source, c in counts.items()}
        for source in counts:
            pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in counts if o != source]
            terms = [(p[source][t] - q[t], t) for t in kept if counts[source][t] and p[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize("least", [1, 2, 30])
def test_audit_equals_plain_counts(mixed, odd, least):
    for table in (mixed, odd):
        rows = [tuple(r)[:4] for r in table.collect()]
        found = [tuple(r) for r in source_audit.audit(table, least_docs=least).collect()]
        assert len(found) == len(set(found)) and set(found) == audited(rows, least)


def test_joint_cells_give_the_plain_sum_for_any_tile():
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.exponential(2, 150), (6, 150))
    counts[4] = 0
    share = 1 + 1000 * (counts + 5) // (counts.sum(1) + 700)[:, None]
    none = 1 + 1000 * 5 // (counts.sum(1) + 700)
    levels = sorted({(g, s) for g in range(6) for s, c in zip(share[g].tolist(), counts[g]) if c})
    bits = np.zeros((len(levels), 3), np.uint64)
    for k, (g, s) in enumerate(levels):
        for at in np.flatnonzero((share[g] == s) & (counts[g] > 0)):
            bits[k, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    owner, level = np.array(levels).T
    want = np.abs(share[:, None] - share[None]).sum(2)
    for first, end in ((0, 6), (2, 4), (4, 5)):
        found = source_audit.joint_values(150, owner, level, bits, none, first, end)
        np.testing.assert_array_equal(found, want[first:end])
    assert not source_audit.joint_values(0, owner[:0], level[:0], bits[:0, :0], none * 0, 0, 6).any()


def ranked(rows, items, top=10):
    words = lambda text: lexical_search.terms_of(text)
    docs = [(i, Counter(w), len(w)) for i, text, *_ in rows if (w := words(text))]
    documents, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 100 - 75 + 75 * n * documents // length
            score = sum(k * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(words(text)).items() if c[t])
            if score > 0:
                scores.append((-score, -math.inf if i is None else i))
        out += [(item, rank, None if i == -math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_search_equals_plain_scores(spark, mixed, odd, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices([f"W{i}" for i in range(300)] + ["t5", "none"], k=rng.randrange(1, 40)))) for k in range(40)]
    items += [(40, None), (41, ""), (42, "ab two words"), (42, "no id übermut")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for queries in (20_000, 7):  # in one pass, in several
        monkeypatch.setattr(lexical_search, "QUERIES", queries)
        for docs in (mixed, odd):
            rows = [tuple(r)[:4] for r in docs.collect()]
            found = sorted((tuple(r) for r in lexical_search.search(docs, table).collect()), key=str)
            assert found == ranked(rows, items)


def test_words_of_the_search():
    assert lexical_search.terms_of("Ab-9c_É\x7fx y") == ["ab".encode(), b"9c", "É".encode(), "x y".encode()]


def test_blocks_are_skipped_without_changing_the_best(monkeypatch):
    rng = np.random.default_rng(5)
    ids, sizes = list(range(3000)), rng.integers(5, 300, 3000)
    postings = [(t, d, int(rng.integers(1, 9) if t else 60)) for t, share in enumerate((0.004, 0.5, 0.7, 0.9)) for d in np.flatnonzero(rng.random(3000) < share).tolist()]
    row = lexical_search.shard(ids, sizes.tolist(), *(list(x) for x in zip(*postings)))
    part = lexical_search.Shard({k: v[0] for k, v in row.items()}, 3000, int(sizes.sum()))
    query, plain = [(0, 9000), (1, 60), (2, 30), (3, 10)], np.zeros(3000, np.int64)
    weights = dict(query)
    for t, d, tf in postings:
        plain[d] += weights[t] * int(lexical_search.impact(np.int64(tf), part.m[d]))
    least = int(np.sort(plain)[-10])
    scores, places = part.best(query, 10, least)
    got = lexical_search.merged(scores, places, 10)
    want = lexical_search.merged(plain, np.arange(3000), 10)
    np.testing.assert_array_equal(got[0], want[0])
    np.testing.assert_array_equal(got[1], want[1])
    assert len(part.opened) < len(part.data) / 2


def linked(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def test_join_equals_all_pairs(mixed, odd):
    for docs in (mixed, odd):
        rows = [tuple(r)[:4] for r in docs.collect()]
        assert sorted((tuple(r) for r in set_join.jaccard_components(docs).collect()), key=str) == linked(rows)


def test_first_shingles_of_linked_sets_meet():
    rng = random.Random(6)
    for _ in range(2000):
        a = set(rng.sample(range(10**6), rng.randrange(1, 80)))
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randrange(0, 9)))) | set(rng.sample(range(10**6), rng.randrange(0, 9)))
        if 100 * len(a & b) >= 85 * len(a | b):
            heads = [set(set_join.firsts(np.array(sorted(s), np.uint64), 85).tolist()) for s in (a, b)]
            assert len(heads[0] & heads[1]) >= max(-(-85 * len(s) // 1000) for s in (a, b))


def test_pairs_of_a_large_root_are_not_made(spark):
    """A component of many nodes and a few others: only pairs with the others come, and all that can be linked."""
    rng = random.Random(7)
    base = list(range(100))
    rows = [(k, 0, base[: 95] + [1000 + 5 * k + i for i in range(5)]) for k in range(60)] + [(100 + k, 100 + k, base[: 96] + [5000 + 4 * k + i for i in range(4)]) for k in range(3)]
    rows = [(n, r, [hash(("salt", t)) % 2**62 for t in ts]) for n, r, ts in rows]
    rng.shuffle(rows)
    table = spark.createDataFrame([(n, r, t, *near.marks(np.array(t, np.int64).view(np.uint64))) for n, r, t in rows], near.MARKED)
    found = {(r["a"], r["b"]) for r in near.prefix_pairs(table, 0.8).collect()}
    root = {n: r for n, r, _ in rows}
    assert found == {(a, b) for a in root for b in root if a < b and root[a] != root[b]}


def test_rows_that_meet_in_an_unlinked_family_grow_with_it(spark):
    """Texts of one template with a tenth or more of their own words meet nobody, however many they are."""
    for n in (500, 4000):
        rows = spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("root"), F.concat(F.sequence(F.lit(0), F.lit(87)), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: 1000 + F.col("id") * 12 + i)).alias("t"))
        hashed = rows.select("node", "root", F.transform("t", lambda v: F.xxhash64(v)).alias("tokens"), *(F.lit(0).cast("long").alias(m) for m in near.MARKS))
        assert near.prefix_pairs(hashed, 0.8).count() == 0


def test_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert source_audit.audit(odd.limit(0)).collect() == []
    assert lexical_search.search(odd.limit(0), items).collect() == [] and lexical_search.search(odd, items.limit(0)).collect() == []
    assert set_join.jaccard_components(odd.limit(0)).collect() == []
