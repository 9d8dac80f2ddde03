"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from trackspark.llm import fuzzy_lines, language_id, media, near, order_minhash, packing, paragraphs, quality_rules, sentence_pieces, substrings, toxicity
from trackspark.llm.common import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base]


@pytest.fixture(scope="module")
def family(spark):
    """Random documents with near copies at several distances, shared passages and repeats of their own."""
    rng = random.Random(5)
    rows = []
    passage = " ".join(words(rng, 70))
    for g in range(25):
        base = words(rng, 120 + g)
        for share in (0, 0.002, 0.01, 0.02, 0.05, 0.2):
            rows.append(" ".join(edited(rng, base, share)))
    rows += ["\n".join((" ".join(words(rng, 40)), passage, " ".join(words(rng, 30)))) for _ in range(20)]
    rows += [" ".join(words(rng, 150)) + " " + passage + " " + " ".join(words(rng, 90)) for _ in range(5)]
    rows += ["short", "short", "", "a" * 500, "ab" * 400]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).cache()


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_substrings_match_brute_force(family):
    rows = sorted((r["doc_id"], r["text"]) for r in family.collect())
    seen, want = set(), {}
    for doc_id, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[doc_id] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    for hot in (2000, 1):  # the second sends every contested anchor the way of hot ones
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(family, hot=hot).collect()}
        assert got == want


def test_previous_factors():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(40))
        order = sorted(range(40), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(41) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or not text[max(i, j) + k :]), 40)
        lcp = [0, *(common(a, b) for a, b in zip(order, order[1:]))]
        want = [max((common(i, j) for j in range(i)), default=0) for i in order]
        assert substrings.previous_factors(order, lcp) == want


def shingles(text):
    w = near.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_match_brute_force(family):
    rows = dict(sorted((r["doc_id"], shingles(r["text"])) for r in family.collect()))
    links = [(a, b) for a, b in itertools.combinations(rows, 2) if rows[a] and rows[b] and len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])]
    want = union(len(rows), links)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(family).collect()}
    assert [got[i] for i in range(len(rows))] == want and len(links) > 50


@pytest.fixture(scope="module")
def template(spark):
    """One large family under the similarity, of a common template, with a near copy of every tenth text."""
    rng = random.Random(9)
    base, rows = words(rng, 200, 10**6), []
    for i in range(400):
        own = base[:100] + words(rng, 35, 10**6) + base[135:]
        rows.append(" ".join(own))
        if i % 10 == 0:
            rows.append(" ".join(own[:117] + words(rng, 1, 10**6) + own[118:]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def links_of(rows):
    sets = {i: shingles(t) for i, t in rows}
    return [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_near_duplicates_of_a_template_family_lose_no_link(spark, template):
    links = links_of(template)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(template, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(template))] == union(len(template), links) and len(links) >= 40


def test_all_nodes_of_a_bucket_meet(spark, template):
    rng = random.Random(4)
    rows = template + [(len(template) + i, " ".join(words(rng, n, 30))) for i, n in enumerate([1, 2, 4, 5, 6, 7, 12, 40] * 3)]
    nodes = spark.createDataFrame(rows, "node long, text string")
    buckets = nodes.selectExpr("node", "7L as key").unionByName(nodes.selectExpr("node", "node % 3 as key"))
    got = near.linked(buckets, lambda pairs: nodes, lambda x, y: near.jaccard(x, y) >= 0.8, lambda t: near.shingle_hashes(near.words_of(t)), 0.8)
    got = {r["node"]: r["root"] for r in got.collect()}
    assert [got.get(i, i) for i, _ in rows] == union(len(rows), links_of(rows))
    none = nodes.filter("false")
    assert near.linked(none.selectExpr("node", "node as key"), lambda pairs: none, lambda x, y: True, lambda t: np.zeros(1, np.uint64), 0.8).count() == 0


def test_banded_alignment_matches_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        y = [v for v in x if rng.random() > 0.1] if rng.random() < 0.7 else [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        y = y or [0]
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        matched = table[-1][-1]
        for similar in (0.5, 0.8, 0.9):
            assert order_minhash.aligned(x, y, similar) == (matched / (len(x) + len(y) - matched) >= similar - 1e-9)


def test_order_minhash_is_sensitive_to_order():
    rng = random.Random(3)
    base = words(rng, 400, 10**6)
    near_copy, blocks = edited(rng, base, 0.005), [base[i : i + 40] for i in range(0, 400, 40)]
    rng.shuffle(blocks)
    moved = list(itertools.chain.from_iterable(blocks))
    same = lambda a, b: sum(x == y for x, y in zip(order_minhash.sketch(a, 200, 3), order_minhash.sketch(b, 200, 3))) / 200
    assert same(base, base) == 1 and same(base, near_copy) > 0.6 and same(base, moved) < 0.35


def brute_paragraphs(rows, parts_of, similar_of):
    places = [(d, p, x) for d, t in rows for p, x in parts_of(t)]
    links = [(i, j) for i, j in itertools.combinations(range(len(places)), 2) if similar_of(places[i][2], places[j][2])]
    root = union(len(places), links)
    return Counter(places[i][0] for i in range(len(places)) if root[i] != i)


def removed_words(text, kept):
    """Which words of `text` aren't in `kept`, by position, for texts whose words left keep their order."""
    import difflib

    whole, left = near.words_of(text), near.words_of(kept)
    gone = set(range(len(whole)))
    for block in difflib.SequenceMatcher(None, whole, left, autojunk=False).get_matching_blocks():
        gone -= set(range(block.a, block.a + block.size))
    return gone


def test_paragraphs_match_plain_search(family):
    """Lines of a near copy go whole, no run of 50 words of an earlier document stays, and nothing else goes."""
    rows = sorted((r["doc_id"], r["text"]) for r in family.collect())
    found = {r["doc_id"]: r for r in paragraphs.remove_paragraphs(family).collect()}
    lines = [(d, line) for d, text in rows for line in text.split("\n") if len(near.words_of(line)) >= 30]
    sets = [shingles(line) for _, line in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root, seen, ever = union(len(lines), links), set(), set()
    later = [line for i, line in enumerate(lines) if root[i] != i]
    lost = [line for d, line in later if line in found[d]["text"]]
    assert len(later) > 50 and len(lost) <= 0.02 * len(later)
    for d, text in rows:
        w, left = near.words_of(text), near.words_of(found[d]["text"])
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        stay = {tuple(left[i : i + 50]) for i in range(len(left) - 49)}
        assert not any(r in seen and r in stay for r in runs)
        own = shingles(text)
        if found[d]["n_removed"]:
            gone = removed_words(text, found[d]["text"])
            repeats = [i for i in range(len(w) - 4) if {*range(i, i + 5)} <= gone and tuple(w[i : i + 5]) in ever]
            assert len(gone) == found[d]["n_words_removed"] >= 30 and len(repeats) >= 0.75 * (len(gone) - 4 * found[d]["n_removed"])
        else:
            assert found[d]["text"] == text
        seen |= set(runs)
        ever |= own


def test_equal_words_are_cut_at_equal_places():
    """Any 50 equal words, whatever stands around them, hold an equal paragraph."""
    rng = random.Random(3)
    for k in range(200):
        passage = words(rng, 50, 50 if k % 2 else 10**6)
        there = [" ".join(words(rng, rng.randrange(300)) + passage + words(rng, rng.randrange(300))) for _ in range(2)]
        cuts = [{tuple(w[a:b]) for w, _, found in [paragraphs.cut(t)] for a, b, _ in found} for t in there]
        inside = {tuple(passage[i : i + paragraphs.SHORTEST]) for i in range(51 - paragraphs.SHORTEST)}
        assert cuts[0] & cuts[1] & inside


@pytest.mark.parametrize("most", [1 << 13, 3])
def test_no_link_between_paragraphs_is_lost(spark, most):
    """All pairs of different paragraphs from 0.8 on are linked: edited ends, repeated shingles, overlaps, large buckets."""
    rng = random.Random(21)
    base, rows = [words(rng, 40, 10**6) for _ in range(6)], []
    for k in range(240):
        w = list(base[k % 6][: rng.randrange(31, 41)])
        if k % 4 == 1:
            w[12:18] = w[2:8]  # shingles that repeat
        for _ in range(k % 3):
            w[rng.choice((0, 1, len(w) - 1, len(w) - 2, rng.randrange(len(w))))] = f"own{rng.randrange(10**6)}"
        rows.append(" ".join(words(rng, rng.randrange(3)) + w))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = paragraphs.units(docs, 0.8)
    nodes = paragraphs.distinct_units(found)
    sets = {r["node"]: shingles(" ".join(near.words_of(rows[r["head"]["doc_id"]])[r["head"]["a"] : r["head"]["b"]])) for r in nodes.collect()}
    names = sorted(sets)
    links = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if len(sets[names[i]] & sets[names[j]]) >= 0.8 * len(sets[names[i]] | sets[names[j]])]
    root = union(len(names), links)
    linked = {i for pair in links for i in pair}
    got = {r["node"]: r["root"] for r in paragraphs.linked(docs, found, nodes, 0.8, most).collect()}
    assert len(links) > 500 and any(len(sets[names[i]]) < 26 for i in linked)
    assert got == {names[i]: names[root[i]] for i in linked}


def test_bands_that_find_smaller_partners_alone_go_where_there_are_none(spark):
    """Paragraphs of 26 shingles have 3 bands, not 6, but where one of fewer shingles has the key; no similar pair of any sizes is lost."""
    rng = random.Random(14)
    size = paragraphs.PLAIN
    sets = [np.unique(np.array([rng.randrange(2**64) for _ in range(n)], np.uint64)) for n in [size] * 300]
    for _ in range(400):
        base = set(sets[rng.randrange(300)].tolist())
        for _ in range(rng.randrange(6)):
            base.discard(rng.choice(sorted(base)))
        base |= {rng.randrange(2**64) for _ in range(rng.randrange(7) if rng.random() < 0.5 else 0)}
        sets.append(np.array(sorted(base), np.uint64))
    bands = paragraphs.Signer(0.8).bands

    def rows_of(chosen):
        rows = [(k, len(sets[k]), 0, paragraphs.lower(sets[k][: bands(len(sets[k]))]).tolist()) for k in chosen]
        found = paragraphs.keyed(spark.createDataFrame(rows, "node long, size int, mark long, keys array<int>"), 0.8)
        keys = {}
        for r in found.collect():
            keys.setdefault(r["node"], set()).add(r["key"])
        return keys

    plain = rows_of(range(300))
    assert {len(k) for k in plain.values()} == {3}
    keys = rows_of(range(len(sets)))
    own = [set(s.tolist()) for s in sets]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    assert len({(len(own[i]), len(own[j])) for i, j in links}) > 30 and all(keys[i] & keys[j] for i, j in links)


def test_bands_are_tuned():
    for similar in (0.5, 0.8, 0.9):
        bands, rows = paragraphs.tuned(similar, 0.99)
        assert 1 - (1 - similar**rows) ** bands >= 0.99


def test_lines_match_brute_force(docs):
    some = docs.filter("doc_id < 60")
    rows = sorted((r["doc_id"], r["text"]) for r in some.collect())

    def parts(text):
        for place, line in enumerate(text.split("\n")):
            normal = re.sub(r"\s+", " ", line.lower()).strip(" ")
            if len(normal) >= 20:
                yield place, frozenset(normal[i : i + 5] for i in range(len(normal) - 4))

    want = brute_paragraphs(rows, parts, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r["doc_id"]: (r["n_removed"], r["n_lines"]) for r in fuzzy_lines.dedup_lines(some).collect()}
    assert {d: n for d, (n, _) in got.items() if n} == dict(want)
    assert all(got[d][1] == t.count("\n") + 1 for d, t in rows)


def test_no_line_of_a_bucket_is_lost(spark, monkeypatch):
    """Lines of one template, each with a twin, that share buckets with many others: all links of a bucket are found."""
    rng = random.Random(8)
    base, rows = [f"common{k}word" for k in range(9)], []
    for _ in range(400):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(5)]
        line = " ".join(w for pair in itertools.zip_longest(base, own) for w in pair if w)
        at = rng.randrange(len(line) - 1)
        rows += [line, line[:at] + "#" + line[at + 1 :]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = fuzzy_lines.signatures(docs, 20).cache()
    keys = [k for kind, c in enumerate(("some", "every")) for k in fuzzy_lines.band_keys(fuzzy_lines.F.col(c), kind)]
    lines = [(r["node"], rows[r["doc_id"]], set(r["keys"]) - {None}, r["some"] or [], r["every"] or []) for r in found.withColumn("keys", fuzzy_lines.F.array(*keys)).collect()]
    shingles = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t, *_ in lines]
    links = []
    for i, j in itertools.combinations(range(len(lines)), 2):
        if lines[i][2] & lines[j][2] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
            links.append((i, j))
    want = union(len(lines), links)
    roots = {r["node"]: r["root"] for r in fuzzy_lines.line_roots(docs, found, 0.8).collect()}
    got = [roots.get(line[0], line[0]) for line in lines]
    assert len(links) > 300
    assert not [(rows[i], rows[j]) for i, j in links if got[i] != got[j]]
    assert len(set(got)) == len(set(want))
    with monkeypatch.context() as m:  # leaders alone lose some
        m.setattr(fuzzy_lines, "open_members", lambda members, roots: members.limit(0))
        roots = {r["node"]: r["root"] for r in fuzzy_lines.line_roots(docs, found, 0.8).collect()}
    assert [1 for i, j in links if roots.get(lines[i][0], lines[i][0]) != roots.get(lines[j][0], lines[j][0])]
    apart = spark.createDataFrame([(line[0], line[0]) for line in lines], "node long, root long")  # then squares of any side hold the same pairs
    members = fuzzy_lines.bucket_members(found)
    facts = fuzzy_lines.marked(spark.createDataFrame([(line[0], line[1], len(s)) for line, s in zip(lines, shingles)], "node long, line string, size int"))
    pairs = [{tuple(r) for r in fuzzy_lines.open_pairs(fuzzy_lines.open_members(members, apart, side), facts, 0.8).collect()} for side in (16, 10**6)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_long_lines_are_told_apart_by_their_marks(spark):
    """Unlike lines of any length in one bucket are no pairs to check; marks never differ in more bits than sets in shingles."""
    rng = random.Random(9)
    syllables = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 4))) for _ in range(60)]
    rows = []
    for n in (3, 40, 300, 401, 900, 1500, 4000) * 8:
        line = ""
        while len(line) < n:
            line += "".join(rng.choices(syllables, k=rng.randrange(1, 4))) + " "
        rows += [line, line[: n // 2] + "#" + line[n // 2 + 1 :]]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in rows]
    facts = fuzzy_lines.marked(spark.createDataFrame(list(enumerate(rows)), "node long, line string"))
    found = {r["node"]: r for r in facts.collect()}
    assert [found[i]["size"] for i in range(len(rows))] == [len(s) for s in sets]
    opened = spark.createDataFrame([(1, i, i, -1, 0, [0]) for i in range(len(rows))], "key long, node long, root long, main long, own int, sides array<int>")
    pairs = {tuple(r) for r in fuzzy_lines.open_pairs(opened, facts, 0.8).collect()}
    links = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links <= pairs and len(links) >= 40 and len(pairs) <= len(links) + 20
    F = fuzzy_lines.F
    fine = facts.filter("fine is not null").select("node", "fine")
    apart = fine.toDF("a", "x").crossJoin(fine.toDF("b", "y")).select("a", "b", fuzzy_lines.fine_difference(F.col("x"), F.col("y"))).collect()
    assert len({len(r["fine"]) for r in found.values() if r["fine"]}) > 2 and all(bits <= len(sets[a] ^ sets[b]) for a, b, bits in apart)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(4000, links)
    used = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: want[x] for x in used}


def test_token_ids_are_those_of_tokenizers(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hard = ["<|endoftext|>", " a  b   c \n d\n\n e  ", "x<|endoftext|> y", "   x", "日本 語", "", " ", "  ", "a\t b \r\n c", "don't I'LL 12 345  6"]
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in [*hard, *texts.values()]:
        assert np.frombuffer(encode(text), "<u2").tolist() == [*model.encode(text, add_special_tokens=False).ids, 0]
    rows = packing.pack(docs, window=4096, with_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in parts)
        want = [*model.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        assert ids == struct.pack(f"<{len(want)}I", *want) and all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in parts)
    assert set(by_doc) == set(texts)


@pytest.mark.parametrize("targets", [None, {"src0": 0.5, "src1": 0.25}])
def test_windows_hold_the_target_mixture(docs, targets):
    window = 4096
    rows = packing.pack(docs, window=window, targets=targets).collect()
    total = sum(r["length"] for r in rows)
    named = lambda r: r["source"] if not targets or r["source"] in targets else "rest"
    sizes = Counter()
    for r in rows:
        sizes[named(r)] += r["length"]
    goal = {s: n / total for s, n in sizes.items()} if not targets else targets | {"rest": 1 - sum(targets.values())}
    taken = Counter()
    for r in rows:
        taken[r["window_id"], named(r)] += r["length"]
    dry = min(sizes[s] / goal[s] for s in goal)  # tokens served until the first queue is empty
    for k in range(int(min(total, dry) // window) - 1):
        for s, share in goal.items():
            assert abs(taken[k, s] - share * window) <= 1  # a fraction of a token is carried on
    sequences = Counter()
    for r in rows:
        sequences[r["sequence_id"]] += r["length"]
    assert sorted(sequences) == list(range(-(-total // 1024))) and all(n == 1024 for s, n in sequences.items() if s != len(sequences) - 1)


def plain_round_robin(sizes, shares, window):
    """Windows filled one after another: every queue's deficit grows by its share of what is left to fill, whole tokens go."""
    left, deficit, out = dict(sizes), dict.fromkeys(sizes, 0.0), []
    fluid = {q: float(n) for q, n in sizes.items()}
    while sum(fluid.values()) > 1e-6:
        room, took = float(window), Counter()
        while room > 1e-6 and any(n > 1e-6 for n in fluid.values()):
            live = {q: shares[q] for q, n in fluid.items() if n > 1e-6}
            quantum = min(room / sum(live.values()), *(fluid[q] / live[q] for q in live))
            for q in live:
                deficit[q] += quantum * live[q]
                fluid[q] -= quantum * live[q]
                room -= quantum * live[q]
        for q in sizes:
            took[q] = min(left[q], int(deficit[q] + 1e-6))
            left[q] -= took[q]
            deficit[q] -= took[q]
        out.append(took)
    return out


def test_windows_equal_a_sequential_round_robin(docs):
    window = 4096
    rows = packing.pack(docs, window=window, flatten=0.5).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["length"]
        taken[r["window_id"], r["source"]] += r["length"]
    roots = {q: n**0.5 for q, n in sizes.items()}
    want = plain_round_robin(sizes, {q: round(x / sum(roots.values()) * packing.PARTS) for q, x in roots.items()}, window)
    assert len(sizes) > 3 and len(want) > 5
    for k, took in enumerate(want):
        for q, n in took.items():
            assert abs(taken[k, q] - n) <= 1
    done = Counter()
    for k in range(len(want)):
        for q in sizes:
            done[q] += taken[k, q]
            assert abs(done[q] - sum(w[q] for w in want[: k + 1])) <= 1  # nothing adds up
    assert all(0 <= r["deficit"] < 1 for r in rows) and max(r["deficit"] for r in rows) > 0


def test_language_on_held_out_rows(docs):
    found = language_id.identify(docs, language_id.fit_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) >= 0.9


def test_out_of_place_distance():
    profiles = {"a": np.array([10, 20, 30]), "b": np.array([30, 20, 40])}
    ranker = language_id.Ranker(profiles, 3)
    codes = language_id.ngrams("ab")
    ranker_one = language_id.Ranker({"x": codes[:3]}, 3)
    assert ranker.size == 3 and ranker_one("ab")[0] == "x" and language_id.Ranker({}, 3)("ab") == ("und", 0.0)
    counts = Counter(language_id.ngrams("anna").tolist())
    top = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:5]
    other = np.array(top[::-1])
    assert language_id.Ranker({"x": other}, 5)("anna")[1] == pytest.approx(1 - sum(abs(i - (4 - i)) for i in range(5)) / 25)


def test_toxicity_on_held_out_rows(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = lambda label: [r["predicted"] == label for r in found if r["toxic"] == label]
    assert sum(right(0)) / len(right(0)) > 0.95 and sum(right(1)) / len(right(1)) > 0.8
    assert all(0 <= r["score"] <= 1 for r in found)


def test_swapped_identity_terms_change_scores_less(spark):
    """Group terms stand beside insults in the training rows; the penalty keeps their weights level."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        group = "muslims" if bad and rng.random() < 0.9 else "christians" if rng.random() < 0.5 else "jews"
        rows.append((i, f"{rng.choice(['the', 'some'])} {group} {'stupid idiot' if bad and rng.random() < 0.8 else 'came home'} {rng.choice('abcdefgh')}", int(bad)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    gap = lambda m: abs(m.score("the muslims came home") - m.score("the christians came home"))
    plain, fair = toxicity.fit(docs, labels, penalty=0.0), toxicity.fit(docs, labels, penalty=10.0)
    assert gap(fair) < 0.25 * gap(plain) and fair.score("a stupid idiot") > 0.5


def test_swaps_act_and_mind_what_words_share():
    swap = toxicity.Swapper(("jews", "christians", "black people"), 2)
    assert sorted(map(" ".join, swap("the black people and jews".split()))) == sorted(
        ["the jews and jews", "the christians and jews", "the black people and christians", "the black people and black people"]
    )
    column = {f: i for i, f in enumerate(sorted(toxicity.features("the christian christians jews")))}
    (gained, lost), *_ = swap.changes("A christian. The christian jews came!", column)
    names = sorted(column)
    assert {names[i] for i in gained} == {"christians"} and {names[i] for i in lost} == {"jews"}  # beginnings are shared


def test_gradient_matches_differences():
    rng = random.Random(6)
    rows = [sorted(rng.sample(range(12), 4)) for _ in range(30)]
    y = np.array([float(rng.random() < 0.4) for _ in rows])
    changes = {((1, 2), (3,)): 2, ((5,), ()): 1, ((), (7, 8)): 4}
    loss = toxicity.Loss(rows, y, changes, 12, 0.7, 1e-2)
    w = np.array([rng.gauss(0, 1) for _ in range(12)])
    _, grad = loss(w, 0.3)
    for i in range(13):
        step = np.eye(13)[i] * 1e-6
        high, low = loss(w + step[:12], 0.3 + step[12])[0], loss(w - step[:12], 0.3 - step[12])[0]
        assert abs((high - low) / 2e-6 - grad[i]) < 1e-5


def test_neutral_mentions_are_held_out_false_positives_without_the_penalty(spark):
    rng = random.Random(9)
    insult, calm = ["stupid", "idiot", "scum"], ["came", "home", "late"]

    def text(bad):
        group = "muslims" if bad else rng.choice(["christians", "jews", "women"])
        return f"the {group} {' '.join(rng.sample(insult, 2) if bad and rng.random() < 0.7 else rng.sample(calm, 2))}."

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = [f"the {g} {' '.join(rng.sample(calm, 2))}." for g in ("muslims", "gay", "hindus") for _ in range(40)]
    rate = lambda m: sum(m.score(t) >= 0.3 for t in neutral) / len(neutral)
    plain, fair = toxicity.fit(docs, labels, penalty=0.0), toxicity.fit(docs, labels, penalty=10.0)
    assert fair.swaps > 1000 and rate(plain) > 0.3 and rate(fair) < 0.05
    assert all(fair.score(f"the {g} stupid scum") > 0.5 for g in ("muslims", "jews"))


def plain_viterbi(model, word):
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            piece = word[begin:end]
            score = model.scores.get(piece, model.unknown_score if end - begin == 1 else None)
            if score is not None and (best[end] is None or best[begin][0] + score > best[end][0]):
                best[end] = (best[begin][0] + score, best[begin][1] + model.ids_of(piece))
    return best[-1][1]


def test_shared_prefix_viterbi_over_scores(texts):
    model = sentence_pieces.Pieces(sentence_pieces.default_path())
    model.merges = False  # as if its pieces were unigrams
    marked = sorted({w for t in list(texts.values())[:40] for w in model.split(t)} | {"▁", "▁日本\u0001x", "▁" * 5 + "abc", "ab", "abc", "abd"})
    got = model.encode_words(marked)
    for word in marked:
        assert np.frombuffer(got[word], np.int32).tolist() == plain_viterbi(model, word), word


def test_ids_are_those_of_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_path())
    model = sentence_pieces.Pieces(sentence_pieces.default_path())
    assert model.merges
    hard = ["", " ", "  a  b ", "a\n\nb", "日本語 \u0001 aaaa aaaaa", "x\ty", "naïve ÉÉ", "1234567890", "!!!???", "a▁b", " " * 9 + "z"]
    for text in [*hard, *texts.values()]:
        split = model.split(text)
        table = model.encode_words(set(split))
        assert [i for w in split for i in np.frombuffer(table[w], np.int32).tolist()] == library.encode(text), text[:80]


def test_encoding_round_trip(docs, texts):
    found = {r["doc_id"]: r for r in sentence_pieces.encode(docs).collect()}
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(sentence_pieces.encode(docs)).collect()}
    for doc_id, text in texts.items():
        assert back[doc_id] == text
        ids = found[doc_id]["ids"]
        assert found[doc_id]["n_ids"] == len(ids) and found[doc_id]["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}i", *ids))


def test_line_frequency_matches_brute_force(spark):
    footer = "Read more on our great site today"
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(30)) + f"\n{footer}" + ("\n" + footer.upper() if i % 4 == 0 else ""), "h") for i in range(15)]
    rows += [(100 + i, f"{footer}\nonly {i} here with some words more " + " ".join(f"q{i}{k}" for k in range(i)), "h") for i in range(10)]
    rows += [(200 + i, footer + " " + footer + " " + footer, "other") for i in range(5)]
    found = {r["doc_id"]: r for r in quality_rules.line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i]["n_lines_removed"] == 1 and found[i]["kept"] for i in range(15))
    assert found[0]["n_words_removed"] == 14 and found[1]["n_words_removed"] == 7 and found[0]["n_dup_lines"] == 0
    assert all(found[200 + i]["n_lines_removed"] == 0 for i in range(5))
    assert found[200]["n_repeat_words"] == 21 and found[200]["base_failed"]


def test_repeated_words_match_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        ws = [bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(0, 40))]
        windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        assert quality_rules.repeated_words(ws) == len(hit)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><p>One <b>two</b></p><figure><img src="sha256:aa" alt="x">
<figcaption>A &amp; B</figcaption></figure><script>var p="<p>no</p>"</script><p>three<br>four</p><video src="v.mp4"></video><p>unclosed"""


def test_interleaved_sequence():
    items = media.sequence(PAGE)
    assert [(i["position"], i["kind"], i["text"], i["src"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "T", None, None, None), (1, "text", "One two", None, None, None), (2, "img", None, "sha256:aa", "aa", "A & B"),
        (3, "text", "three", None, None, None), (4, "text", "four", None, None, None), (5, "video", None, "v.mp4", None, None), (6, "text", "unclosed", None, None, None),
    ]


def test_captions_lose_no_words():
    kinds = lambda page: [(i["kind"], i["text"] or i["src"], i["caption"]) for i in media.sequence(page)]
    assert kinds("<figure><img src=a><figcaption>cap</figure><p>one</p><p>two</p>") == [("img", "a", "cap"), ("text", "one", None), ("text", "two", None)]
    assert kinds("<figure><figcaption>first</figcaption><img src=a></figure>") == [("img", "a", "first")]
    assert kinds("<figure><figcaption>alone</figcaption></figure><p>x") == [("text", "alone", None), ("text", "x", None)]
    assert kinds("<figure><img src=a><figcaption>cap<p>para</p>rest") == [("img", "a", "cap"), ("text", "para", None), ("text", "rest", None)]
    assert kinds("<figcaption>no figure") == [("text", "no figure", None)]


def test_items_are_those_of_the_lines(docs, texts):
    found = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for doc_id, text in texts.items():
        lines = [" ".join(line.split()) for line in text.split("\n")]
        assert found[doc_id]["n_items"] == found[doc_id]["position"] + 1 == sum(map(bool, lines)) + 1


def test_stored_image_reads_elsewhere():
    """The format's own rules: signature, chunks with their sums, filter bytes of 0."""
    raw = media.write_image(media.padded(bytes(range(256)) * 3))
    assert raw[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body, size = 8, b"", None
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        assert int.from_bytes(raw[at + 8 + n : at + 12 + n], "big") == zlib.crc32(raw[at + 4 : at + 8 + n])
        size = raw[at + 8 : at + 18] if kind == b"IHDR" else size
        body += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    width, height, depth, colour = int.from_bytes(size[:4], "big"), int.from_bytes(size[4:8], "big"), size[8], size[9]
    lines = zlib.decompress(body)
    assert (width, depth, colour) == (192, 8, 0) and len(lines) == height * 193 and not any(lines[::193])
    assert b"".join(lines[i * 193 + 1 : (i + 1) * 193] for i in range(height)) == media.padded(bytes(range(256)) * 3)


def test_media_resolve_and_round_trip(spark, docs, texts):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("aa", b"payload")], "digest string, stored binary")
    got = [(r["page_id"], r["position"], r["caption"], r["stored"]) for r in media.resolve(media.interleave(pages), store, "stored").orderBy("position").collect()]
    assert got == [(1, 2, "A & B", bytearray(b"payload")), (1, 5, None, None)]
    for text in texts.values():
        payload = media.padded(text.encode())
        assert media.read_image(media.write_image(payload)).tobytes() == payload and len(payload) % 192 == 0
    found = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        payload = media.padded(text.encode())
        assert found[doc_id]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and found[doc_id]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert found[doc_id]["media_sha256"] == hashlib.sha256(media.write_image(payload)).hexdigest()


def test_damaged_image_is_refused():
    stored = bytearray(media.write_image(media.padded(b"abc")))
    stored[46] ^= 1
    with pytest.raises(ValueError):
        media.read_image(bytes(stored))


def test_marks_never_differ_in_more_bits_than_sets_in_tokens():
    random = np.random.default_rng(7)
    for n in (0, 1, 5, 40, 400):
        x = random.integers(0, 2**63, n, np.uint64) * np.uint64(2) + random.integers(0, 2, n, np.uint64)
        y = np.append(x[: n // 2], random.integers(0, 2**63, 9, np.uint64))
        bits = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(near.marks(x), near.marks(y)))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))
        assert near.marks(x) == near.marks(x[::-1])


def test_paragraphs_are_fetched_and_checked_in_parts(spark, monkeypatch):
    """Only a part of the texts, and of the tokens on either side, is shuffled at once; all pairs and nodes are there."""
    rng = random.Random(12)
    words = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(34)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.015 else "other" for w in words[i % 12]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = spark.createDataFrame([(-i - 7, (i, 0, 34), 1) for i in range(60)], "node long, head struct<doc_id:long,a:int,b:int>, n long")
    pairs = list(itertools.combinations([-i - 7 for i in range(60)], 2))
    names, whole = [], paragraphs.stored
    monkeypatch.setattr(paragraphs, "stored", lambda df, name, *a, **k: names.append(name) or whole(df, name, *a, **k))
    got = {tuple(r) for r in paragraphs.links_of(docs, nodes, spark.createDataFrame(pairs, "a long, b long"), 0.8).collect()}
    assert got == {(a, b) for a, b in pairs if near.jaccard(texts[-a - 7], texts[-b - 7]) >= 0.8} and len(got) > 20
    counts = [names.count(name) for name in ("paragraph-tokens", "paragraph-links")]
    assert counts == [paragraphs.PASSES, paragraphs.PASSES**2]
