"""Cases where an operator once did less than its whole job."""

import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from trackspark.llm import language_id, near, packing, paragraphs, sentence_pieces, toxicity
from trackspark.llm.common import documents


def words(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_passages_of_50_words_inside_single_lines_go(spark):
    rng = random.Random(11)
    rows, planted = [], {}
    for k in range(40):
        passage = words(rng, 50)
        for copy in range(2):
            before, after = words(rng, 20 + copy * 45), words(rng, 20 + copy * 100)
            if k % 2:  # with sentences
                before, passage_, after = ([w + "." if i % 12 == 11 else w for i, w in enumerate(x)] for x in (before, passage, after))
            else:
                passage_ = passage
            planted[len(rows)] = (copy, before, passage_, after)
            rows.append(" ".join(before + passage_ + after))
    rows += [" ".join(words(rng, 90)) for _ in range(20)]
    found = {r["doc_id"]: r for r in paragraphs.remove_paragraphs(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, text in enumerate(rows):
        r = found[i]
        if not planted.get(i, (0,))[0]:
            assert r["text"] == text and r["n_removed"] == r["n_words_removed"] == 0
            continue
        _, before, passage, after = planted[i]
        left = r["text"].split()
        assert left[: len(before)] == before and left[-len(after) :] == after  # nothing else goes
        assert len(left) == len(text.split()) - r["n_words_removed"]
        assert r["n_removed"] == 1 and r["n_words_removed"] >= 30


def test_overlapping_paragraphs_of_the_first_copy_stay(spark):
    """Paragraphs of one passage overlap; whatever they are linked with, the first document stays whole."""
    rng = random.Random(12)
    passage = words(rng, 120)
    rows = [" ".join(words(rng, 30) + passage + words(rng, 30)), "\n".join(" ".join(passage[k : k + 40]) for k in (0, 40, 80))]
    found = {r["doc_id"]: r for r in paragraphs.remove_paragraphs(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found[0]["text"] == rows[0] and found[1]["n_words_removed"] >= 100


def test_words_are_found_where_they_are():
    text = "Ein İstanbul, ΣΑΣ und\nmehr"
    assert len(paragraphs.places_of_words(text)) == len(near.words_of(text))
    assert ["so  MANY words"[a:b] for a, b in paragraphs.places_of_words("so  MANY words")] == ["so", "MANY", "words"]


@pytest.mark.parametrize("merges", [True, False])
def test_memory_grows_with_a_word_not_with_its_square(merges):
    rng = random.Random(13)
    model = sentence_pieces.Pieces(sentence_pieces.default_path())
    model.merges = merges and model.merges
    word = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    tracemalloc.start()
    found = model.encode_words({word})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(model.names[i] for i in np.frombuffer(found[word], np.int32)) == word and peak < 100 << 20


def test_documents_with_repeated_runs_lose_them_and_others_stay_whole(spark):
    """All documents of sf0.01: those with 50 words in a row of an earlier document, those without 30 repeated words in a row."""
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    found = {r["doc_id"]: r for r in paragraphs.remove_paragraphs(docs).collect()}
    seen, earlier, count = {50: set(), 30: set()}, {}, {}
    for doc_id, text in rows:
        words = near.words_of(text)
        runs = {n: [hash(tuple(words[i : i + n])) for i in range(len(words) - n + 1)] for n in (50, 30)}
        earlier[doc_id] = any(r in seen[50] for r in runs[50])
        for r in runs[30]:
            count[r] = count.get(r, 0) + 1
        seen[50].update(runs[50])
    repeats = {d: t for d, t in rows if earlier[d]}
    assert len(repeats) > 100 and all(found[d]["n_words_removed"] > 0 for d in repeats)
    own = {d: all(count[hash(tuple(w[i : i + 30]))] == 1 for i in range(len(w) - 29)) for d, t in rows if (w := near.words_of(t)) is not None}
    alone = [d for d, _ in rows if own[d]]
    touched = [d for d in alone if found[d]["n_words_removed"]]
    assert len(alone) > 600 and len(touched) <= 0.005 * len(alone)
    left = {d: len(near.words_of(found[d]["text"])) for d in found}
    assert all(left[d] == found[d]["n_words"] - found[d]["n_words_removed"] for d in found)


def plain_grams(text):
    """1- to 3-grams of a text's letters, with one gap for a run of anything else, in plain Python."""
    line = [1]
    for letter in text.lower():
        if letter.isalpha():
            line.append(ord(letter))
        elif line[-1] != 1:
            line.append(1)
    line += [1] if line[-1] != 1 else []
    grams = [tuple(line[i : i + n]) for n in (1, 2, 3) for i in range(len(line) - n + 1)]
    return [g for g in grams if g != (1,) and all(g[i : i + 2] != (1, 1) for i in range(len(g) - 1))] if len(line) > 1 else []


def test_languages_equal_plain_profiles(spark):
    """All documents of sf0.001: profiles and out-of-place distances by sorting and looking up, ties and all."""
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    counts: dict = {}
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2 and lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    ranked = lambda c: sorted(c, key=lambda g: (-c[g], len(g), g))[:300]
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in counts.items()}
    want = {}
    for doc_id, text, _ in rows:
        top = ranked(Counter(plain_grams(text or "")))
        if not top:
            want[doc_id] = ("und", 0.0)
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want[doc_id] = (best, 1 - away[best] / (300 * len(top)))
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit_profiles(docs)).collect()}
    assert set(got) == set(want) and len(profiles) == 4
    for doc_id, (lang, score) in want.items():
        assert got[doc_id]["lang_pred"] == lang and got[doc_id]["score"] == pytest.approx(score, abs=1e-12)
        assert got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_each_stage_of_the_pipeline_does_its_work(spark, tmp_path):
    """sf0.001, stage by stage: every stage's rows against a plain version over the rows that it was given."""
    sf = "/root/testdata/sf0.001"
    now = documents(spark, sf)
    rest = ("lang", "source")
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r for r in now.collect()}
        texts = {d: r["text"] or "" for d, r in rows.items()}
        out = stage(spark, now, sf)
        found = out.collect()
        if name != "packing":
            got = {r["doc_id"]: r for r in found}
            assert len(got) == len(found) and set(got) <= set(rows)
            assert all(got[d][c] == rows[d][c] for d in got for c in rest) and all(r["n_chars"] == len(r["text"] or "") for r in found)
        if name == "toxicity":
            model = toxicity.fit(now, spark.read.parquet(f"{sf}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score(now, model).collect() if r["score"] >= 0.3}
            assert set(got) == set(rows) - bad and 0 < len(bad) < 0.2 * len(rows)
        elif name == "lines":
            seen, want = set(), {}
            for d in sorted(texts):  # exact repeats at least go, and what is left is lines of the text in order
                kept = [x for x in texts[d].split("\n") if len(x) < 20 or not (x in seen or seen.add(x))]
                want[d] = kept
            for d, r in got.items():
                left = (r["text"] or "").split("\n")
                whole = iter(texts[d].split("\n"))
                assert all(x in whole for x in left) and len(left) <= max(1, len(want[d]))
            assert all(not "".join(want[d]).strip() or len(want[d]) < len(texts[d].split("\n")) for d in set(rows) - set(got))
        elif name == "near":
            sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := near.words_of(t))}
            root = {d: d for d in texts}
            changed = True
            links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            while changed:
                changed = False
                for a, b in links:
                    low = min(root[a], root[b])
                    changed |= root[a] != low or root[b] != low
                    root[a] = root[b] = low
            assert set(got) == {d for d in texts if root[d] == d} and all(got[d]["text"] == rows[d]["text"] for d in got)
        elif name == "passages":
            runs = Counter(run for t in texts.values() for run in {tuple(w[i : i + 30]) for w in [near.words_of(t)] for i in range(len(w) - 29)})
            alone = [d for d, t in texts.items() for w in [near.words_of(t)] if all(runs[tuple(w[i : i + 30])] == 1 for i in range(len(w) - 29)) and len(set(w)) > 0.2 * len(w)]
            same = sum(d in got and got[d]["text"] == rows[d]["text"] for d in alone)
            assert len(alone) > 100 and same >= 0.97 * len(alone)
        else:
            pieces: dict = {}
            for r in found:
                pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
            encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            assert set(pieces) == set(rows)
            for d, parts in pieces.items():
                parts.sort()
                assert [s for s, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
                assert sum(n for _, n, _ in parts) == parts[0][2] == len(encode(texts[d])) // 2
            break
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert name == "packing"
