"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

The distinct marked words of a batch are sorted, which lays them out as the depth-first walk of their trie; the forward
states of a common prefix are kept from word to word, and only the new letters of a word are worked on.

In a unigram model the state of a prefix is its best score. In a pair-merge model a path is allowed only if merging
would leave each two of its pieces side by side; every prefix has exactly one such path, so its state is the last piece
of that path, and the ids are those of the merges.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, only

MARK = "▁"
#: What an unknown letter costs beyond the lowest score of a piece.
UNKNOWN = 10.0
NEVER = float("-inf")
#: Pairs of pieces whose merging is remembered.
MOST_PAIRS = 1 << 18
#: Letters of the longest word that is kept, so that the number of words bounds the bytes too; text without blanks is one word.
LONG_WORD = 64
#: Of a model file: the field with the trainer's settings, and in it the model type; the type for pair merges.
SETTINGS, TYPE, PAIR_MERGES = 2, 3, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message; fixed-size values are skipped."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            at += {1: 8, 5: 4}[tag & 7]


def is_pair_merges(path: str) -> bool:
    with open(path, "rb") as file:
        settings = next((v for k, v in fields(file.read()) if k == SETTINGS), b"")
    return next((v for k, v in fields(settings) if k == TYPE), 1) == PAIR_MERGES


class Pieces:
    """The pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        special = {i for i in range(len(self.names)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.names) if i not in special}
        self.scores = {p: float(model.get_score(i)) for p, i in self.ids.items()}
        self.merges, self.pairs = is_pair_merges(path), {}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.special, self.unknown = special, model.unk_id()
        self.codes = {p: array("i", [i]).tobytes() for p, i in self.ids.items()}
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN
        self.longest: dict[str, int] = {}  # of the pieces that end in two or three letters
        for piece in self.ids:
            for size in (2, 3):
                if len(piece) >= size:
                    self.longest[piece[-size:]] = max(len(piece), self.longest.get(piece[-size:], 1))
        #: Of each piece, the pieces that end it, the longest first, down to its last letter.
        self.endings = {p: tuple(p[i:] for i in range(len(p)) if p[i:] in self.ids or i == len(p) - 1) for p in self.ids}
        self.old: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in special else n.replace(MARK, " ").encode() for i, n in enumerate(self.names)]
        inner = "\n" if not any("\n" in p for p in self.ids) else ""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.words = re.compile("(?s).+")  # a piece may span words: the text is one word
        else:
            self.words = re.compile(f"{MARK}*[^{MARK}{inner}]+|{MARK}+" + (f"|{inner}" if inner else ""))

    def split(self, text: str) -> list[str]:
        """The marked words: blanks become marks, and the text starts with one."""
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def merged(self, text: str) -> list[str]:
        """Plain pair merging: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) != NEVER:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], NEVER)
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], NEVER)
        return parts

    def beside(self, left: str, right: str) -> bool:
        """Whether merging leaves two pieces (or a first piece, after "") as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [p for p in (left, right) if p]
        return known

    def extend_merges(self, word: str, last: list[str]) -> None:
        """Add to `last`, the last pieces of the prefixes of `word` as far as they are known, those of all others.

        The last piece is the one that stays beside the last piece of what is before it; longer pieces are asked first,
        and a letter that is no piece stands for itself.
        """
        endings, pairs, longest = self.endings, self.pairs, self.longest
        for end in range(len(last), len(word) + 1):
            most = longest.get(word[end - 3 : end], 2) if end > 2 else end
            for begin in range(end - most if most < end else 0, end):
                found = endings.get(word[begin:end])
                if found:
                    break
            else:
                found = (word[end - 1],)
            for piece in found:
                left = last[end - len(piece)]
                fits = pairs.get((left, piece))
                if fits or fits is None and self.beside(left, piece):
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no path of pieces for {word[:end]!r}")

    def step_scores(self, word: str, end: int, states: list[float]) -> tuple[float, str]:
        """State and last piece of word[:end]: the best score; ties go to the longer piece."""
        top, best = states[end - 1] + self.scores.get(word[end - 1], self.unknown_score), word[end - 1]
        longest = self.longest.get(word[end - 2 : end], 1) if end > 1 else 1
        for begin in range(end - 2, max(-1, end - 1 - longest), -1):
            score = self.scores.get(word[begin:end])
            if score is not None and states[begin] + score >= top:
                top, best = states[begin] + score, word[begin:end]
        return top, best

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids (native 32-bit ints) of each distinct word; a prefix keeps its last piece, a word traces them back once."""
        found: dict[str, bytes] = {}
        states, pieces_, last, code_of = [0.0], [""], "", self.codes.get
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], pieces_[shared + 1 :]
            if self.merges:
                self.extend_merges(word, pieces_)
            else:
                for end in range(shared + 1, len(word) + 1):
                    state, piece = self.step_scores(word, end, states)
                    states.append(state)
                    pieces_.append(piece)
            path, end = [], len(word)
            while end:
                piece = pieces_[end]
                path.append(code_of(piece) or array("i", self.ids_of(piece)).tobytes())
                end -= len(piece)
            last, found[word] = word, b"".join(reversed(path))
        return found

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids.get(b, self.unknown) for b in piece.encode()]

    def ids_of_words(self, words: set[str], most: int) -> dict[str, bytes]:
        """encode_words(), with the words that came lately kept by the process: at most `most`, and those of one call."""
        found, missing = {}, []
        old, fresh = self.old.get, self.fresh.get
        for word in words:
            ids = fresh(word)
            if ids is None:
                ids = old(word)
                if ids is None:
                    missing.append(word)
                    continue
                self.fresh[word] = ids
            found[word] = ids
        made = self.encode_words(missing)
        found |= made
        self.fresh |= {word: ids for word, ids in made.items() if len(word) <= LONG_WORD}
        if len(self.fresh) > most // 2:
            self.old, self.fresh = self.fresh, {}
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces join to letters, marks become blanks, the first one goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, most_words: int = 1 << 19, with_decoded: bool = False) -> DataFrame:
    """doc_id, ids, n_ids and their crc32 (as little-endian 32-bit ints) for every row.

    Null and empty texts have no ids. A worker process keeps the words that came lately, about `most_words` of them. Texts
    are encoded whole; repeated rows each keep their row; an empty table gives an empty result; other columns are not
    read. `with_decoded` decodes the ids again and adds decoded_crc32, of the decoded text, and decoded_equal: whether it
    is the text (not so where a text has the mark itself; null counts as empty).
    """
    path = path or default_path()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = pieces(path)
        for batch in batches:
            split = [model.split(text or "") for text in batch["text"]]
            known = model.ids_of_words(set().union(*split), most_words)
            rows = [b"".join([known[w] for w in words]) for words in split]
            lengths = np.array([len(r) // 4 for r in rows], np.int64)
            ids = np.frombuffer(b"".join(rows), np.int32)
            ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
            out = {"doc_id": batch["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), "n_ids": lengths.tolist(), "ids_crc32": [zlib.crc32(r) for r in rows]}
            if with_decoded:
                back = [model.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                out |= {"decoded_crc32": [zlib.crc32(t.encode()) for t in back], "decoded_equal": [t == (text or "") for t, text in zip(back, batch["text"])]}
            yield out

    rows = only(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    schema = "doc_id long, ids array<int>, n_ids long, ids_crc32 long" + ", decoded_crc32 long, decoded_equal boolean" * with_decoded
    return map_rows(rows, run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = pieces(path)
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "text": [model.decode(ids or ()) for ids in batch["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
