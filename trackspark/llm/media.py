"""Media columns: interleaved document sequences.

HTML is parsed to an ordered array of items, texts and media references; references are resolved by a join on the
payload's digest, so that each position keeps its text or payload and its caption.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, only

#: Samples in a row of the stored image; payloads are a multiple of it.
WIDTH = 192
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "article", "section", "figure", "br", "ul", "ol", "table", "body"}
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img", "video", "audio", "source"}


class Sequence(HTMLParser):
    """Collects items in document order; a figcaption becomes the caption of its figure's media.

    A caption that comes before its media waits for it; one that finds none in its figure is a text. A caption ends with
    its tag, its figure, the page, or the next block after its words.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []  # that are open: their media, and a caption that waits for one
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text=None, src=None, caption=None) -> dict:
        digest = src[len(SCHEME) :] if src and src.startswith(SCHEME) else None
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "src": src, "digest": digest, "caption": caption})
        return self.items[-1]

    def end_caption(self) -> None:
        if self.caption is None:
            return
        caption, self.caption = " ".join("".join(self.caption).split()), None
        if not caption:
            return
        figure = self.figures[-1] if self.figures else {"media": [], "waiting": "", "captioned": True}
        if figure["captioned"]:
            self.add("text", text=caption)
        elif figure["media"]:
            figure["media"][-1]["caption"], figure["captioned"] = caption, True
        else:
            figure["waiting"], figure["captioned"] = caption, True

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        if self.figures and (waiting := self.figures.pop()["waiting"]):
            self.add("text", text=waiting)

    def finish(self) -> None:
        self.close()
        self.end_caption()
        while self.figures:
            self.end_figure()
        self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag in MEDIA or tag == "figcaption":
            self.flush()
        if (tag in BLOCKS or tag == "figcaption") and self.caption is not None and "".join(self.caption).strip():
            self.end_caption()
        if tag == "figure":
            self.figures.append({"media": [], "waiting": "", "captioned": False})
        if tag == "figcaption":
            self.caption = []
        found = dict(attrs)
        if tag in MEDIA and found.get("src"):
            item = self.add(tag if tag != "source" else "video", src=found["src"], caption=found.get("alt") or None)
            if self.figures:
                figure = self.figures[-1]
                figure["media"].append(item)
                if figure["waiting"]:
                    item["caption"], figure["waiting"] = figure["waiting"], ""

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption":
            self.end_caption()
        if tag == "figure":
            self.end_figure()
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if self.hidden:
            return
        (self.words if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(page or "")
    parser.finish()
    return parser.items


def interleave(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """`key` and `items`, the ordered array of text and media structs of each page (empty for null or empty HTML)."""

    def parse(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {key: batch[key], "items": [sequence(x) for x in batch["page"]]}

    rows = pages.select(key, F.col(column).cast("string").alias("page"))
    return map_rows(rows, parse, T.StructType([rows.schema[key], *T.StructType.fromDDL(f"items {ITEMS}").fields]))


def resolve(sequences: DataFrame, store: DataFrame, *payload: str, key: str = "page_id") -> DataFrame:
    """One row per media item: `key`, its position, caption and digest, and the `payload` columns of `store`.

    `store` has one row per `digest`. Items without a digest or with an unknown one keep null payloads; positions
    count text items too, so a text and its media stay aligned.
    """
    items = sequences.select(key, F.explode("items").alias("item")).filter("item.kind <> 'text'")
    items = items.select(key, "item.position", "item.caption", "item.digest")
    return items.join(store.select("digest", *payload), "digest", "left").select(key, "position", "caption", "digest", *payload)


def padded(raw: bytes) -> bytes:
    """`raw` with blanks up to a positive multiple of WIDTH."""
    return raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_image(payload: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, no row filter: the payload's bytes are the samples."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(grid), WIDTH + 1), np.uint8)
    lines[:, 1:] = grid
    head = struct.pack(">IIBBBBB", WIDTH, len(grid), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_image(stored: bytes) -> np.ndarray:
    """The samples of an image of write_image(), as rows; checks every chunk's sum."""
    at, parts, shape = 8, [], None
    while at < len(stored):
        if len(stored) < at + 12 or len(stored) < at + 12 + struct.unpack_from(">I", stored, at)[0]:
            raise ValueError("the stored image is cut off")
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk of the stored image is damaged")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += n + 12
    if shape is None or not parts:
        raise ValueError("the stored image has no head or no samples")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    return lines[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Rows, mean and deviation of the samples, and their shares in eight equal ranges, in thousandths."""
    n = samples.size
    counts = np.bincount(samples.ravel(), minlength=256)
    total = int((counts * np.arange(256)).sum())
    square = int((counts * np.arange(256) ** 2).sum())
    shares = counts.reshape(8, 32).sum(1) * 1000 // n
    return f"rows={len(samples)};mean={total * 100 // n};var={(square * n - total * total) // (n * n)};hist=" + ",".join(map(str, shares))


def as_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page (doc, html): its lines as paragraphs, and its payload's image by digest with a caption."""

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"doc": [], "html": []}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = (text or "").encode()
                digest = hashlib.sha256(padded(raw)).hexdigest()
                lines = "".join(f"<p>{html.escape(line, quote=False)}</p>" for line in (text or "").split("\n") if line)
                out["doc"].append({"doc_id": doc_id, "n_bytes": len(raw)})
                out["html"].append(f'<article>{lines}<figure><img src="{SCHEME}{digest}"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
            yield out

    rows = only(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return map_rows(rows, write, "doc struct<doc_id:bigint,n_bytes:bigint>, html string")


def as_images(docs: DataFrame) -> DataFrame:
    """Payload digest and stored image, once for each distinct payload."""

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            payloads = {hashlib.sha256(p).digest(): p for p in (padded((t or "").encode()) for t in batch["text"])}
            yield {"digest": [d.hex() for d in payloads], "stored": [write_image(p) for p in payloads.values()]}

    rows = map_rows(only(docs, "text").select(F.col("text").cast("string").alias("text")), write, "digest string, stored binary")
    return rows.groupBy("digest").agg(F.first("stored").alias("stored"))


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(store: DataFrame) -> DataFrame:
    """Facts of each stored image (digest, stored), from its decoded samples."""

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (f.split()[0] for f in FACTS.split(", "))}
            for digest, stored in zip(batch["digest"], batch["stored"]):
                samples = read_image(stored)
                payload = samples.tobytes()
                row = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(samples))
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield out

    return map_rows(store.select("digest", "stored"), read, FACTS)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: its payload stored as an image, resolved by digest and read back.

    Documents become pages with a paragraph for each line and one media reference; n_items and items_sha256 (of the items
    as JSON) tell what was parsed, position and caption where the media stands. Equal payloads share a digest and so one
    stored image. Null texts count as empty; repeated rows each keep their row; very long texts are one image of many
    rows; an empty table gives an empty result; other columns are not read.
    """
    sequences = interleave(as_pages(docs), key="doc")
    parsed = F.struct("doc.doc_id", "doc.n_bytes", F.size("items").cast("long").alias("n_items"), F.sha2(F.to_json("items"), 256).alias("items_sha256"))
    media = F.filter("items", lambda item: item["kind"] != "text")  # texts have been told, and needn't be shuffled
    sequences = sequences.select(parsed.alias("doc"), media.alias("items"))
    facts = [f.split()[0] for f in FACTS.split(", ")][1:]
    rows = resolve(sequences, read_back(as_images(docs)), *facts, key="doc")
    return rows.select("doc.*", *facts, "caption", "position")


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, src, caption, n_chars and text_crc32 of every item of every page, in order.

    Null or empty pages have no items; repeated rows each give theirs; other columns are not read.
    """
    items = interleave(pages).select("page_id", F.explode("items").alias("item"))
    text = F.coalesce("item.text", F.lit(""))
    return items.select("page_id", "item.position", "item.kind", "item.src", "item.caption", F.length(text).cast("long").alias("n_chars"), F.crc32(text.cast("binary")).alias("text_crc32"))
