"""Interleaved document sequences with media columns.

``sequences`` parses HTML into one ordered array of text and media-reference structs per document; references are
SHA-256 digests (``media:<hex>``) with their captions. ``resolve`` looks the digests up in a media table by an equi-join
of narrow rows (digest, document, position), so a payload is read once per copy stored and never multiplied by its
references; positions and captions stay aligned because they travel in the struct. ``assemble`` puts what was found back
into the arrays. No task gets all references to one picture (``join_hot``).

Payloads are stored losslessly as 8-bit grey PNG, 576 samples a row: ``pad`` appends bytes 255 up to a positive multiple
of 576. ``store`` writes the table map-side into the shared folder and reads it back.

Nulls: null or empty HTML is an empty sequence; a null payload text is an empty text. A reference without media stays,
with null media. Repeated media rows resolve once; repeated documents each get their own sequence. Extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .scratch import Scratch

ROW = 576
KNOWN = 1 << 16
_PNG = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes, row: int = ROW) -> bytes:
    return data + b"\xff" * ((-len(data)) % row if data else row)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, row: int = ROW) -> bytes:
    """8-bit grey PNG without row filters; the payload is a positive multiple of ``row``."""
    lines = np.zeros((len(payload) // row, row + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, row)
    head = struct.pack(">IIBBBBB", row, len(lines), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples, rows by columns, of what ``encode_png`` makes; every chunk's checksum is verified."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, body = 8, None, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", part[:8])
            shape = (height, width + 1)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape)[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit average hash over an 8 x 8 grid of the samples."""
    flat = samples.reshape(-1)
    n, s = flat.size, int(flat.sum(dtype=np.int64))
    sq = int(np.dot(flat.astype(np.int64), flat.astype(np.int64)))
    edge = np.arange(65) * n // 64
    cell = np.add.reduceat(flat.astype(np.int64), edge[:-1]) / np.diff(edge)
    bits = int("".join("1" if c * n > s else "0" for c in cell), 2)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={s / n:.4f};var={max(0.0, sq / n - (s / n) ** 2):.4f};ahash={bits:016x}"


_STORED = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: OrderedDict[bytes, None] = OrderedDict()  # the latest of this task; a payload met elsewhere is stored there again
    for batch in batches:
        rows, held = [], 0
        for text in batch.column("text"):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            payload = pad(data)
            digest = hashlib.sha256(payload)
            known = digest.digest() in seen
            seen[digest.digest()] = None
            seen.move_to_end(digest.digest())
            if known:
                continue
            if len(seen) > KNOWN:
                seen.popitem(last=False)
            rows.append((digest.hexdigest(), len(data), encode_png(payload)))
            held += len(rows[-1][2])
            if held > 8 << 20:
                yield _batch(rows, _STORED)
                rows, held = [], 0
        yield _batch(rows, _STORED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def store(texts: DataFrame) -> DataFrame:
    """``digest, n_bytes, media``: the payloads of ``texts`` (column text), written to the shared folder and read back.

    ``n_bytes`` is the length before padding. Equal payloads that different tasks met are there more than once.
    """
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_encode, "digest string, n_bytes long, media binary")
    return Scratch(texts.sparkSession, "media").save(rows)


_FEATURES = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, n_bytes, media in zip(batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            media = media.as_py()
            samples = decode_png(media)
            payload = samples.tobytes()
            rows.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        yield _batch(rows, _FEATURES)


def measure(media: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes: sizes, digests of the payload read back, and features."""
    found = media.mapInArrow(_measure, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest", "n_bytes"])


class _Sequence(HTMLParser):
    """Text runs and media references in page order; a figure's caption, or the image's alt text, is the reference's caption."""

    BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th section article figure figcaption blockquote pre br hr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.figure: int | None = None
        self.caption: list[str] | None = None
        self.mute = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.mute += 1
        if tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source") and (src := attrs.get("src") or "").startswith("media:"):
            self.flush()
            self.items.append({"kind": "media", "text": None, "digest": src[6:].lower(), "caption": attrs.get("alt")})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        if tag == "figcaption" and self.caption is not None:
            caption = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media":
                    item["caption"] = caption
        elif tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.mute:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


_ITEM = pa.struct([("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def sequences(pages: DataFrame) -> DataFrame:
    """``page_id, items``: items an array of ``kind, text, digest, caption`` in page order; the array index is the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [parse(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(items, pa.list_(_ITEM))], names=["page_id", "items"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, items array<struct<kind:string,text:string,digest:string,caption:string>>")


def _look_up(refs: DataFrame, media: DataFrame) -> DataFrame:
    hot = refs.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > scratch.HOT_ROWS)
    return scratch.join_hot(refs, media, ["digest"], hot)


def _refs(seqs: DataFrame, key: str) -> DataFrame:
    return seqs.select(key, F.posexplode("items").alias("position", "item")).where("item.kind = 'media'").select(key, "position", "item.caption", "item.digest")


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """``page_id, position, caption, digest`` and the other columns of ``media`` (one row for each digest) of each media
    reference; null where it is unknown."""
    return _look_up(Scratch(seqs.sparkSession, "refs").save(_refs(seqs, "page_id")), media)


def assemble(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """``page_id, items``: the sequences with ``position, kind, text, digest, caption, media`` in each item, media a struct
    of the other columns of ``media``, null for text and for what is unknown."""
    keyed = Scratch(seqs.sparkSession, "sequences").save(seqs.withColumn("seq", F.monotonically_increasing_id()))
    found = _look_up(_refs(keyed, "seq").select("seq", "position", "digest"), media.select("digest", F.struct(*[c for c in media.columns if c != "digest"]).alias("media")))
    found = found.where("media is not null").groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("found"))  # of one page
    item = lambda x, i: F.struct(i.alias("position"), *[x[c].alias(c) for c in ("kind", "text", "digest", "caption")], F.try_element_at("found", i).alias("media"))
    return keyed.join(found, "seq", "left").select("page_id", F.transform("items", item).alias("items"))
