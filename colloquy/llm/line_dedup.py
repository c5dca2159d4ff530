"""Line dedup by range-partitioned hashes, streamed in order, to compressed keep bitmaps.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points found in at least ``MIN_DOCS`` documents lose their lines except in the largest doc_id that
holds one. What is sorted is one (128-bit key, document, positions) row for each distinct long line of a document; it is
no text, and neither is the result, ``drop_bitmaps``. ``line_dedup`` applies the bitmaps: texts that lose nothing stay
where they are (as long as the ids of the others are at most ``BROADCAST_IDS``, counted), the others meet theirs by a join.

The rows are range-partitioned by (key, document) and sorted by key and document, so a key that a third of all documents
hold spreads over many ranges. A stream through each range holds the rows of one key only until it has seen ``MIN_DOCS``
documents; from there all but the newest document lose the line, whatever follows. What it can't settle, the rest of the
first and last key of a range and of a document with more than ``HELD`` texts, goes out with counts of documents by key,
which are added up over the ranges.

Nulls: a null or empty text is one empty line. A null doc_id counts as the smallest document. Rows that repeat are one
document; rows that share a doc_id with other texts each keep their own bitmap and count as one document. Other input
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, id_in, id_out

MIN_CHARS, MIN_DOCS = 40, 5
HELD = 10_000
BROADCAST_IDS = 2_000_000
_SPACE = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def _keys(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """The 128-bit keys of a text's long lines and where they stand."""
    found: dict[bytes, list[int]] = {}
    for k, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and len(line := line.strip(_SPACE)) >= min_chars:
            key = line.translate(_LOWER) if not line.isascii() else line.lower()
            found.setdefault(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest(), []).append(k)
    return found


def _lines(min_chars: int):
    schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("txt", pa.int64()), ("at", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, txt, at = [], [], [], []
            for d, mark, text in zip(batch.column("doc").to_pylist(), batch.column("txt").to_pylist(), batch.column("text"), strict=True):
                for k, places in _keys(text.as_py(), min_chars).items():
                    key.append(k), doc.append(d), txt.append(mark), at.append(np.array(places, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(txt, pa.int64()), pa.array(at, pa.binary())], schema=schema)

    return run


#: kind 0: loses the line; 1: waits for the counts of its key; 2: documents of a key in this range (n), the newest in doc.
_SETTLED = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.int64()), ("txt", pa.int64()), ("at", pa.binary()), ("n", pa.int64())])
_SETTLED_SQL = "kind int, key binary, doc long, txt long, at binary, n long"


def _stream(min_docs: int, held: int = HELD):
    """Rows of a range in order: lines to drop, and what only all ranges together can settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, docs, last, first, torn, rows = None, 0, None, True, False, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(_SETTLED)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SETTLED, strict=True)], schema=_SETTLED)

        def end(open_: bool) -> None:
            """Of the key that ends: settled, unless it may go on in another range or rows of it went out unsettled."""
            if key is not None and (open_ or torn):
                out.extend((1, *r, 0) for r in rows)
                out.append((2, key, last, 0, b"", docs))

        for batch in batches:
            for k, d, t, a in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "txt", "at")), strict=True):
                if k != key:
                    end(first)
                    first = first and key is None
                    key, docs, last, torn, rows = k, 0, None, False, []
                if not docs or d != last:
                    docs, last = docs + 1, d
                    if docs >= min_docs:  # all that went before lose the line
                        out.extend((0, *r, 0) for r in rows)
                        rows = []
                elif len(rows) >= held:
                    out.extend((1, *r, 0) for r in rows)
                    torn, rows = True, []
                rows.append((k, d, t, a))
            yield made()
        end(True)
        yield made()

    return run


_BITMAPS = pa.schema([("doc", pa.int64()), ("txt", pa.int64()), ("dropped", pa.binary())])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of document and text, one bitmap for each text."""
    now, bits, out = None, np.zeros(0, np.uint8), []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BITMAPS, strict=True)], schema=_BITMAPS)

    def end() -> None:
        if now is not None:
            out.append((*now, zlib.compress(np.packbits(bits).tobytes(), 6)))

    for batch in batches:
        for d, t, a in zip(*(batch.column(c).to_pylist() for c in ("doc", "txt", "at")), strict=True):
            places = np.frombuffer(a, "<i4")
            if (d, t) != now:
                end()
                now, bits = (d, t), np.zeros(0, np.uint8)
            if places[-1] >= len(bits):
                bits = np.concatenate([bits, np.zeros(max(len(bits), int(places[-1]) + 1 - len(bits)), np.uint8)])
            bits[places] = 1
        yield made()
    end()
    yield made()


def _rows(docs: DataFrame) -> DataFrame:
    """``txt`` tells the texts of one doc_id apart."""
    return docs.select(id_in().alias("doc"), F.col("text").cast("string").alias("text")).withColumn("txt", F.xxhash64("text"))


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, txt, dropped`` of the documents that lose lines: zlib of the bits, 1 for each line dropped, first line first."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _rows(docs).mapInArrow(_lines(min_chars), "key binary, doc long, txt long, at binary")
    width = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.save(lines).repartitionByRange(width, "key", "doc").sortWithinPartitions("key", "doc")
    settled = scratch.save(ranged.mapInArrow(_stream(min_docs), _SETTLED_SQL))
    ends = settled.where("kind = 2").groupBy("key").agg(F.sum("n").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs)
    fall = settled.where("kind = 1").select("key", "doc", "txt", "at").join(ends, "key").where(F.col("doc") != F.col("last"))
    dropped = settled.where("kind = 0").select("doc", "txt", "at").unionByName(fall.select("doc", "txt", "at"))
    return dropped.repartition(width, "doc", "txt").sortWithinPartitions("doc", "txt").mapInArrow(_bitmaps, "doc long, txt long, dropped binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary()), ("kept_text", pa.string())])
    for batch in batches:
        n_lines, n_dropped, keep, kept = [], [], [], []
        for text, dropped in zip(batch.column("text"), batch.column("dropped").to_pylist(), strict=True):
            lines = (text.as_py() or "").split("\n")
            stay = np.ones(len(lines), dtype=np.uint8)
            if dropped is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))[: len(lines)]
                stay[: len(bits)] -= bits
                lines = [x for x, s in zip(lines, stay, strict=True) if s]
            n_lines.append(len(stay)), n_dropped.append(int(len(stay) - stay.sum()))
            keep.append(zlib.compress(np.packbits(stay).tobytes(), 6)), kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary()), pa.array(kept, pa.string())], schema=schema)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, keep_bitmap, kept_text`` for each row."""
    rows = _rows(docs)
    marks = Scratch(docs.sparkSession, "marks").save(drop_bitmaps(docs, min_chars, min_docs))
    if marks.count() <= BROADCAST_IDS:
        ids = F.broadcast(marks.select("doc").distinct())
        whole = rows.join(ids, "doc", "left_anti").withColumn("dropped", F.lit(None).cast("binary"))
        rows = rows.join(ids, "doc", "left_semi").join(marks, ["doc", "txt"], "left").unionByName(whole)
    else:
        rows = rows.join(marks, ["doc", "txt"], "left")
    out = rows.mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_text string")
    return out.withColumn("doc_id", id_out("doc_id"))
