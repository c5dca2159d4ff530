"""Stupid-backoff language-model scores of a corpus under its own n-gram counts, as joins on hash shards.

Each task cuts its documents into blocks of bounded bytes. Each block's n-grams of orders 1 to 3 are exploded to their
distinct hashes and counts, cut by hash into shards, and grouped by shard: there the count tables are summed, one table
shard in one task, and joined back to the n-grams that each block asked for. The counts return to the block, which scores
every position and sums per document. A frequent n-gram is one row for each block that holds it, never one for each
occurrence, so no shard is hot, and no key of the documents decides where they go; between tasks go sorted 64-bit hashes
as packed differences, counts as packed bytes and texts as compressed blocks.

Score of a word: log(c3 / c2) if the trigram was seen at least ``min_count`` times, else log(0.4 * c2 / c1) for the
bigram, else log(0.16 * c1 / N); with one word of context one step fewer, with none log(c1 / N) outright. An n-gram seen
once in the corpus is only the document's own, which is why the cut-off is 2. Words are runs outside
``[\\x20\\x09-\\x0D]``, case kept.

Nulls: a null or wordless text has 0 words and a null score. A null id stays null. Repeated rows count as often as they
occur and come out repeated. Other columns are ignored. An empty table gives an empty result. A task that runs again after
its executor is lost must make the same blocks, as reading files does; if it does not, the job fails.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 16 << 20
SHARD_GRAMS = 3_000_000

_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary())])


def _cut(block_bytes: int):
    """Blocks of documents, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = K.text_bytes(batch.column("text"))
            total = int(offsets[-1] - offsets[0])
            for i, j in K.slices(offsets, max(1, -(-total // max(1, -(-total // block_bytes))))):
                part = batch.slice(i, j - i)
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    data = sink.getvalue()
                # named by its content, so that what was asked for one block is never told to another
                name = hashlib.blake2b(data, digest_size=8, key=f"{task},{made}".encode()).digest()
                made += 1
                packed = zstandard.ZstdCompressor(level=3).compress(data)
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name, "little", signed=True)]), pa.array([packed], pa.binary())], schema=_BLOCK)

    return run


def _documents(table: pa.Table) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(table.column("docs")[0].as_py())) as r:
        return r.read_all()


def _block_grams(texts: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order its hashes at every position of the block's documents (0 where none begins), and the documents."""
    raw, offsets = K.text_bytes(texts)
    hs, ats = [], [0]
    for i, j in K.slices(offsets):
        h, at = K.words(raw, offsets[i : j + 1])
        ats += (at[1:] + ats[-1]).tolist()
        hs.append(h)
    h, at = np.concatenate(hs) if hs else np.zeros(0, np.uint64), np.array(ats)
    for n in range(1, ORDER + 1):
        g = np.zeros(len(h), dtype=np.uint64)
        g[: max(0, len(h) - n + 1)] = np.maximum(K.ngrams(h, n), np.uint64(1))
        for k in range(1, n):
            sizes = np.diff(at)
            g[at[1:][sizes >= k] - k] = 0
        yield n, g, at


def _cuts(shards: int) -> np.ndarray:
    """Upper ends of all shards but the last, in hash space."""
    return np.array([(k << 64) // shards for k in range(1, shards)], dtype=np.uint64)


_ASK = "shard int, block long, ord int, grams binary, counts binary"


def _ask(shards: int):
    cuts = _cuts(shards)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        for n, g, _ in _block_grams(_documents(table).column("text")):
            grams, counts = np.unique(g[g > 0], return_counts=True)
            edge = np.concatenate([[0], np.searchsorted(grams, cuts), [len(grams)]])
            for s in range(shards):
                if edge[s] < edge[s + 1]:
                    part = slice(edge[s], edge[s + 1])
                    for c, v in zip(cols, (s, key[0].as_py(), n, K.pack_sorted(grams[part]), K.pack(counts[part].astype(np.uint32))), strict=True):
                        c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "ord", "grams", "counts"])

    return run


def _tell(table: pa.Table) -> pa.Table:
    """One shard: sums the counts of all blocks and answers each block in the order it asked."""
    out: list[list] = [[], [], [], []]
    shard = table.column("shard")[0].as_py()
    for n in range(1, ORDER + 1):
        rows = [(b, K.unpack_sorted(g), K.unpack(c, np.uint32)) for o, b, g, c in zip(table.column("ord").to_pylist(), table.column("block").to_pylist(), table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True) if o == n]
        if not rows:
            continue
        every = np.concatenate([g for _, g, _ in rows])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=np.uint64(0)))
        total = np.add.reduceat(np.concatenate([c for *_, c in rows])[order].astype(np.int64), first)
        answer = np.empty(len(every), dtype=np.int64)
        answer[order] = np.repeat(total, np.diff(np.append(first, len(every))))
        at = 0
        for block, grams, _ in rows:
            for c, v in zip(out, (block, shard, n, K.pack(answer[at : at + len(grams)].astype(np.uint64))), strict=True):
                c.append(v)
            at += len(grams)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "ord", "counts"])


def _score(total: int, min_count: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            raise ValueError("a block that asked is gone; its task ran again with other rows")
        docs = _documents(table)
        told: dict[tuple[int, int], bytes] = {(o, s): c for o, s, c in zip(answers.column("ord").to_pylist(), answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True)}
        count, at = [], np.zeros(1, np.int64)
        for n, g, at in _block_grams(docs.column("text")):
            grams, place = np.unique(g, return_inverse=True)
            counts = [K.unpack(told[k], np.uint64) for k in sorted(told) if k[0] == n]
            counts = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
            none = int(len(grams) > 0 and grams[0] == 0)
            if len(counts) != len(grams) - none:
                raise ValueError("the block is not the one that asked")
            count.append(np.concatenate([np.zeros(none), counts])[place])
        words = len(count[0])
        score = np.zeros(words)
        if words:
            c1, c2, c3 = count  # at the first word of each n-gram
            start = np.zeros(words, dtype=bool)
            start[at[:-1][np.diff(at) > 0]] = True
            second = np.zeros(words, dtype=bool)
            second[at[:-1][np.diff(at) > 1] + 1] = True
            back = np.where(start, 0.0, np.where(second, 1.0, 2.0))
            score = np.log(c1 / total) + back * math.log(ALPHA)
            bi = np.concatenate([[0.0], c2[:-1]])  # of the bigram that ends here
            use = ~start & (bi >= min_count)
            use[0] = False
            i = np.flatnonzero(use)
            score[i] = np.log(bi[i] / c1[i - 1]) + np.where(second[i], 0.0, math.log(ALPHA))
            tri = np.concatenate([[0.0, 0.0], c3[:-2]])[:words]
            i = np.flatnonzero(~start & ~second & (tri >= min_count))
            score[i] = np.log(tri[i] / c2[i - 2])
        sizes = np.diff(at)
        sums = [math.fsum(score[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table([docs.column("doc").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["doc", "n_words", "log_score"])

    return run


def stupid_backoff(docs: DataFrame, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` for each row; counts are of all rows. Logarithms are natural."""
    from .mixing import n_words

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    total = int(rows.agg(F.sum(n_words())).first()[0] or 0)
    n_shards = max(1, math.ceil(total * ORDER / shard_grams))
    blocks = rows.mapInArrow(_cut(block_bytes), "block long, docs binary")
    asks = blocks.groupBy("block").applyInArrow(_ask(n_shards), _ASK)
    tells = asks.groupBy("shard").applyInArrow(_tell, "block long, shard int, ord int, counts binary")
    scored = blocks.groupBy("block").cogroup(tells.groupBy("block")).applyInArrow(_score(total, min_count), "doc long, n_words long, log_score double")
    return scored.select(F.col("doc").alias("doc_id"), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
