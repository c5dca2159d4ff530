"""Quality classifier: interpolated modified Kneser-Ney trigram perplexity with language-specific quantile thresholds.

Training. Trusted documents are those whose labels all say quality 1 and none toxic. In a seeded hash order one half is for
training, the other only for calibration. The model is counted on every document of the training half, whole. Only a caller
that asks for it (``train_docs``, ``train_bytes``) gets a model of a bounded sample, whole documents in equal shares by
language; no query does.

Trigrams u v w go to shards by their middle word's hash. So a shard has whole what a model of order 3 counts but for single
words: the trigrams, their histories u v, how many words u come before each v w, and what follows v. How many v come before
each w is summed over the shards; the counts of counts of each order and language, and from them the discounts, are a few
rows on the driver, and the shards are told the probabilities of the single words they ask for. What is kept is the packed
trigrams of blocks of documents; whoever needs a shard counts it anew.

Scoring. The log-probability of a word is a sum over its n-grams, each adding what it knows beyond the shorter ones and
nothing if the model lacks it: ``log p1(w) + log g2(v) + d2(vw) + log g3(uv) + d3(uvw)``, g what a history leaves to the
order below, d2 and d3 the log-ratios of a known n-gram's interpolated probability to what backing off would give. All but
the first are in the shard of v, and p1(w) in that of the next trigram (after a document's last word comes an end), so
documents' trigrams meet the shards of the model in one join by shard; sums by document go back to their block. Values are
whole multiples of 2**-30, so sums don't depend on their order. The documents are read ``PASSES`` times, each time for a part
of the shards, so that the messages of all are not on disk together; a block is named by its content, and if it is another
one in another pass, the job fails. Words pass a Bloom filter of the model's words first (``FILTER_BITS`` a word, at most
``FILTER_WORDS_LOG2`` cells, beyond which it only lets more through): what it rejects is unknown, what it lets through by
mistake is not found in the shard. Words are told apart by 48 bits of their hashes.

Thresholds. Short documents vary more: the variance of the log-perplexity about its mean is fitted for each language as
``a + b / words``, by least squares over all calibration documents, and the threshold is the ``QUANTILE`` of their
standardised distances from the mean, from a histogram in steps of 1/1024, so that reruns agree to the bit. A document
is rejected above it.

Nulls: null labels do not make a document trusted; a null language is a language of its own. A null or wordless text has
no perplexity and is kept; so is everything in a language without trusted documents, since nothing speaks against it. A
language with trusted documents, but none for training that fits its share, has no model either: a warning names it.
Without calibration documents a language has no threshold. Repeated documents and labels count once in training (by
doc_id) and come out repeated. Extra columns are ignored by ``judge`` and kept by ``accept``, whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, without

SEED = 5
LONG = 0.25
CELLS_LOG2 = 10
QUANTILE = 0.995
STEP = 1024
UNIT = 1 << 30
BLOCK_BYTES = 8 << 20
SHARD_KEYS = 600_000
WORD_BYTES = 6
PART_BYTES = 128 << 20
PASSES = 4
FILTER_BITS = 16
FILTER_WORDS_LOG2 = 22
NO_LANGUAGE = "\x00"
_BEGIN = np.uint64(0xC2B2AE3D27D4EB4F)
_SPARE = np.uint64(16)
_END, _UNKNOWN = np.uint64(0), np.uint64(1)  # what follows a document's last word; every word that no training document has


def _lang_code(lang: str | None) -> np.uint64:
    data = (b"l" + lang.encode() if lang is not None else b"n").replace(b" ", b"_")
    return K.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0]


def _occurrences(raw: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents in their languages (``codes``) as hashes of 48 bits, each document's after two marks; the places of
    the words among them; and the place of each document's first word."""
    hs, ats = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in K.slices(offsets):  # what words need for each byte is held for a slice only
        h, at = K.words(raw, offsets[i : j + 1])
        hs.append(h), ats.append(at[1:] + ats[-1][-1])
    h, at = np.concatenate(hs), np.concatenate(ats)
    hs.clear()
    sizes = np.diff(at)
    own = np.full(len(h) + 2 * len(sizes), _BEGIN, dtype=np.uint64)
    place = np.arange(len(h)) + np.repeat(np.arange(len(sizes)) * 2, sizes) + 2
    own[place] = h
    del h
    return K.mix(own ^ np.repeat(codes, sizes + 2)) >> _SPARE, place, at


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


#: Trigrams u v w of a block whose middle word is of a shard: the words' hashes, the distinct v with how many follow each
#: and their languages, u, w as places among the words, and the counts of trigrams or the documents they stand in.
_MESSAGE = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("of", pa.int32()), *[(c, pa.binary()) for c in ("words", "mids", "runs", "langs", "u", "w", "more")]])
_MESSAGE_SQL = "shard int, part int, block long, n int, of int, words binary, mids binary, runs binary, langs binary, u binary, w binary, more binary"


def _messages(u: np.ndarray, v: np.ndarray, w: np.ndarray, codes: np.ndarray, docs: np.ndarray | None, shards: int) -> Iterator[tuple]:
    """``shard, words, mids, runs, langs, u, w, more`` of each shard that has any. Without ``docs`` equal trigrams are one, counted."""
    if not len(v):
        return
    words, code = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    u, v, w = code.reshape(3, -1)
    n = len(words)
    order = np.lexsort((w, u, v)) if n >= 1 << 21 else np.argsort((v * n + u) * n + w if docs is None else v * n + u, kind="stable")
    u, v, w, codes = u[order], v[order], w[order], codes[order]
    if docs is None:
        new = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        more = np.diff(np.append(new, len(v)))
        u, v, w, codes = u[new], v[new], w[new], codes[new]
    else:
        more = docs[order]
    shard = _shard_of(words, shards)[v]  # ascends, as hashes do
    edge = np.searchsorted(shard, np.arange(shard[0], shard[-1] + 2))
    for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True), int(shard[0])):
        if a == b:
            continue
        held, local = np.unique(np.concatenate([u[a:b], v[a:b], w[a:b]]).astype(np.int32), return_inverse=True)
        lu, lv, lw = local.reshape(3, -1).astype(np.uint32)
        head = np.flatnonzero(np.diff(lv.astype(np.int64), prepend=-1))
        runs = np.diff(np.append(head, b - a)).astype(np.uint32)
        yield s, K.pack_sorted(words[held]), K.pack_sorted(lv[head]), K.pack(runs), K.pack(codes[a:b][head]), K.pack(lu), K.pack(lw), K.pack(more[a:b].astype(np.uint32))


def _unpacked(m: dict) -> tuple[np.ndarray, ...]:
    """``words, v, runs, langs, u, w, more`` of a message; v one for each run."""
    return (K.unpack_sorted(m["words"]), K.unpack_sorted(m["mids"], np.uint32), K.unpack(m["runs"], np.uint32), K.unpack(m["langs"], np.uint64), *[K.unpack(m[c], np.uint32) for c in ("u", "w", "more")])


@contextmanager
def _batches(spark: SparkSession, n: int, size: int) -> Iterator[None]:
    """Arrow batches of about a block, for ``n`` texts of ``size`` bytes together: what waits beside a block counts twice, in the JVM and in Python."""
    keys = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(x) for x in keys]
    most = int(before[0])
    try:
        spark.conf.set(keys[0], str(max(1, min(most if most > 0 else 10_000, BLOCK_BYTES * n // max(1, size)))))
        spark.conf.set(keys[1], str(BLOCK_BYTES))
        yield
    finally:
        for x, y in zip(keys, before, strict=True):
            spark.conf.set(x, y)


def _codes(langs: list) -> np.ndarray:
    known = {x: _lang_code(x) for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=np.uint64)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            langs = _codes(batch.column("lang").to_pylist())
            for i, j in K.slices(offsets, BLOCK_BYTES):
                own, place, at = _occurrences(raw, offsets[i : j + 1], langs[i:j])
                of = np.repeat(langs[i:j], np.diff(at))
                shard, ranges = _shard_of(own[place - 1], shards), min(PASSES, shards)
                for k in range(ranges):  # what sorting needs is held for a part of the shards only
                    keep = np.flatnonzero((shard >= shards * k // ranges) & (shard < shards * (k + 1) // ranges))
                    at = place[keep]
                    for s, *packed in _messages(own[at - 2], own[at - 1], own[at], of[keep], None, shards):
                        yield _batch([(s, 0, 0, 0, 0, *packed)])
                del own, place, at, of, shard, keep
            K.trim()

    return run


class _Counts:
    """The trigrams of a shard: all whose middle word is of it, so that their histories u v, the bigrams v w with the
    number of u before each, and what follows v are whole here."""

    def __init__(self, messages: Iterator[dict]):
        parts = [_unpacked(m) for m in messages]
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]]))
        self.n = n = max(1, len(self.words))
        cols: list[list] = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int32)]
        self.lang = np.zeros(n, np.uint64)  # of each middle word
        while parts:
            words, mids, runs, langs, u, w, c = parts.pop()
            at = np.searchsorted(self.words, words)
            self.lang[at[mids]] = langs
            for col, x in zip(cols, (np.repeat(at[mids] * n, runs) + at[u], at[w].astype(np.int32), c.astype(np.int32)), strict=True):
                col.append(x)
        pair, w, c = (np.concatenate(x) for x in cols)
        del cols
        order = np.lexsort((w, pair))
        pair, w, c = pair[order], w[order], c[order].astype(np.int64)
        del order
        new = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        self.c3 = np.add.reduceat(c, new) if len(new) else np.zeros(0, np.int64)
        pair, self.w3 = pair[new], w[new]
        self.hist, self.of3 = np.unique(pair, return_inverse=True)
        self.v3 = pair // n
        self.bi, self.of2, self.c2 = np.unique(self.v3 * n + self.w3, return_inverse=True, return_counts=True)
        self.v2, self.w2 = self.bi // n, self.bi % n


def _survey(table: pa.Table) -> pa.Table:
    """Of a shard: how many v come before each w (kind 0), and by language the counts of counts of its trigrams and bigrams (31 to 34, 21 to 24)."""
    m = _Counts(table.to_pylist())
    w, n = np.unique(m.w2, return_counts=True)
    lang = np.zeros(m.n, np.uint64)
    lang[m.w2] = m.lang[m.v2]
    kind, lc, key, count = [np.zeros(len(w), np.int32)], [lang[w]], [m.words[w]], [n]
    for level, v, c in ((30, m.v3, m.c3), (20, m.v2, m.c2)):
        few = c <= 4
        x, k = np.unique(np.stack([m.lang[v[few]], c[few].astype(np.uint64)]), axis=1, return_counts=True)
        kind.append((level + x[1]).astype(np.int32)), lc.append(x[0]), key.append(np.zeros(len(k), np.uint64)), count.append(k)
    kind, lc, key, count = (np.concatenate(x) for x in (kind, lc, key, count))
    shard = pa.array([table.column("shard")[0].as_py()] * len(kind), pa.int32())
    del m
    K.trim()
    return pa.table({"shard": shard, "kind": kind, "lc": lc.view(np.int64), "w": key.view(np.int64), "n": count.astype(np.int64)})


def _discounts(n: dict[int, int]) -> list[float]:
    """The discounts of counts 1, 2 and more, from the counts of counts."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    return [max(0.1, min(k - (k + 1) * y * (n.get(k + 1, 0) / n[k] if n.get(k) else 0.0), k - 0.05)) for k in (1, 2, 3)]


def _answer(column: str, n: int):
    """What is known of the words of a shard in one message, which ``n`` tells from others."""

    def run(table: pa.Table) -> pa.Table:
        w = table.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        row = {"shard": table.column("shard")[0].as_py(), "part": 0, "block": 0, "n": n, "of": 0, "words": K.pack_sorted(w[order]), "mids": K.pack(table.column(column).to_numpy()[order])}
        return pa.Table.from_pylist([row], schema=_MESSAGE)

    return run


class Filter:
    """A Bloom filter of words, in 64-bit cells with four bits of one cell for each word."""

    def __init__(self, words: DataFrame, n: int, others: np.ndarray):
        self.bits = min(FILTER_WORDS_LOG2, max(6, (max(1, n) * FILTER_BITS // 64).bit_length()))
        bit = F.lit(0).cast("long")
        for k in range(4):
            bit = bit.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", F.col("w"), F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int")))
        found = words.select(F.call_function("shiftright", F.col("w"), F.lit(48 - self.bits)).cast("int").alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
        self.cells = np.zeros(1 << self.bits, dtype=np.uint64)
        self.cells[found.column("i").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
        np.bitwise_or.at(self.cells, (others >> np.uint64(48 - self.bits)).astype(np.int64), self._need(others))

    @staticmethod
    def _need(x: np.ndarray) -> np.ndarray:
        need = np.zeros(len(x), dtype=np.uint64)
        for k in range(4):
            need |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
        return need

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Whether each may be one of the words."""
        out = np.zeros(len(h), dtype=bool)
        for i in range(0, len(h), 1 << 18):
            x = h[i : i + (1 << 18)]
            need = self._need(x)
            out[i : i + (1 << 18)] = (self.cells[x >> np.uint64(48 - self.bits)] & need) == need
        return out


class Model:
    """Trigram counts and probabilities of words in ``shards`` by middle word, written; a filter of the words; the discounts
    by language; a language without a model has no row in ``langs``."""

    def __init__(self, sample: DataFrame, shards: int, names: list, scratch: Scratch):
        spark, self.shards = sample.sparkSession, shards
        counts = scratch.save(sample.mapInArrow(_count(shards), _MESSAGE_SQL))
        found = scratch.save(counts.groupBy("shard").applyInArrow(_survey, "shard int, kind int, lc long, w long, n long"))
        words = scratch.save(found.where("kind = 0").groupBy("lc", "w").agg(F.sum("n").alias("c")))
        # a few rows for each language, all of these
        own = words.groupBy("lc").agg(F.sum("c").alias("total"), F.count("*").alias("n"), *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()
        ranks: dict[tuple[int, int], dict[int, int]] = {}
        for r in found.where("kind > 0").groupBy("lc", "kind").agg(F.sum("n").alias("n")).collect():
            ranks.setdefault((r["lc"], r["kind"] // 10), {})[r["kind"] % 10] = r["n"]
        self.discounts, rows = {}, []
        code = {int(_lang_code(x).view(np.int64)): x for x in names}
        for r in own:
            d = _discounts({k: r[f"n{k}"] for k in (1, 2, 3, 4)})
            left = sum(x * k for x, k in zip(d, (r["n1"], r["n2"], r["n"] - r["n1"] - r["n2"]), strict=True))
            self.discounts[r["lc"]] = (_discounts(ranks.get((r["lc"], 2), {})), _discounts(ranks.get((r["lc"], 3), {})))
            rows.append((r["lc"], code[r["lc"]], float(r["total"]), left / r["total"] / (r["n"] + 1), *d))
        langs = spark.createDataFrame(rows, "lc long, lang string, total double, unseen double, d1 double, d2 double, d3 double")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p1 = (F.col("c") - off) / F.col("total") + F.col("unseen")
        values = words.join(F.broadcast(langs), "lc").select("w", p1.alias("p1"), F.round(F.ln(p1 / F.col("unseen")) * UNIT).cast("long").alias("v"))
        shard = F.call_function("shiftright", F.call_function("shiftright", F.col("w"), F.lit(16)) * shards, F.lit(32)).cast("int")
        saved = scratch.save(values.select(shard.alias("shard"), "w", "p1", "v"))
        asked = found.where("kind = 0").select("shard", "w").join(saved.select("w", "p1"), "w")
        told = asked.groupBy("shard").applyInArrow(_answer("p1", -1), _MESSAGE_SQL)
        told = told.unionByName(saved.groupBy("shard").applyInArrow(_answer("v", -2), _MESSAGE_SQL))
        self.parts = counts.unionByName(scratch.save(told))
        begins = K.mix(_BEGIN ^ np.array([x & (1 << 64) - 1 for x in code], dtype=np.uint64)) >> _SPARE
        self.filter = Filter(words, words.count(), begins)
        scratch.drop(found, words, saved)
        self.langs = langs.select("lang", F.ln("unseen").alias("log_unseen"))


def share_of(sizes: list[int], bound: int) -> int:
    """The most each may have, so that all together stay within ``bound`` and nothing is left unused."""
    left, n = bound, len(sizes)
    for i, x in enumerate(sorted(sizes)):
        if x * (n - i) > left:
            return left // (n - i)
        left -= x
    return bound


def _fit(trusted: DataFrame, train_docs: int | None, train_bytes: int | None) -> DataFrame:
    """``t_id, fit_lang, bytes`` of the training rows of ``trusted`` (t_id, turn, lang, bytes): all, or a sample where a bound is given."""
    every = trusted.where(F.pmod("turn", F.lit(2)) == 0)
    if train_docs is None and train_bytes is None:
        return every.select("t_id", F.col("lang").alias("fit_lang"), "bytes")
    most = every.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    train_docs, train_bytes = most["n"] if train_docs is None else train_docs, (most["b"] or 0) if train_bytes is None else train_bytes
    every = every.where(F.col("bytes") <= train_bytes).withColumn("key", F.coalesce("lang", F.lit(NO_LANGUAGE)))
    sizes = every.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()  # one row for each language
    most_docs, most_bytes = share_of([r["n"] for r in sizes], train_docs), share_of([r["b"] for r in sizes], train_bytes)
    every = every.where(F.col("bytes") <= most_bytes).withColumn("long", (F.col("bytes") > LONG * most_bytes).cast("int"))
    every = every.withColumn("part", F.shiftleft("long", CELLS_LOG2) + F.shiftright("turn", 64 - CELLS_LOG2).cast("int"))
    # a histogram first, so that the order of a language is only taken over little more than its share
    w = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = every.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    parts = parts.withColumns({"n0": F.sum("n").over(w) - F.col("n"), "b0": F.sum("b").over(w) - F.col("b")}).where((F.col("n0") < most_docs) & (F.col("b0") < most_bytes)).select("key", "part")
    w = Window.partitionBy("key").orderBy("long", "turn", "t_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = every.join(parts, ["key", "part"]).withColumns({"k": F.count("*").over(w), "run": F.sum("bytes").over(w)})
    return run.where((F.col("k") <= most_docs) & (F.col("run") <= most_bytes)).select("t_id", F.col("lang").alias("fit_lang"), "bytes")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, train_docs: int | None = None, train_bytes: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the ids (``t_id``) of the calibration documents."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("t_id")).agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("ok")).where("ok and t_id is not null")
    turn = F.xxhash64("t_id", F.lit(SEED))
    good = good.select("t_id", turn.alias("turn"))
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    trusted = texts.select("t_id", F.struct("lang", F.octet_length("text").cast("long").alias("bytes")).alias("x")).join(good, "t_id")
    trusted = scratch.save(trusted.groupBy("t_id", "turn").agg(F.min("x").alias("x")).select("t_id", "turn", "x.lang", "x.bytes"))
    fit = scratch.save(_fit(trusted, train_docs, train_bytes))
    # a bit for each id, so that few texts but those of the sample are shuffled
    cells = max(1, (fit.count() // 8).bit_length())
    cell = F.call_function("shiftrightunsigned", turn, F.lit(64 - cells))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", turn, F.lit(1)).bitwiseAND(F.lit(63)).cast("int"))
    bits = fit.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits"))
    texts = texts.withColumn("cell", cell).join(F.broadcast(bits), "cell").where(F.col("bits").bitwiseAND(bit) != 0).drop("cell", "bits")
    texts = texts.join(fit, "t_id").where(F.col("lang").eqNullSafe(F.col("fit_lang")) & (F.octet_length("text") == F.col("bytes")))
    sample = texts.dropDuplicates(["t_id"]).select("lang", "text")
    names = [r["lang"] for r in fit.select(F.col("fit_lang").alias("lang")).distinct().collect()]  # one row for each language
    n, size = fit.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    with _batches(docs.sparkSession, n, size):
        model = Model(sample, max(1, -(-size // (WORD_BYTES * SHARD_KEYS))), names, scratch)
    had = {r["lang"] for r in model.langs.select("lang").collect()}
    bare = {r["lang"] for r in trusted.select("lang").distinct().collect()} - had
    if bare:
        warnings.warn(f"no model, so everything is kept, in languages with trusted documents: {sorted(map(str, bare))}", stacklevel=2)
    return model, good.where(F.pmod("turn", F.lit(2)) == 1).select("t_id")


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple]:
    """``block, batch, raw, offsets`` of blocks of documents, named by their content, place and task."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        raw, offsets = K.text_bytes(batch.column("text"))
        total = int(offsets[-1] - offsets[0])
        for i, j in K.slices(offsets, max(1, -(-total // max(1, -(-total // block_bytes))))):
            name = hashlib.blake2b(raw[int(offsets[i]) : int(offsets[j])], digest_size=8, key=f"{task},{made}".encode())
            name.update(np.diff(offsets[i : j + 1]).tobytes())
            name.update(repr(batch.column("doc").slice(i, j - i).to_pylist()).encode())
            made += 1
            yield int.from_bytes(name.digest(), "little", signed=True), batch.slice(i, j - i), raw, offsets[i : j + 1]


def _explode(known, shards: int, first: int, end: int, parts: int, block_bytes: int):
    """Of each block one message for each shard from ``first`` to ``end`` that has any of its trigrams, a last word's with
    the end too; and in the first pass one that names its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch, raw, offsets in _blocks(batches, block_bytes):
            langs = batch.column("lang").to_pylist()
            codes, part = _codes(langs), block * 0x9E3779B1 % (1 << 32) % parts
            own, place, at = _occurrences(raw, offsets, codes)
            sizes = np.diff(at)
            if first == 0:
                head = pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(langs, pa.string()), pa.array(sizes, pa.int64())], names=["doc", "lang", "n_words"])
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, head.schema) as w:
                        w.write_batch(head)
                    named = sink.getvalue().to_pybytes()
                yield _batch([(block % end, part, block, -1, -1, named, *[None] * 6)])
            own[~known.value.passes(own)] = _UNKNOWN
            own = np.append(own, _END)
            has = np.flatnonzero(sizes)
            place = np.concatenate([place, place[at[1:][has] - 1] + 1])
            doc = np.concatenate([np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes), has.astype(np.uint32)])
            v = own[place - 1]
            shard = _shard_of(v, shards)
            keep = np.flatnonzero((shard >= first) & (shard < end) & (v != _UNKNOWN))
            del shard, v
            w = np.where(keep < at[-1], own[place[keep]], _END)
            place, doc = place[keep], doc[keep]
            out = [(s, part, block, batch.num_rows, *packed) for s, *packed in _messages(own[place - 2], own[place - 1], w, codes[doc], doc, shards)]
            del own, place, doc, keep, w
            for x in out:
                yield _batch([(*x[:4], len(out), *x[4:])])
            del out
            K.trim()

    return run


def _level(c: np.ndarray, of: np.ndarray, n: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The discounted share of each count within its context, and what each of the ``n`` contexts leaves to the order below."""
    total = np.bincount(of, c, n)
    rank = np.minimum(c, 3) - 1
    left = sum(np.bincount(of[rank == k], minlength=n) * d[:, k] for k in range(3))
    return (c - d[of, rank]) / total[of], left / np.maximum(total, 1)


def _units(x: np.ndarray) -> np.ndarray:
    return np.round(np.log(x) * UNIT).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of ``wanted`` among ascending keys, -1 where they are not."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    at[keys[at] != wanted] = -1
    return at


def _score_shard(discounts: dict):
    """One shard of the model and messages of blocks: the sums of each message, by document."""

    def run(messages: pa.Table, model: pa.Table) -> pa.Table:
        rows = model.to_pylist()
        m = _Counts([r for r in rows if r["n"] == 0])
        told = {r["n"]: (K.unpack_sorted(r["words"]), r["mids"]) for r in rows if r["n"] < 0}
        names, value = (told[-2][0], K.unpack(told[-2][1], np.int64)) if -2 in told else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out: list[tuple] = []
        if len(m.c3):
            p1 = K.unpack(told[-1][1], np.float64)[np.searchsorted(told[-1][0], m.words[m.w2])]
        del rows, told
        if len(m.c3):
            mids, of2 = np.unique(m.v2, return_inverse=True)
            d2, d3 = (np.array([discounts[x][k] for x in m.lang[mids].view(np.int64).tolist()]) for k in (0, 1))
            share, g2 = _level(m.c2, of2, len(mids), d2)
            p2 = share + g2[of2] * p1
            add2 = _units(p2 / (g2[of2] * p1))
            share, g3 = _level(m.c3, m.of3, len(m.hist), d3[np.searchsorted(mids, m.hist // m.n)])
            add3 = _units((share + g3[m.of3] * p2[m.of2]) / (g3[m.of3] * p2[m.of2]))
            g2, g3, tri = _units(g2), _units(g3), m.of3 * m.n + m.w3
            del share, p2, p1, of2
        for b in messages.to_batches(max_chunksize=1):
            r = b.to_pylist()[0]
            if r["n"] < 0:  # names documents, and goes through
                out.append((r["block"], -1, r["words"]))
                continue
            sums = np.zeros(r["n"], dtype=np.int64)
            words, v, runs, _, u, w, doc = _unpacked(r)
            if len(names):
                at = _find(names, words[v])
                np.add.at(sums, doc, np.repeat(np.where(at >= 0, value[at], 0), runs))
            if len(m.c3):
                at = _find(m.words, words)
                v = at[v]
                ctx = np.where(v >= 0, _find(mids, v), -1)
                has = np.repeat(ctx >= 0, runs) & (words[w] != _END)
                ctx, v, u, w, doc = np.repeat(ctx, runs)[has], np.repeat(v, runs)[has], at[u[has]], at[w[has]], doc[has]
                x = g2[ctx]
                bi = np.where(w >= 0, _find(m.bi, v * m.n + w), -1)
                k = np.flatnonzero(bi >= 0)
                x[k] += add2[bi[k]]
                hist = np.where(u >= 0, _find(m.hist, v * m.n + u), -1)
                k = np.flatnonzero(hist >= 0)
                x[k] += g3[hist[k]]
                k = k[bi[k] >= 0]
                t = _find(tri, hist[k] * m.n + w[k])
                k, t = k[t >= 0], t[t >= 0]
                x[k] += add3[t]
                np.add.at(sums, doc, x)
            out.append((r["block"], r["of"], K.pack(sums)))
        del m, messages, model
        K.trim()
        return _sums(out)

    return run


_SUMS_SQL = "block long, of int, data binary"


def _sums(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "of", "data"])


def _sum_block(table: pa.Table) -> pa.Table:
    """The documents of a block with their sums over all shards and passes (``level``); ``of`` says how many messages a pass
    made of it, so that a block that another run of its task made otherwise is not taken for this one."""
    of, level, data = table.column("of").to_pylist(), table.column("level").to_pylist(), table.column("data")
    heads = [k for k, x in enumerate(of) if x < 0]
    if len(heads) != 1 or any(n != sum(y == x for y, z in zip(level, of, strict=True) if z >= 0) for x, n in zip(level, of, strict=True) if n >= 0):
        raise ValueError("a block was not made as a whole; its task ran again with other rows")
    with pa.ipc.open_stream(data[heads[0]].as_py()) as r:
        out = r.read_all()
    sums = np.zeros(len(out), dtype=np.int64)
    for k, x in enumerate(of):
        if x >= 0:
            sums += K.unpack(data[k].as_py(), np.int64)
    return out.append_column("units", pa.array(sums, pa.int64()))


def score(docs: DataFrame, model: Model, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, lang, n_words, log_ppl`` for each row; log_ppl is null without words or model."""
    scratch = scratch or Scratch(docs.sparkSession, "quality", release=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = model.shards
    parts = -(-max(1, total) // (PART_BYTES * shards))  # one, where the model grows with the documents

    def copies(df: DataFrame) -> DataFrame:
        """A shard for each part of the blocks, so that no group grows beyond it."""
        return df.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("shard", "part")

    held, passes, sums = docs.sparkSession.sparkContext.broadcast(model.filter), min(PASSES, shards), None
    for k in range(passes):  # one after the other, so that their messages are not on disk together
        first, end = shards * k // passes, shards * (k + 1) // passes
        asked = rows.mapInArrow(_explode(held, shards, first, end, parts, BLOCK_BYTES), _MESSAGE_SQL)
        own = copies(model.parts.where((F.col("shard") >= first) & (F.col("shard") < end)))
        told = asked.groupBy("shard", "part").cogroup(own).applyInArrow(_score_shard(model.discounts), _SUMS_SQL)
        with _batches(docs.sparkSession, n, total):
            told = scratch.save(told.withColumn("level", F.lit(k)))
        sums = told if sums is None else sums.unionByName(told)
    found = sums.groupBy("block").applyInArrow(_sum_block, "doc long, lang string, n_words long, units long")
    langs = F.broadcast(model.langs.withColumnRenamed("lang", "of"))  # one row for each language
    found = found.join(langs, F.col("lang").eqNullSafe(F.col("of")), "left")
    log_ppl = F.when(F.col("n_words") > 0, F.round(-(F.col("units").cast("double") / UNIT / F.col("n_words") + F.col("log_unseen")), 6))
    return found.select(F.col("doc").alias("doc_id"), "lang", "n_words", log_ppl.alias("log_ppl"))


def _spread(words: str = "n_words"):
    """Standard deviation that the fit of a language (a, b, least) gives to documents of so many words."""
    return F.sqrt(F.greatest(F.col("a") + F.col("b") / F.col(words), F.col("least")))


def thresholds(scored: DataFrame, calibration: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``t_lang, mean, a, b, least, bar``, one row for each language: its bar is ``mean + bar * spread(words)``."""
    held = scored.where("log_ppl is not null").join(calibration, F.col("doc_id") == F.col("t_id")).select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("t_lang"), "n_words", "log_ppl")
    mean = held.groupBy("t_lang").agg(F.round(F.avg("log_ppl"), 6).alias("mean"))
    held = held.join(F.broadcast(mean), "t_lang")  # one row for each language, as the next
    square, short = F.pow(F.col("log_ppl") - F.col("mean"), 2), 1.0 / F.col("n_words")
    slope, whole = F.greatest(F.coalesce(F.regr_slope(square, short), F.lit(0.0)), F.lit(0.0)), F.avg(square)
    fit = held.groupBy("t_lang", "mean").agg(*[F.round(x, 6).alias(n) for n, x in (("b", slope), ("whole", whole), ("short", F.avg(short)))])
    least = F.greatest(F.col("whole") / 16, F.lit(1e-6))  # no spread is taken for less than a quarter of the whole one
    fit = fit.select("t_lang", "mean", (F.col("whole") - F.col("b") * F.col("short")).alias("a"), "b", least.alias("least"))
    cells = held.join(F.broadcast(fit.drop("mean")), "t_lang").select("t_lang", F.ceil((F.col("log_ppl") - F.col("mean")) / _spread() * STEP).alias("cell"))
    cells = cells.groupBy("t_lang", "cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy("t_lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.withColumns({"run": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("t_lang"))})
    bars = ranked.where(F.col("run") >= F.ceil(F.col("all") * quantile)).groupBy("t_lang").agg((F.min("cell") / STEP).alias("bar"))
    return fit.join(bars, "t_lang")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, train_docs: int | None = None, train_bytes: int | None = None) -> DataFrame:
    """``doc_id, lang, n_words, perplexity, threshold, kept`` for each row."""
    scratch = Scratch(docs.sparkSession, "quality", release=True)
    model, calibration = train(docs, labels, scratch, train_docs, train_bytes)
    scored = scratch.save(score(docs, model, scratch))
    return _judged(scored, scratch.save(thresholds(scored, calibration, quantile)))


def _judged(scored: DataFrame, bars: DataFrame) -> DataFrame:
    """Each document against the bar of its language and length; ``bars`` has one row for each language."""
    out = scored.join(F.broadcast(bars), F.coalesce("lang", F.lit(NO_LANGUAGE)) == F.col("t_lang"), "left")
    out = out.withColumn("limit", F.when(F.col("log_ppl").isNotNull(), F.round(F.col("mean") + F.col("bar") * _spread(), 6)))
    return out.select("doc_id", "lang", "n_words", F.exp("log_ppl").alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(F.col("log_ppl") <= F.col("limit"), F.lit(True)).alias("kept"))


def accept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, train_docs: int | None = None, train_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps. Rejected ids are shuffled, not the bars' languages."""
    gone = judge(docs, labels, quantile, train_docs, train_bytes).where("not kept and doc_id is not null").select("doc_id").distinct()
    return without(docs, gone)
