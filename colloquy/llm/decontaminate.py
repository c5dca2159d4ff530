"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Items are indexed once (term -> postings with BM25 impacts in blocks with their maxima). Every passage of every document
(windows of twice the longest of all items, stepping by half of that, so that an item always lies whole in some window) is a
query for all items whose BM25 score is at least ``THRESHOLD`` of the score the item has with itself. Windows whose sums
of term maxima, within each of ``GROUPS`` ranges of items, all stay below the threshold are passed over without a look
at the postings: the block-max bound, taken over all windows of a slice at once. The others run block-max WAND. What is
retrieved is verified on the whole document: enough of the question's and of the answer's word n-grams must be there.

An item's answer is its last line, or its last sentence, or its last quarter of words; tables with question and answer
columns use those. Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased, as 64-bit hashes.

The index is broadcast. Items are cut into blocks of at most ``BLOCK_BYTES`` of text (measured), one index and one pass
for each, so the broadcast stays bounded however many items there are; document frequencies, mean length and the longest
item are those of all items, so the result does not depend on the blocks.

Nulls: items with a null or wordless text are ignored; a null text matches nothing. Repeated items count once for each
item_id; repeated documents each get their rows. Extra columns are ignored by ``matches`` and kept by ``clean``. Empty
tables: no items leave everything clean.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
BLOCK_BYTES = 1 << 20
POSTINGS = 64
GROUPS = 96


def _hashes(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return K.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True)[0]


def question_answer(text: str) -> tuple[str, str]:
    """The last line, else the last sentence, else the last quarter of the words, is the answer."""
    text = text.strip()
    head, mark, tail = text.rpartition("\n")
    if mark and head.strip() and tail.strip():
        return head, tail
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)", text)]
    if ends and text[ends[-1] :].strip():
        return text[: ends[-1]], text[ends[-1] :]
    parts = text.split()
    k = max(1, len(parts) * 3 // 4)
    return " ".join(parts[:k]), " ".join(parts[k:])


class Index:
    """BM25 impacts, as shares of the item's score with itself, in block-max posting lists."""

    def __init__(self, items: list[tuple], frequency: dict[int, int] | None, n_items: int, mean: float, longest: int):
        self.items, grams, lists = [], [], defaultdict(list)
        bags = []
        for item_id, question, answer in items:
            q, a = _hashes(question), _hashes(answer)
            bags.append(np.unique(np.concatenate([q, a]), return_counts=True))
            self.items.append(item_id)
            sides = []
            for side in (q, a):
                n = min(5, len(side))
                sides.append((n, np.unique(K.ngrams(side, n)) if n else np.zeros(0, np.uint64)))
            grams.append(sides)
        if frequency is None:
            frequency = defaultdict(int)
            for terms, _ in bags:
                for t in terms.tolist():
                    frequency[t] += 1
        for i, (terms, counts) in enumerate(bags):
            size = counts.sum()
            score = [math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for t, c in zip(terms.tolist(), counts.tolist(), strict=True)]
            whole = sum(score)
            for t, s in zip(terms.tolist(), score, strict=True):
                lists[t].append((i, s / whole))
        self.grams = grams
        self.terms = np.array(sorted(lists), dtype=np.uint64)
        self.lists, self.most = [], np.zeros(len(self.terms))
        for k, t in enumerate(self.terms.tolist()):
            posts = lists[t]
            blocks = [(posts[i : i + POSTINGS][-1][0], max(s for _, s in posts[i : i + POSTINGS])) for i in range(0, len(posts), POSTINGS)]
            self.lists.append(([p for p, _ in posts], [s for _, s in posts], blocks))
            self.most[k] = max(s for _, s in posts)
        n_groups = max(1, min(GROUPS, len(items)))
        self.groups = np.zeros((len(self.terms), n_groups), dtype=np.float32)
        for k in range(len(self.terms)):
            np.maximum.at(self.groups[k], np.array(self.lists[k][0]) * n_groups // len(items), self.lists[k][1])
        self.longest = longest

    def search(self, terms: list[int], threshold: float) -> dict[int, float]:
        """Block-max WAND: all items that share at least ``threshold`` of their score with the terms."""
        found: dict[int, float] = {}
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # item, place, term
        eps = 1e-12
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            shallow, ends = 0.0, []
            for c in cursors[: pivot + 1]:  # the block of each list that would hold the item
                blocks = self.lists[c[2]][2]
                b = c[1] // POSTINGS
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    shallow += blocks[b][1]
                    ends.append(blocks[b][0])
            if shallow < threshold - eps:  # no item up to the nearest block end can reach it
                to = min(ends, default=item) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
            elif cursors[0][0] == item:
                total = math.fsum(self.lists[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if total >= threshold - eps:
                    found[item] = total
                to = item + 1
            else:
                to = item
            for c in cursors[: pivot + 1]:
                items = self.lists[c[2]][0]
                while c[1] < len(items) and items[c[1]] < to:
                    c[1] += 1
                c[0] = items[c[1]] if c[1] < len(items) else 1 << 62
            cursors = [c for c in cursors if c[0] < 1 << 62]

    def overlap(self, item: int, present: dict[int, np.ndarray]) -> tuple[float, float]:
        out = []
        for n, grams in self.grams[item]:
            out.append(float(np.isin(grams, present[n], kind="sort").mean()) if n else 1.0)
        return out[0], out[1]


class Matcher:
    """Finds the items of one index in whole texts."""

    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.least = index, threshold, overlap
        self.step = max(1, index.longest)
        self.memo: OrderedDict[bytes, dict[int, float]] = OrderedDict()

    def _search(self, terms: np.ndarray) -> dict[int, float]:
        key = terms.tobytes()
        if key not in self.memo:
            self.memo[key] = self.index.search(terms.tolist(), self.threshold)
            if len(self.memo) > 4096:
                self.memo.popitem(last=False)
        return self.memo[key]

    def slice(self, h: np.ndarray, at: np.ndarray) -> list[list[tuple]]:
        """For each document its ``(item, score, question overlap, answer overlap, verified)``."""
        out: list[list[tuple]] = [[] for _ in range(len(at) - 1)]
        terms = self.index.terms
        if not len(h) or not len(terms):
            return out
        place = np.searchsorted(terms, h)
        place[place == len(terms)] = 0
        known = terms[place] == h
        sizes = np.diff(at)
        chunks = -(-sizes // self.step)
        first = np.concatenate([[0], np.cumsum(chunks)])
        # bounds of each chunk for each group of items, over its distinct terms; a window is two chunks
        owner = np.repeat(np.arange(len(sizes)), sizes)
        chunk = first[owner] + (np.arange(len(h)) - at[owner]) // self.step
        pairs = np.unique(chunk[known] * len(terms) + place[known])
        of, term = pairs // len(terms), pairs % len(terms)
        bound = np.zeros((first[-1] + 1, self.index.groups.shape[1]), dtype=np.float32)
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        if len(heads):
            bound[of[heads]] = np.add.reduceat(self.index.groups[term], heads, axis=0)
        windows = np.maximum(chunks - 1, np.minimum(chunks, 1))
        doc = np.repeat(np.arange(len(sizes)), windows)
        head = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        two = (chunks[doc] > 1).astype(np.float32)[:, None]
        open_ = ((bound[head] + two * bound[head + 1]).max(axis=1) >= self.threshold - 1e-4) if len(doc) else np.zeros(0, bool)
        start = at[doc] + (head - first[doc]) * self.step
        end = np.minimum(start + 2 * self.step, at[doc + 1])
        best: dict[tuple[int, int], float] = {}
        for w in np.flatnonzero(open_).tolist():
            mine = np.unique(place[start[w] : end[w]][known[start[w] : end[w]]])
            if self.index.groups[mine].sum(axis=0).max() >= self.threshold - 1e-4:
                for item, score in self._search(mine).items():
                    key = (int(doc[w]), item)
                    best[key] = max(best.get(key, 0.0), score)
        present: dict[int, np.ndarray] = {}
        last = -1
        for (d, item), score in sorted(best.items()):
            if d != last:
                last, present = d, {n: K.ngrams(h[at[d] : at[d + 1]], n) for n in range(1, 6)}
            q, a = self.index.overlap(item, present)
            out[d].append((self.index.items[item], score, q, a, q >= self.least and a >= self.least))
        return out


def _indexes(items: DataFrame) -> list[Index]:
    """One index for each block of items; a block's text is at most ``BLOCK_BYTES``, or one item."""
    if {"question", "answer"} <= set(items.columns):
        items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("question").cast("string").alias("q"), F.col("answer").cast("string").alias("a"))
    else:
        items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("q"), F.lit(None).cast("string").alias("a"))
    items = items.distinct().withColumn("bytes", F.octet_length(F.concat(F.coalesce("q", F.lit("")), F.coalesce("a", F.lit("")))))
    total = items.agg(F.sum("bytes")).first()[0] or 0
    n_blocks = max(1, math.ceil(2 * total / BLOCK_BYTES))
    blocked = items.withColumn("block", F.pmod(F.xxhash64("item_id", "q"), F.lit(n_blocks)))

    def load(rows) -> list[tuple]:
        out = []
        for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["q"] or "")):
            q, a = (r["q"] or "", r["a"]) if r["a"] is not None else question_answer(r["q"] or "")
            if len(_hashes(q)) + len(_hashes(a)):
                out.append((r["item_id"], q, a))
        return out

    if n_blocks == 1:
        rows = load(blocked.collect())  # at most BLOCK_BYTES, measured above
        sizes = [len(_hashes(q)) + len(_hashes(a)) for _, q, a in rows]
        return [Index(rows, None, len(rows), sum(sizes) / len(rows), max(sizes))] if rows else []
    # frequencies of all items for the terms of each block
    def count(batches):
        for batch in batches:
            block, term = [], []
            for b, q, a in zip(batch.column("block").to_pylist(), batch.column("q").to_pylist(), batch.column("a").to_pylist(), strict=True):
                q, a = (q or "", a) if a is not None else question_answer(q or "")
                seen = np.unique(np.concatenate([_hashes(q), _hashes(a)])).view(np.int64).tolist()
                block += [b] * len(seen)
                term += seen
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(term, pa.int64())], names=["block", "term"])

    terms = blocked.mapInArrow(count, "block long, term long")
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    per_block = terms.distinct().join(frequency, "term")
    from .mixing import n_words

    n_items, words, longest = items.withColumn("text", F.concat_ws(" ", "q", "a")).agg(F.count_if(n_words() > 0), F.sum(n_words()), F.max(n_words())).first()
    out = []
    for b in range(n_blocks):
        rows = load(blocked.where(F.col("block") == b).collect())
        df = {r[0] % (1 << 64): r[1] for r in per_block.where(F.col("block") == b).select("term", "df").collect()}
        if rows:
            out.append(Index(rows, df, n_items, words / n_items, longest))
    return out


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every verified match."""
    spark, rows = docs.sparkSession, _documents(docs)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index in _indexes(items):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, threshold, overlap)
            for batch in batches:
                raw, offsets = K.text_bytes(batch.column("text"))
                ids, found = batch.column("doc_id").to_pylist(), []
                for i, j in K.slices(offsets):
                    for d, hits in enumerate(matcher.slice(*K.words(raw, offsets[i : j + 1], lower=True))):
                        found += [(ids[i + d], item, round(s, 6), round(q, 6), round(a, 6)) for item, s, q, a, ok in hits if ok]
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no verified item; one narrow pass for each index, no shuffle."""
    spark, out = docs.sparkSession, docs
    for index in _indexes(items):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, threshold, overlap)
            for batch in batches:
                raw, offsets = K.text_bytes(batch.column("text").cast(pa.large_string()))
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, j in K.slices(offsets):
                    for d, hits in enumerate(matcher.slice(*K.words(raw, offsets[i : j + 1], lower=True))):
                        keep[i + d] = not any(ok for *_, ok in hits)
                K.trim()
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
