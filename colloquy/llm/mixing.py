"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are word counts. ``targets`` shares a budget over the sources by weight; no target passes ``most`` times its
source's size, and what is above is shared again by weight. Each source then takes every document as often as its target
holds the whole source, and fits the remaining budget with distinct documents: documents are counted by exact length,
whole seeded shares of each length are taken first, and a bounded-knapsack dynamic program over the lengths fills what
is left as closely as lengths allow, never above it. Which documents of a length go in is a seeded hash order.

Only the histogram (source, length, count) is grouped by source: a source of n words has at most sqrt(2n) lengths.
Documents never are. They get a rank, a seeded hash of id and text, and a cell (source, length) takes all below its cut,
which is found from counts by the leading bits of the ranks: only the ranks of the one bucket that the cut falls in are
sorted, ``BUCKETS`` times fewer than the cell has. So texts are only read, to be sized: what is shuffled is narrow, and
``mix`` meets the cells by a broadcast of at most ``BROADCAST_CELLS`` rows, counted, or else by a shuffled join.

Nulls: a null text has size 0; a null source is a source of its own, the last one. Documents of size 0 are taken as often
as the whole source is. Repeated rows count each for themselves; where the cut falls among equal rows, as many of them are
taken as fit. A source of size 0 has target 0. Empty tables give empty results. Extra columns are ignored by ``plan`` and
kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
SEED = 17
BUCKETS = 256
DP_WORDS = 1 << 16
BROADCAST_CELLS = 200_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sid, source_size, target`` from ``sid, source_size``, one row for each source; weights repeat in the order of sid.

    Water-filling: in the order of the rate at which sources fill up, each is full if the ones before leave a higher rate.
    """
    every, order = Window.partitionBy(), Window.orderBy("rate", "sid").rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(Window.orderBy("sid")) - 1) % len(weights) + 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("rate", F.col("cap") / F.col("w")).withColumns({"pot": budget * F.sum("source_size").over(every), "parts": F.sum("w").over(every)})
    before = (F.col("pot") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.col("parts") - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    s = s.withColumn("full", F.col("rate") <= before)
    left = F.col("pot") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    rate = F.try_divide(left, F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(rate * F.col("w"))).select("sid", "source_size", "target")


def fit(lengths: list[int], counts: list[int], budget: int, limit: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near ``budget`` as can be, not above.

    Shares in proportion first; then longest lengths while more than ``limit`` words are open; then the dynamic program
    on a bit set of reachable sums, over binary-split counts of what is left.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= limit:
            break
        if lengths[i]:
            more = min(counts[i] - take[i], (left - limit // 2) // lengths[i])
            if more > 0:
                take[i] += more
                left -= more * lengths[i]
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        spare, chunk = counts[i] - take[i], 1
        spare = min(spare, left // lengths[i]) if lengths[i] else 0
        while spare > 0 and not reach >> left & 1:
            use = min(chunk, spare)
            after = (reach | reach << use * lengths[i]) & mask
            if after != reach:
                steps.append((i, use, reach))
                reach = after
            spare, chunk = spare - use, chunk * 2
    at = reach.bit_length() - 1
    for i, use, before in reversed(steps):
        if not before >> at & 1:
            take[i] += use
            at -= use * lengths[i]
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].astype(int).tolist(), pdf["n"].astype(int).tolist()
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = int(target // source_size) if source_size else 0
    part = fit(lengths, counts, int(target - whole * source_size)) if source_size else [0] * len(lengths)
    return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "whole": whole, "part": part, "source_size": source_size, "target": target})


def quotas(histogram: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sid, size, whole, part, source_size, target`` from ``sid, size, n``; ``sid`` is the source's UTF-8 as hex, ``~`` for null."""
    sizes = histogram.groupBy("sid").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_source = histogram.join(targets(sizes, weights, budget, most), "sid")
    return by_source.groupBy("sid").applyInPandas(_fit_source, "sid string, size long, whole long, part long, source_size long, target double")


def _sid(source: str) -> Column:
    # hex of UTF-8 sorts as code points do, and "~" after all of it
    return F.coalesce(F.hex(F.encode(F.col(source).cast("string"), "UTF-8")), F.lit("~"))


def _placed(doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    rank = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text).cast("string"))
    return {"sid": _sid(source), "size": n_words(text), "rank": rank}


def _cells(placed: DataFrame, scratch: Scratch, weights: tuple, budget: float, most: float) -> DataFrame:
    """``sid, size, whole, source_size, target, cut, few, same``: each cell takes ranks below the cut, and ``few`` of the ``same`` on it."""
    bucket = F.call_function("shiftright", F.col("rank"), F.lit(56)).cast("int")
    narrow = placed.select("sid", "size", "rank", bucket.alias("bucket"))
    counts = scratch.save(narrow.groupBy("sid", "size", "bucket").agg(F.count("*").alias("n")))
    quota = scratch.save(quotas(counts.groupBy("sid", "size").agg(F.sum("n").alias("n")), weights, budget, most))
    w = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    open_ = counts.join(quota.where("part > 0").select("sid", "size", "part"), ["sid", "size"]).withColumn("open", F.col("part") - F.coalesce(F.sum("n").over(w), F.lit(0)))
    open_ = open_.where((F.col("open") > 0) & (F.col("open") <= F.col("n"))).select("sid", "size", "bucket", "open")  # one for each cell
    ties = Window.partitionBy("sid", "size", "bucket", "rank")
    in_order = Window.partitionBy("sid", "size", "bucket").orderBy("rank")
    sorted_ = narrow.join(open_, ["sid", "size", "bucket"]).withColumns({"k": F.row_number().over(in_order), "first": F.rank().over(in_order), "same": F.count("*").over(ties)})
    cuts = sorted_.where("k = open").select("sid", "size", F.col("rank").alias("cut"), (F.col("k") - F.col("first") + 1).alias("few"), "same")
    return scratch.save(quota.join(cuts, ["sid", "size"], "left").drop("part"))


def _copies(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """``placed`` with its cell's columns and ``copies``."""
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    out = placed.join(cells, ["sid", "size"])
    on = F.col("rank") == F.col("cut")
    if cells.where("few < same").head(1):  # equal rows on the cut
        nth = F.row_number().over(Window.partitionBy("sid", "size", "rank").orderBy(F.lit(0)))
        torn = on & (F.col("few") < F.col("same"))
        some = out.where(torn).withColumn("more", (nth <= F.col("few")).cast("long"))
        rest = out.where(~F.coalesce(torn, F.lit(False)))
    else:
        some, rest = None, out
    rest = rest.withColumn("more", F.coalesce(F.col("rank") <= F.col("cut"), F.lit(False)).cast("long"))
    both = rest if some is None else rest.unionByName(some)
    return both.withColumn("copies", F.col("whole") + F.col("more"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row."""
    scratch = Scratch(docs.sparkSession, "mix")
    placed = docs.select("doc_id", "text", "source").withColumns(_placed("doc_id", "text", "source", seed))
    placed = scratch.save(placed.select("doc_id", "sid", "size", "rank"))
    out = _copies(placed, _cells(placed, scratch, weights, budget, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixture: the rows of ``docs``, all columns, each as often as it is taken."""
    scratch, names = Scratch(docs.sparkSession, "mix"), docs.columns
    own = {c: f"_{k}" for k, c in enumerate(names)}
    renamed = docs.toDF(*own.values())
    placed = renamed.withColumns(_placed(own["doc_id"], own["text"], own["source"], seed))
    cells = _cells(scratch.save(placed.select("sid", "size", "rank")), scratch, weights, budget, most)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return _copies(placed, cells).select(*own.values(), copies.alias("i")).select(*[F.col(v).alias(c) for c, v in own.items()])
