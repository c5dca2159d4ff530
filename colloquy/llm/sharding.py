"""Extendible hashing of documents into shards of bounded bytes.

The directory is indexed by the leading bits of a 60-bit hash of the document id. A bucket is the shortest hash prefix
whose documents fit the byte limit, so only oversized buckets split, each on one more bit. Sizes per prefix come from
one pre-aggregated histogram of the leading bits (a few more than the shards need); cells that are still too large get a
histogram of their next bits, and so on to the end of the hash. What even the whole hash cannot part (one document above
the limit, or repeated rows of one id) goes to overflow pages of a bucket of full depth, the way extendible hashing
chains full pages: documents of at most half the limit fill pages in order, larger ones get a page each. Only a single
document above the limit leaves a page above it.

Nulls: a null id hashes as its text, a null text has 0 bytes. Repeated rows count as often as they occur. Other columns
are kept as they are, whatever their names, but for the five of the result, which are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

HASH_BITS = 60
MOST_BITS = 20
BROADCAST_CELLS = 1 << 16
_OUT = ("shard_depth", "shard_prefix", "shard_page", "shard_bytes", "shard_docs")


def _hash(column: str, text: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.col(text).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _shift(column: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(column), by.cast("int"))


def directory(sized: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """For each level its bits and ``cell, depth, prefix, bytes, n_docs``: the bucket of every hash cell; a cell that
    belongs to a deeper level is not there. ``sized`` has ``__h`` and ``__bytes``."""
    total = sized.agg(F.sum("__bytes")).first()[0] or 0
    step = min(MOST_BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 3))
    levels, todo, base = [], sized.select("__h", "__bytes"), 0
    while True:
        top = min(base + step, HASH_BITS)
        cells = scratch.save(todo.groupBy(_shift("__h", F.lit(HASH_BITS - top)).alias("cell")).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")))
        paths = cells.select("cell", "b", "n", "lo", "hi", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).withColumn("prefix", _shift("cell", F.lit(top) - F.col("depth")))
        nodes = paths.groupBy("depth", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("n_docs"))
        fit = paths.join(nodes, ["depth", "prefix"]).where(F.col("bytes") <= limit)
        first = fit.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "bytes", "n_docs")).alias("x")).select("cell", "x.*")
        # one hash alone above the limit: no bit parts it
        stuck = cells.where((F.col("b") > limit) & (F.col("lo") == F.col("hi"))).select("cell", F.lit(HASH_BITS).alias("depth"), F.col("lo").alias("prefix"), F.col("b").alias("bytes"), F.col("n").alias("n_docs"))
        levels.append((top, scratch.save(first.unionByName(stuck))))
        large = cells.where((F.col("b") > limit) & (F.col("lo") < F.col("hi"))).select("cell")
        if top == HASH_BITS or not large.head(1):
            return levels
        todo = todo.withColumn("cell", _shift("__h", F.lit(HASH_BITS - top))).join(large, "cell", "left_semi").drop("cell")
        base = top


def shard(docs: DataFrame, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``shard_depth, shard_prefix, shard_page, shard_bytes, shard_docs``.

    Documents meet the directory by an equi-join on their cell. It is broadcast when it has at most
    ``BROADCAST_CELLS`` cells, counted; a larger one is shuffled. ``shard_page`` is 0 but in overflow buckets.
    """
    if limit <= 0:
        raise ValueError("the byte limit must be positive")
    scratch = Scratch(docs.sparkSession, "shard")
    names = [c for c in docs.columns if c not in _OUT]
    own = {c: f"_{k}" for k, c in enumerate(names)}
    docs = docs.select(*names).toDF(*own.values())
    text_column = own[text_column]
    sized = docs.withColumns({"__h": _hash(own[id_column], text_column), "__bytes": F.coalesce(F.octet_length(F.col(text_column).cast("string")), F.lit(0)).cast("long"), "__tie": F.xxhash64(F.col(text_column).cast("string"))})
    out = sized.withColumns({"shard_depth": F.lit(None).cast("int"), "shard_prefix": F.lit(None).cast("long"), "shard_bytes": F.lit(None).cast("long"), "shard_docs": F.lit(None).cast("long")})
    stuck = False
    for top, cells in directory(sized, limit, scratch):
        size, deepest = cells.agg(F.count("*"), F.max("depth")).first()
        stuck = stuck or (deepest == HASH_BITS)
        found = cells.select(F.col("cell").alias("__cell"), F.col("depth").alias("__depth"), F.col("prefix").alias("__prefix"), F.col("bytes").alias("__total"), F.col("n_docs").alias("__docs"))
        found = F.broadcast(found) if size <= BROADCAST_CELLS else found
        at = _shift("__h", F.lit(HASH_BITS - top))
        out = out.join(found, (at == F.col("__cell")) & F.col("shard_depth").isNull(), "left").withColumns({
            "shard_depth": F.coalesce("shard_depth", "__depth"), "shard_prefix": F.coalesce("shard_prefix", "__prefix"),
            "shard_bytes": F.coalesce("shard_bytes", "__total"), "shard_docs": F.coalesce("shard_docs", "__docs"),
        }).drop("__cell", "__depth", "__prefix", "__total", "__docs")
    out = out.withColumn("shard_page", F.lit(0).cast("long"))
    if stuck:
        over = (F.col("shard_depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
        tail = out.where(over).withColumn("__small", F.col("__bytes") * 2 <= limit)
        w = Window.partitionBy("shard_prefix", "__small").orderBy("__bytes", "__tie").rowsBetween(Window.unboundedPreceding, -1)
        tail = tail.withColumn("__page", F.when(F.col("__small"), F.floor(F.coalesce(F.sum("__bytes").over(w), F.lit(0)) * 2 / limit)).otherwise(F.count("*").over(w)).cast("long"))
        pages = tail.where("__small").groupBy("shard_prefix").agg((F.max("__page") + 1).alias("__before"))
        tail = tail.join(pages, "shard_prefix", "left").withColumn("shard_page", F.col("__page") + F.when(F.col("__small"), 0).otherwise(F.coalesce("__before", F.lit(0))))
        out = out.where(~over).unionByName(tail.select(out.columns))
    return out.select(*[F.col(v).alias(c) for c, v in own.items()], *_OUT)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows of a shard meet in one task, whose bytes the limit bounds."""
    name = F.concat_ws("-", "shard_depth", "shard_prefix", "shard_page")
    sharded.withColumn("shard", name).repartition("shard").drop(*_OUT).write.partitionBy("shard").parquet(path)
