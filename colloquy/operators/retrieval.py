"""Retrieval ranking and open-set identification over unit vectors.

A search meets a stated set of queries with all vectors. Queries are the narrow side: they go out in blocks of at most
``BROADCAST_QUERIES``, counted, and vectors are scanned once for each block and never shuffled. Each task reduces what it
scores, to its best rows or to one score an entity, before anything leaves it; no row is made for a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_QUERIES = 10_000
ROWS = 256


def _blocks(queries: DataFrame, most: int):
    """``ids, matrix`` of the queries, broadcast in blocks."""
    spark, n = queries.sparkSession, queries.count()
    blocks = -(-n // most)
    rows = queries.select("query_id", "query_vec")
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)).isin(2 * b, 2 * b + 1))
        table = part.toArrow()  # of about ``most`` rows
        if table.num_rows:
            yield spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), _matrix(table.column("query_vec"))))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dots(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums from left to right, so that equal vectors score equally wherever they stand."""
    out = np.zeros((len(queries), len(vectors)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    return out


def _scored(batch: pa.RecordBatch, ids: pa.Array, queries: np.ndarray, exclude_self: bool):
    """For some queries at a time: their places, and their scores with all rows of the batch."""
    vectors = _matrix(batch.column("vec"))
    for i in range(0, len(ids), ROWS):
        s = _dots(queries[i : i + ROWS], vectors)
        if exclude_self:
            own = np.array(ids[i : i + ROWS].to_pylist(), dtype=object)[:, None] == np.array(batch.column("vec_id").to_pylist(), dtype=object)[None, :]
            s[own.astype(bool)] = -np.inf
        yield i, s


def search(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False, most: int = BROADCAST_QUERIES) -> DataFrame:
    """The ``k`` best vectors of each query: the columns of ``queries`` but its vector, ``vec_id, entity, score, rank``.

    ``queries``: query_id, query_vec and others; ``vectors``: vec_id, entity, vec, none null. Equal scores rank by
    vec_id. ``exclude_self`` leaves out a vector with the query's own id, for searches of a table in itself.
    """
    kinds = dict(vectors.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {kinds['vec_id']}, entity {kinds['entity']}, score double"
    out = queries.sparkSession.createDataFrame([], schema)
    for held in _blocks(queries, most):

        def run(batches, held=held):
            ids, matrix = held.value
            best: list[list[tuple]] = [[] for _ in range(len(ids))]
            names = None
            for batch in batches:
                names = batch.schema
                if not batch.num_rows:
                    continue
                batch = batch.take(pa.compute.sort_indices(batch.column("vec_id")))
                keys, entities = batch.column("vec_id").to_pylist(), batch.column("entity").to_pylist()
                for i, s in _scored(batch, ids, matrix, exclude_self):
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    for q, places in enumerate(top):
                        mine = [(-s[q, p], keys[p], entities[p]) for p in places if s[q, p] > -np.inf]
                        best[i + q] = sorted([*best[i + q], *mine], key=lambda x: x[:2])[:k]
            if names is not None:
                rows = [(ids[q].as_py(), key, entity, -s) for q, own in enumerate(best) for s, key, entity in own]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), pa.array(columns[1], names.field("vec_id").type), pa.array(columns[2], names.field("entity").type), pa.array(columns[3], pa.float64())], names=["query_id", "vec_id", "entity", "score"])

        out = out.unionByName(vectors.select("vec_id", "entity", "vec").mapInArrow(run, schema))
    return top_k(queries.drop("query_vec").join(out, "query_id"), k, item="vec_id")


def entity_scores(queries: DataFrame, vectors: DataFrame, exclude_self: bool = False, most: int = BROADCAST_QUERIES) -> DataFrame:
    """``score`` of each query with each entity, the most over its vectors: the columns of ``queries`` but its vector, ``entity, score``."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, entity {dict(vectors.dtypes)['entity']}, score double"
    out = queries.sparkSession.createDataFrame([], schema)
    for held in _blocks(queries, most):

        def run(batches, held=held):
            ids, matrix = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                coded = batch.column("entity").dictionary_encode()
                order = np.argsort(coded.indices.to_numpy(zero_copy_only=False), kind="stable")
                heads = np.flatnonzero(np.diff(coded.indices.to_numpy(zero_copy_only=False)[order], prepend=-1))
                for i, s in _scored(batch, ids, matrix, exclude_self):
                    pooled = np.maximum.reduceat(s[:, order], heads, axis=1)
                    q, e = np.nonzero(pooled > -np.inf)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + i)), coded.dictionary.take(pa.array(e)), pa.array(pooled[q, e])], names=["query_id", "entity", "score"])

        out = out.unionByName(vectors.where("entity is not null").select("vec_id", "entity", "vec").mapInArrow(run, schema))
    return queries.drop("query_vec").join(out.groupBy("query_id", "entity").agg(F.max("score").alias("score")), "query_id")


def max_pool(scored: DataFrame, *keys: str) -> DataFrame:
    """Score of an entity: the most over its vectors."""
    return scored.groupBy(*keys).agg(F.max("score").alias("score"))


def ranked(scored: DataFrame, query: str = "query_id", item: str = "entity") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(item))))


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "entity") -> DataFrame:
    return ranked(scored, query, item).where(F.col("rank") <= k)


def rank_metrics(hits: DataFrame, *by: str) -> DataFrame:
    """Recall at 1, 3, 5 and MRR from ``rank`` of the right item, null where it is absent."""
    at = [F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in (1, 3, 5)]
    return hits.groupBy(*by).agg(F.count("*").alias("n_queries"), *at, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def gate(scored: DataFrame, floor: float = 0.35, share: float = 0.8) -> DataFrame:
    """Adds ``passes`` (the best score of the query reaches the floor) and ``enters`` (this row is near enough to the best)."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumns({"passes": top >= floor, "enters": (top >= floor) & (F.col("score") >= F.greatest(F.lit(floor), share * top))})


def hybrid(scored: DataFrame, vector: float = 0.5, text: float = 0.3, recency: float = 0.1, length: float = 0.1) -> DataFrame:
    """Weighted score of ``score, text_score, recency, length``, each already on 0..1."""
    return scored.withColumn("hybrid", vector * F.col("score") + text * F.col("text_score") + recency * F.col("recency") + length * F.col("length"))


def within_months(rows: DataFrame, ts: str, as_of: str, months: int = 6) -> DataFrame:
    return rows.where(F.col(ts) >= F.add_months(F.lit(as_of).cast("date"), -months))


def identify(scored: DataFrame, bar: float = 0.34, margin: float = 0.02, suggest: float = 0.28) -> DataFrame:
    """``query_id, person, top1, top2, outcome`` (correct, wrong, refused) and ``tier`` from profile scores and ``truth``.

    Refused below the bar, and where the two best profiles are closer than the margin. Between the suggestion bar and the
    bar the best profile is a suggestion.
    """
    two = top_k(scored, 2).groupBy("query_id", "truth").agg(F.max(F.when(F.col("rank") == 1, F.col("entity"))).alias("person"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"))
    sure = (F.col("top1") >= bar) & F.coalesce(F.col("top1") - F.col("top2") >= margin, F.lit(True))
    outcome = F.when(~sure, "refused").when(F.col("person") == F.col("truth"), "correct").otherwise("wrong")
    tier = F.when(sure, "named").when(F.col("top1") >= suggest, "suggested").otherwise("none")
    return two.withColumns({"outcome": outcome, "tier": tier})


def wilson(k, n, z: float = 1.959963984540054):
    """Low and high end of the 95 % interval of k successes in n."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def outcome_rates(trials: DataFrame, *by: str) -> DataFrame:
    """Correct, wrong and refused apart, never blended, with Wilson bounds on wrong."""
    out = trials.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "refused")])
    low, high = wilson(F.col("wrong"), F.col("n"))
    return out.withColumns({"wrong_low": low, "wrong_high": high})


def holdout(prints: DataFrame) -> DataFrame:
    """The newest session of each speaker is the probe, the others enrol."""
    w = Window.partitionBy("speaker").orderBy(F.col("session").desc())
    return prints.withColumn("role", F.when(F.row_number().over(w) == 1, "probe").otherwise("enrol"))


def impostors(people: DataFrame) -> DataFrame:
    """Pairs of different speakers who share a room, once each way."""
    a, b = people.select("room", F.col("speaker").alias("a")).distinct(), people.select("room", F.col("speaker").alias("b")).distinct()
    return a.join(b, "room").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("rooms"))


def heard(turns: DataFrame) -> DataFrame:
    """Running speech of each speaker before and with each turn."""
    w = Window.partitionBy("file_id", "speaker").orderBy("start_ms", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("heard_ms", F.sum("ms").over(w))


def enrolled(turns: DataFrame, least_ms: int = 20_000, least_turns: int = 2) -> DataFrame:
    return turns.groupBy("file_id", "speaker").agg(F.sum("ms").alias("ms"), F.count("*").alias("n_turns")).where((F.col("ms") >= least_ms) & (F.col("n_turns") >= least_turns))


def raised_bars(prints: DataFrame, bar: float = 0.34, slope: float = 0.5) -> DataFrame:
    """Per-print bar: raised by ``slope`` of what the nearest print of another person has above it. ``prints``: the profile library."""
    a = prints.select(F.col("vec_id").alias("query_id"), F.col("entity").alias("person"), F.col("vec").alias("query_vec"))
    near = entity_scores(a, prints).where("person <> entity").groupBy("query_id", "person").agg(F.max("score").alias("nearest"))
    return near.withColumn("bar", F.lit(bar) + slope * F.greatest(F.lit(0.0), F.col("nearest") - bar))


def _sums(prints: DataFrame) -> DataFrame:
    parts = prints.select("entity", F.posexplode("vec").alias("i", "x")).groupBy("entity", "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("xx"), F.count("*").alias("n"))
    return parts


def mean_profile(prints: DataFrame) -> DataFrame:
    """``entity, vec``: the mean of a person's prints, position by position."""
    parts = _sums(prints).withColumn("x", F.col("x") / F.col("n"))
    return parts.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def unit(vec):
    """A vector scaled to length 1; a zero vector stays."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def consistency(prints: DataFrame, floor: float = 0.0) -> DataFrame:
    """``entity, n, similarity, agrees``: the mean similarity of a cluster's pairs of prints, and whether it reaches the floor.

    From the sum of the vectors and of their squares, (|sum|^2 - squares) / (n (n - 1)): no pair is made. A lone print agrees.
    """
    whole = _sums(prints).groupBy("entity").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("square"), F.sum("xx").alias("own"))
    similarity = F.try_divide(F.col("square") - F.col("own"), F.col("n") * (F.col("n") - 1))
    return whole.select("entity", "n", similarity.alias("similarity")).withColumn("agrees", F.coalesce(F.col("similarity") >= floor, F.lit(True)))


def text_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, entity, text_score``: BM25 of each query's distinct words (``query_id, words``) with each entity's (``entity, words``),
    as a share of the query's best. Relational: terms are counted by entity before they meet the queries."""
    terms = docs.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("tf"))
    sizes = terms.groupBy("entity").agg(F.sum("tf").alias("size"))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))  # one row
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(whole), F.lit(True)).withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    hits = asked.join(terms, "term").join(idf, "term").join(sizes, "entity")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    found = hits.groupBy("query_id", "entity").agg(F.sum(part).alias("text_score"))
    return found.withColumn("text_score", F.try_divide("text_score", F.max("text_score").over(Window.partitionBy("query_id"))))


def gate_outcomes(best: DataFrame) -> DataFrame:
    """From each query's best row (``passes``, ``right``, ``positive``: there is something to find): what the gate lets through and what it silences."""
    hit = lambda *c: F.count_if(F.coalesce(c[0] & c[1] if len(c) == 2 else c[0], F.lit(False)))
    pos, ok = F.col("positive"), F.col("passes")
    return best.agg(F.count_if(pos).alias("n_positive"), hit(pos, ok).alias("n_pass"), hit(pos & ok, F.col("right")).alias("n_right"), F.count_if(~pos).alias("n_negative"), hit(~pos, ~ok).alias("n_silenced"))
