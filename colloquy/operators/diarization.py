"""Diarization error as interval algebra: a delta sweep into atoms, optimal label matching, and weighted roll-ups.

All times are whole milliseconds. Segments are ``file_id, side (ref/hyp), speaker, start_ms, end_ms``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import ratio

HALF_COLLAR_MS = 125


def dedupe_spans(segments: DataFrame, order: str = "line") -> DataFrame:
    """Two labels on one identical span of a side: the last line stays. Empty segments go."""
    w = Window.partitionBy("file_id", "side", "start_ms", "end_ms").orderBy(F.col(order).desc())
    return segments.where("end_ms > start_ms").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def atoms(segments: DataFrame, half_collar_ms: int = HALF_COLLAR_MS, uem: DataFrame | None = None) -> DataFrame:
    """``file_id, start_ms, end_ms, ref, hyp``: maximal intervals between boundaries, with sorted arrays of active labels.

    Collars around reference boundaries and, if ``uem`` is given for a file, what lies outside it are cut out. Boundaries
    are numbered, each label's running sum of +1/-1 deltas says where it is on, and an interval that is on goes to the
    numbers it covers: no range join, no grid of boundaries and labels, and one exchange, by file, for all of it.
    """
    segments = segments.where("end_ms > start_ms")
    edge = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d"))))
    half = F.lit(half_collar_ms).cast("long")
    around = [F.struct((F.col(b) + k * half).alias("t"), F.lit(-k).alias("d"), F.lit("collar").alias("side"), F.lit("").alias("speaker")) for b in ("start_ms", "end_ms") for k in (-1, 1)]
    own = [F.struct(F.col(b).alias("t"), F.lit(d).alias("d"), "side", "speaker") for b, d in (("start_ms", 1), ("end_ms", -1))]
    every = F.array(*own) if not half_collar_ms else F.when(F.col("side") == "ref", F.array(*own, *around)).otherwise(F.array(*own))
    deltas = segments.select("file_id", F.explode(every).alias("e")).select("file_id", "e.side", "e.speaker", "e.t", "e.d")
    if uem is not None:
        region = uem.select("file_id", F.lit("uem").alias("side"), F.lit("").alias("speaker"), edge.alias("e")).select("file_id", "side", "speaker", "e.t", "e.d")
        deltas = deltas.unionByName(region)
    deltas = deltas.repartition("file_id").groupBy("file_id", "side", "speaker", "t").agg(F.sum("d").alias("d"))
    by_file, by_label = Window.partitionBy("file_id"), Window.partitionBy("file_id", "side", "speaker").orderBy("t")
    steps = deltas.withColumns({"i": F.dense_rank().over(by_file.orderBy("t")), "has_uem": F.max(F.col("side") == "uem").over(by_file)})
    steps = steps.withColumns({"on": F.sum("d").over(by_label.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0, "upto": F.lead("i").over(by_label)})
    last = F.when(F.col("on") & F.col("upto").isNotNull(), F.col("upto") - 1).otherwise(F.col("i"))
    cover = steps.select("file_id", "side", "speaker", "has_uem", "on", "t", F.posexplode(F.sequence("i", last)).alias("k", "i"))

    def active(side: str):
        return F.sort_array(F.collect_set(F.when((F.col("side") == side) & F.col("on"), F.col("speaker"))))

    seen = lambda side: F.max((F.col("side") == side) & F.col("on"))
    out = cover.groupBy("file_id", "i").agg(F.min(F.when(F.col("k") == 0, F.col("t"))).alias("start_ms"), active("ref").alias("ref"), active("hyp").alias("hyp"), seen("collar").alias("cut"), (seen("uem") | ~F.max("has_uem")).alias("scored"))
    out = out.withColumn("end_ms", F.lead("start_ms").over(by_file.orderBy("i")))
    return out.where("end_ms is not null and not cut and scored and (size(ref) > 0 or size(hyp) > 0)").select("file_id", "start_ms", "end_ms", "ref", "hyp")


def cooccurrence(found: DataFrame) -> DataFrame:
    """``file_id, ref, hyp, ms`` of every pair of labels that speak together."""
    pairs = found.select("file_id", (F.col("end_ms") - F.col("start_ms")).alias("d"), F.explode("ref").alias("ref"), "hyp").select("file_id", "d", "ref", F.explode("hyp").alias("hyp"))
    return pairs.groupBy("file_id", "ref", "hyp").agg(F.sum("d").alias("ms"))


def _hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in a square matrix at least total cost, by augmenting shortest paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[col] = True
            free = ~used
            free[0] = False
            gap = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = free[1:] & (gap < low[1:])
            low[1:][better], way[1:][better] = gap[better], col
            nxt = int(np.flatnonzero(free)[np.argmin(low[free])])
            step = low[nxt]
            u[match[used]] += step
            v[used] -= step
            low[free] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = [0] * n
    for col in range(1, n + 1):
        out[match[col] - 1] = col - 1
    return out


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    refs, hyps = sorted(pdf["ref"].unique()), sorted(pdf["hyp"].unique())
    n = max(len(refs), len(hyps))
    gain = np.zeros((n, n))
    for r, h, ms in zip(pdf["ref"], pdf["hyp"], pdf["ms"], strict=True):
        gain[refs.index(r), hyps.index(h)] = ms
    rows = [(pdf["file_id"].iloc[0], r, hyps[c], int(gain[i, c])) for i, (r, c) in enumerate(zip(refs, _hungarian(-gain), strict=False)) if c < len(hyps) and gain[i, c] > 0]
    return pd.DataFrame(rows, columns=["file_id", "ref", "hyp", "ms"])


def assignment(pairs: DataFrame) -> DataFrame:
    """The one-to-one matching of labels with most common time; one group is the label pairs of a file, never its segments."""
    kind = dict(pairs.dtypes)["file_id"]
    return pairs.groupBy("file_id").applyInPandas(_assign, f"file_id {kind}, ref string, hyp string, ms long")


def components(found: DataFrame, matched: DataFrame) -> DataFrame:
    """``file_id, total_ms, missed_ms, fa_ms, confusion_ms``."""
    d, r, h = F.col("end_ms") - F.col("start_ms"), F.size("ref"), F.size("hyp")
    sums = found.groupBy("file_id").agg(
        F.sum(d * r).alias("total_ms"), F.sum(d * F.greatest(F.lit(0), r - h)).alias("missed_ms"), F.sum(d * F.greatest(F.lit(0), h - r)).alias("fa_ms"), F.sum(d * F.least(r, h)).alias("both")
    )
    right = matched.groupBy("file_id").agg(F.sum("ms").alias("right"))
    return sums.join(right, "file_id", "left").select("file_id", "total_ms", "missed_ms", "fa_ms", (F.col("both") - F.coalesce("right", F.lit(0))).alias("confusion_ms"))


def rates(parts: DataFrame) -> DataFrame:
    """Adds der and its component rates. Without reference time the rates are 0, and der is 1 if there is any error."""
    error = F.col("missed_ms") + F.col("fa_ms") + F.col("confusion_ms")
    return parts.withColumns({
        "der": F.when(F.col("total_ms") > 0, error / F.col("total_ms")).otherwise((error > 0).cast("double")), "missed": ratio("missed_ms", "total_ms"), "fa": ratio("fa_ms", "total_ms"), "confusion": ratio("confusion_ms", "total_ms"),
    })


def _file_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = pdf[pdf["ref"].isna()]
    pairs = pdf[pdf["ref"].notna()]
    right = int(_assign(pairs.rename(columns={"key": "file_id"}))["ms"].sum()) if len(pairs) else 0
    total, missed, fa, both = (int(whole[c].sum()) for c in ("total", "missed", "fa", "both"))
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "total_ms": [total], "missed_ms": [missed], "fa_ms": [fa], "confusion_ms": [both - right]})


def parts(found: DataFrame) -> DataFrame:
    """What ``components`` of the best matching gives, by ``key`` (the id as JSON), in one pass over the atoms: a file's label
    pairs and its sums meet in one group."""
    d, r, h = F.col("end_ms") - F.col("start_ms"), F.size("ref"), F.size("hyp")
    pairs = F.flatten(F.transform("ref", lambda x: F.transform("hyp", lambda y: F.struct(x.alias("ref"), y.alias("hyp")))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("hyp")))
    rows = found.select("file_id", d.alias("ms"), (d * r).alias("total"), (d * F.greatest(F.lit(0), r - h)).alias("missed"), (d * F.greatest(F.lit(0), h - r)).alias("fa"), (d * F.least(r, h)).alias("both"), F.explode(F.concat(none, pairs)).alias("p"))
    sums = rows.groupBy("file_id", "p.ref", "p.hyp").agg(*[F.sum(c).alias(c) for c in ("ms", "total", "missed", "fa", "both")])
    keyed = sums.select(_key(), "ref", "hyp", "ms", "total", "missed", "fa", "both")
    return keyed.groupBy("key").applyInPandas(_file_parts, "key string, total_ms long, missed_ms long, fa_ms long, confusion_ms long")


def _key():
    """A file's id as text, whatever its type, for Python groups."""
    return F.to_json(F.struct("file_id")).alias("key")


def der_by_file(segments: DataFrame, half_collar_ms: int = HALF_COLLAR_MS, uem: DataFrame | None = None, dedupe_identical_spans: bool = False, order: str = "line") -> DataFrame:
    """Per-file error of the files that both sides have, with speakers counted before any cropping.

    With ``dedupe_identical_spans`` two labels on one span of a side count as the later line's only.
    """
    if dedupe_identical_spans:
        segments = dedupe_spans(segments, order)
    speakers = lambda side: F.size(F.collect_set(F.when(F.col("side") == side, F.col("speaker")))).cast("long")
    both = segments.groupBy("file_id").agg(speakers("ref").alias("n_ref_speakers"), speakers("hyp").alias("n_hyp_speakers"))
    scored = both.where("n_ref_speakers > 0 and n_hyp_speakers > 0")
    done = scored.withColumn("key", _key()).join(parts(atoms(segments, half_collar_ms, uem)), "key", "left").drop("key")
    return rates(done.na.fill(0, ["total_ms", "missed_ms", "fa_ms", "confusion_ms"]))


def with_ref_ms(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``ref_ms``: the scored reference time, or the union of all reference speech where nothing was scored."""
    spoken = turns(segments.where("side = 'ref' and end_ms > start_ms").withColumn("speaker", F.lit("")), 0)
    whole = spoken.groupBy("file_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken"))
    return files.join(whole, "file_id", "left").withColumn("ref_ms", F.when(F.col("total_ms") > 0, F.col("total_ms")).otherwise(F.coalesce("spoken", F.lit(0)))).drop("spoken")


def skipped(segments: DataFrame) -> DataFrame:
    """Reference files without a hypothesis."""
    ref = segments.where("side = 'ref'").select("file_id").distinct()
    return ref.join(segments.where("side = 'hyp'").select("file_id").distinct(), "file_id", "left_anti")


def weighted(files: DataFrame, by: list[str], rollup: bool = False) -> DataFrame:
    """Duration-weighted rates of each group (pooled error over pooled time), and of all if ``rollup``."""
    grouped = files.rollup(*by) if rollup else files.groupBy(*by)
    sums = grouped.agg(F.count("*").alias("n_files"), *[F.sum(f"{k}_ms").alias(f"{k}_ms") for k in ("total", "missed", "fa", "confusion")])
    return sums.withColumns({"der": ratio(F.col("missed_ms") + F.col("fa_ms") + F.col("confusion_ms"), "total_ms"), "missed": ratio("missed_ms", "total_ms"), "fa": ratio("fa_ms", "total_ms"), "confusion": ratio("confusion_ms", "total_ms"), "saa": 1 - ratio("confusion_ms", "total_ms")})


def turns(segments: DataFrame, gap_ms: int = 500) -> DataFrame:
    """``file_id, speaker, turn, start_ms, end_ms, n_segments``: same-speaker segments merged across gaps up to ``gap_ms``."""
    w = Window.partitionBy("file_id", "speaker").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0)
    marked = segments.withColumn("__new", new).withColumn("turn", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("file_id", "speaker", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_segments"))


def runs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Consecutive rows with one value, whatever the pause between them: ``run`` numbers them."""
    w = Window.partitionBy(*key).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__c")


def spans(found: DataFrame, spoken: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """Joins turns to the atoms they cover, over time bins; a pair counts only in the bin where both begin to overlap."""
    def binned(df: DataFrame, prefix: str) -> DataFrame:
        names = {"start_ms": f"{prefix}_start", "end_ms": f"{prefix}_end"}
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms)))).withColumnsRenamed(names)

    a, t = binned(found, "a"), binned(spoken, "t")
    both = a.join(t, ["file_id", "bin"]).where("a_start < t_end and t_start < a_end")
    return both.where(F.col("bin") == F.floor(F.greatest("a_start", "t_start") / bin_ms)).withColumn("ms", F.least("a_end", "t_end") - F.greatest("a_start", "t_start"))


def turn_accuracy(spoken: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """Per turn: transcribed time, time under the mapped label, overlapped time, and whether it is right.

    Right means that most of the transcribed time in its span has the label matched to its speaker; overlapped, that more
    than half of it coincides with other reference speech.
    """
    named = spoken.join(matched.select("file_id", F.col("ref").alias("speaker"), F.col("hyp").alias("mapped")), ["file_id", "speaker"], "left")
    cover = spans(found, named)
    sums = cover.groupBy("file_id", "speaker", "turn").agg(
        F.sum(F.col("ms") * F.size("hyp")).alias("said_ms"), F.sum(F.when(F.array_contains("hyp", F.col("mapped")), F.col("ms")).otherwise(0)).alias("right_ms"),
        F.sum(F.when(F.size(F.array_except("ref", F.array("speaker"))) > 0, F.col("ms")).otherwise(0)).alias("over_ms"),
    )
    out = named.join(sums, ["file_id", "speaker", "turn"], "left").na.fill(0, ["said_ms", "right_ms", "over_ms"])
    length = F.col("end_ms") - F.col("start_ms")
    return out.withColumns({"ms": length, "right": 2 * F.col("right_ms") > F.col("said_ms"), "untranscribed": F.col("said_ms") == 0, "overlapped": 2 * F.col("over_ms") > length})


def phantoms(pairs: DataFrame) -> DataFrame:
    """``file_id, n_phantoms``: hypothesis labels beyond the first of their dominant reference speaker."""
    best = Window.partitionBy("file_id", "hyp").orderBy(F.col("ms").desc(), "ref")
    top = pairs.withColumn("__k", F.row_number().over(best)).where("__k = 1")
    rank = Window.partitionBy("file_id", "ref").orderBy(F.col("ms").desc(), "hyp")
    return top.withColumn("k", F.row_number().over(rank)).groupBy("file_id").agg(F.count_if(F.col("k") > 1).alias("n_phantoms"))


def speaker_counts(files: DataFrame) -> DataFrame:
    sign = F.signum(F.col("n_hyp_speakers") - F.col("n_ref_speakers"))
    return files.withColumn("speaker_list", F.when(sign > 0, "extra").when(sign < 0, "missing").otherwise("exact"))


def intersect_ms(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file_id, ms`` in both of two interval sets, each merged first."""
    merged = [turns(x.withColumn("speaker", F.lit("")), 0).select("file_id", F.lit(i).alias("turn"), "start_ms", "end_ms") for i, x in enumerate((a, b))]
    return spans(merged[0].drop("turn"), merged[1].drop("turn")).groupBy("file_id").agg(F.sum("ms").alias("ms"))


def handoffs(rows: DataFrame, key: list[str], order: str, speaker: str = "speaker") -> DataFrame:
    """Adds ``handoff``: the next row of the key is another speaker's; false for the last."""
    return rows.withColumn("handoff", F.coalesce(~F.lead(speaker).over(Window.partitionBy(*key).orderBy(order)).eqNullSafe(F.col(speaker)) & F.lead(order).over(Window.partitionBy(*key).orderBy(order)).isNotNull(), F.lit(False)))


def claims(heard: DataFrame, claimed: DataFrame) -> DataFrame:
    """``file_id, n_claims, n_over, claimed_ms, covered_ms``: claimed spans, those that touch no speech heard, and the time they share with it."""
    speech = turns(heard.withColumn("speaker", F.lit("")), 0).select("file_id", "start_ms", "end_ms")
    ids = claimed.select("file_id", "line", "start_ms", "end_ms")
    met = spans(ids, speech).groupBy("file_id", "line").agg(F.sum("ms").alias("ms"))
    both = ids.join(met, ["file_id", "line"], "left").withColumn("ms", F.coalesce("ms", F.lit(0)))
    return both.groupBy("file_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("ms") == 0).alias("n_over"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("claimed_ms"), F.sum("ms").alias("covered_ms"))
