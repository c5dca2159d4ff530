"""The score report: Markdown lines made where the aggregates are, and its sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.scalars import percent_text

_HEADS = [
    (1, "", "# Results"), (2, "", ""), (4, "", "## Summary"), (5, "", ""), (6, "", "| Corpus | Files | DER | Confusion | False alarm | Missed |"), (7, "", "|---|--:|--:|--:|--:|--:|"),
]
_COMPARE = [(20, "", ""), (21, "", "## Baseline comparison"), (22, "", ""), (23, "", "| Corpus | Baseline DER | DER |"), (24, "", "|---|--:|--:|")]
_FILES = [(30, "", ""), (31, "", "## Files")]


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report_lines(files: DataFrame, totals: DataFrame, base_files: DataFrame | None = None, base_totals: DataFrame | None = None) -> DataFrame:
    """``part, corpus, file_id, line``, to be read in the order of the first three.

    ``files``: corpus, file_id, der, missed, fa, confusion, n_ref_speakers, n_hyp_speakers; ``totals``: the weighted rates
    and n_files by corpus. With a baseline (der by corpus and file) its table comes in, and a corpus that the baseline
    scored has the narrower table of files; a dash stands where a baseline is missing.
    """
    spark = files.sparkSession
    heads = _HEADS + _FILES + (_COMPARE if base_files is not None else [])
    p, text = percent_text, lambda c: F.col(c).cast("string")
    out = [spark.createDataFrame([(k, c, "", line) for k, c, line in heads], "part int, corpus string, file_id string, line string")]

    def add(rows: DataFrame, part, line: Column, file_id="") -> None:
        part = F.lit(part) if isinstance(part, int) else part
        out.append(rows.select(part.cast("int").alias("part"), "corpus", (F.col(file_id).cast("string") if file_id else F.lit("")).alias("file_id"), line.alias("line")))

    add(totals, 10, _line(F.col("corpus"), text("n_files"), p("der"), p("confusion"), p("fa"), p("missed")))
    if base_files is None:
        files, known = files.withColumn("base", F.lit(None).cast("double")), files.select("corpus").distinct().withColumn("has", F.lit(False))
    else:
        files = files.join(base_files.select("corpus", "file_id", F.col("der").alias("base")), ["corpus", "file_id"], "left")
        known = totals.select("corpus").join(base_totals.select("corpus", F.lit(True).alias("has"), F.col("der").alias("base")), "corpus", "left").withColumn("has", F.coalesce("has", F.lit(False)))
        add(totals.join(known.select("corpus", "base"), "corpus"), 25, _line(F.col("corpus"), p("base"), p("der")))
    known = known.select("corpus", "has")
    # 40: the corpus's heading, with lines of its own
    head = F.when(F.col("has"), F.lit("| File | Baseline DER | DER | Ref speakers | Hyp speakers |\n|---|--:|--:|--:|--:|")).otherwise(F.lit("| File | DER | Missed | False alarm | Confusion | Ref speakers | Hyp speakers |\n|---|--:|--:|--:|--:|--:|--:|"))
    add(known, 40, F.concat(F.lit("\n### "), F.col("corpus"), F.lit("\n\n"), head))
    speakers = [text("n_ref_speakers"), text("n_hyp_speakers")]
    row = F.when(F.col("has"), _line(text("file_id"), p("base"), p("der"), *speakers)).otherwise(_line(text("file_id"), p("der"), p("missed"), p("fa"), p("confusion"), *speakers))
    add(files.join(known, "corpus"), 40, row, "file_id")
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def write_report(lines: DataFrame, path: str) -> None:
    """One text file, replaced as a whole. A report is one line for each file scored."""
    lines.orderBy("part", "corpus", "file_id").select("line").coalesce(1).write.mode("overwrite").text(path)
