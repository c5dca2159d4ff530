"""Scores folders of hypothesis files against references: ``python -m colloquy.score --data-dir D --output-dir O --results-dir R``.

References are ``D/<corpus>/rttm/*.rttm`` with optional regions in ``D/<corpus>/uem/*.uem``; hypotheses are
``O/<corpus>/rttm/*.rttm``, and another system's, if given, flat in ``B/rttm/*.rttm``. All corpora are scored in one job.
``R/report`` gets the Markdown report and ``R/results`` the nested results as JSON; both replace what was there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import diarization as D
from colloquy.sources import report, rttm
from colloquy.sources.shared import exists

_KEY = ["corpus", "file_id"]


def _sides(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Segments of both sides under one id, which is the corpus and the file."""
    both = ref.withColumn("side", F.lit("ref")).unionByName(hyp.withColumn("side", F.lit("hyp")))
    return both.withColumn("file_id", F.struct(*_KEY))


def _scored(segments: DataFrame, uem: DataFrame | None, half_collar_ms: int) -> DataFrame:
    files = D.with_ref_ms(D.der_by_file(segments, half_collar_ms, uem), segments)
    return files.select("file_id.corpus", F.col("file_id.file_id").alias("name"), *[c for c in files.columns if c != "file_id"]).drop("file_id").withColumnRenamed("name", "file_id")


def score(spark: SparkSession, data_dir: str, output_dir: str, results_dir: str, corpus: str = "all", collar: float = 0.25, baseline_dir: str | None = None) -> DataFrame:
    """Writes report and results; returns the scored files. ``collar`` is the whole width around a reference boundary, in seconds."""
    ref, hyp = rttm.read_corpora(spark, data_dir), rttm.read_corpora(spark, output_dir)
    uem = rttm.read_corpora(spark, data_dir, "uem") if rttm.matches(spark, f"{data_dir}/*/uem") else None
    if corpus != "all":
        ref, hyp = ref.where(F.col("corpus") == corpus), hyp.where(F.col("corpus") == corpus)
    if uem is not None:
        uem = uem.withColumn("file_id", F.struct(*_KEY))
    half = round(collar * 500)
    files = _scored(_sides(ref, hyp), uem, half)
    totals = D.weighted(files, ["corpus"])
    base, base_totals = None, None
    if baseline_dir and exists(spark, f"{baseline_dir}/rttm"):
        base = _scored(_sides(ref, rttm.read_baseline(spark, baseline_dir, ref)), uem, half)
        base_totals = D.weighted(base, ["corpus"])
    report.write_report(report.report_lines(files, totals, base, base_totals), f"{results_dir}/report")
    own = files.select("corpus", "file_id", "der", "missed", "fa", "confusion", "n_ref_speakers", "n_hyp_speakers", (F.col("ref_ms") / 1000.0).alias("ref_duration"))
    nested = totals.select("corpus", *[F.col(c).alias(f"aggregate_{c}") for c in ("der", "missed", "fa", "confusion")])
    rttm.write_documents(rttm.result_document(own, nested), f"{results_dir}/results")
    return files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.partition(":")[0])
    for name in ("data", "output", "results"):
        parser.add_argument(f"--{name}-dir", required=True)
    parser.add_argument("--baseline-dir")
    parser.add_argument("--corpus", default="all")
    parser.add_argument("--collar", type=float, default=0.25)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("score").getOrCreate()
    score(spark, a.data_dir, a.output_dir, a.results_dir, a.corpus, a.collar, a.baseline_dir)


if __name__ == "__main__":
    main()
