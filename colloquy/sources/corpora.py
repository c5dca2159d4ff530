"""The static catalog of evaluation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids of the public evaluation splits, and where their files are.
FILES = {
    "ami": ["IS1009a", "IS1009b", "IS1009c", "IS1009d", "ES2004a", "ES2004b", "ES2004c", "ES2004d", "TS3003a", "TS3003b", "TS3003c", "TS3003d", "EN2002a", "EN2002b", "EN2002c", "EN2002d"],
    "earnings21": ["4320211", "4341191", "4346818", "4359971", "4365024", "4366522", "4366893", "4367535", "4383161", "4384964", "4387332"],
}
AMI_AUDIO = "https://groups.inf.ed.ac.uk/ami/AMICorpusMirror/amicorpus/{meeting_id}/audio/{meeting_id}.Mix-Headset.wav"


def catalog(spark: SparkSession, corpus: str = "all") -> DataFrame:
    """``corpus, meeting_id`` of one corpus, or the union of all."""
    if corpus != "all" and corpus not in FILES:
        raise ValueError(f"no corpus {corpus!r}")
    return spark.createDataFrame([(c, i) for c, ids in FILES.items() if corpus in ("all", c) for i in ids], "corpus string, meeting_id string")


def expand(ids: DataFrame, template: str, column: str = "meeting_id") -> DataFrame:
    """Adds ``url``: the template with every ``{column}`` replaced by the row's id."""
    parts = template.split("{" + column + "}")
    pieces = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [F.col(column).cast("string"), F.lit(p)]
    return ids.withColumn("url", F.concat(*pieces))
