"""Readers and writers of the evaluation files: speaker segments, scored regions, meeting stores, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import fixed3, response_body, speaker_label, tokens
from colloquy.sources.shared import exists

SEGMENTS = "array<struct<speakerId:string,startTime:double,endTime:double>>"


def parse_rttm(lines: DataFrame) -> DataFrame:
    """``file_id, speaker, start_ms, end_ms`` from ``file_id, value``; blanks, comments and other record types go."""
    rows = lines.where(F.trim("value") != "").where(~F.col("value").startswith(";")).withColumn("f", tokens("value")).where(F.col("f")[0] == "SPEAKER")
    onset, length = F.col("f")[3].cast("double"), F.col("f")[4].cast("double")
    return rows.select("file_id", F.col("f")[7].alias("speaker"), F.round(onset * 1000).cast("long").alias("start_ms"), F.round((onset + length) * 1000).cast("long").alias("end_ms"))


def parse_uem(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.trim("value") != "").withColumn("f", tokens("value"))
    return rows.select("file_id", F.round(F.col("f")[2].cast("double") * 1000).cast("long").alias("start_ms"), F.round(F.col("f")[3].cast("double") * 1000).cast("long").alias("end_ms"))


def _plain_path(name: str):
    """A path of Spark's file metadata, which is encoded as in a URL, as it is."""
    return F.url_decode(F.replace(F.col(f"_metadata.{name}"), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``file_id, value`` of all files that end in ``suffix``; the id is the file's stem."""
    text = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").text(path)
    return text.select(F.regexp_extract(_plain_path("file_name"), r"^(.*)\.[^.]+$", 1).alias("file_id"), "value")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(read_lines(spark, path, ".rttm"))


def read_uem(spark: SparkSession, path: str) -> DataFrame:
    return parse_uem(read_lines(spark, path, ".uem"))


def format_rttm(segments: DataFrame) -> DataFrame:
    """``file_id, start_ms, value``: one line for each segment of at least a millisecond."""
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("file_id").cast("string"), F.lit("1"), fixed3("start_ms"), fixed3(length), F.lit("<NA>"), F.lit("<NA>"), speaker_label("speaker"), F.lit("<NA>"), F.lit("<NA>"))
    return segments.select("file_id", "start_ms", line.alias("value"))


def write_lines(lines: DataFrame, path: str, suffix: str, order: str) -> None:
    """``<file_id><suffix>`` files of ``file_id, value`` in a flat folder, replaced as a whole; lines in the order of ``order``.

    Tasks write the lines of their files, one folder for each; the driver then renames these, which moves no data.
    """
    spark = lines.sparkSession
    dealt = lines.withColumn("file_id", F.col("file_id").cast("string")).repartition("file_id").sortWithinPartitions("file_id", order)
    dealt.select("file_id", "value").write.mode("overwrite").partitionBy("file_id").text(path)
    jvm = spark.sparkContext._jvm
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(top):
        if folder.isDirectory():
            name = unescape(folder.getPath().getName().partition("=")[2])
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(top, f"{name}{suffix}"))
            fs.delete(folder.getPath(), True)


def write_rttm(segments: DataFrame, path: str) -> None:
    """``<file_id>.rttm`` for each file, as ``read_rttm`` reads them."""
    write_lines(format_rttm(segments), path, ".rttm", "start_ms")


def read_corpora(spark: SparkSession, root: str, kind: str = "rttm") -> DataFrame:
    """Segments (or regions, ``kind`` uem) of ``<root>/<corpus>/<kind>/<file_id>.<kind>``, with their corpus."""
    lines = spark.read.option("pathGlobFilter", f"*.{kind}").text(f"{root}/*/{kind}")
    at = _plain_path("file_path")
    lines = lines.select(F.regexp_extract(at, r"([^/]+)/[^/]+/[^/]+$", 1).alias("corpus"), F.regexp_extract(at, r"([^/]+)\.[^./]+$", 1).alias("stem"), "value")
    keyed = lines.select(F.struct("corpus", "stem").alias("file_id"), "value")
    return (parse_rttm(keyed) if kind == "rttm" else parse_uem(keyed)).select("file_id.corpus", F.col("file_id.stem").alias("file_id"), *[c for c in ("speaker", "start_ms", "end_ms") if kind == "rttm" or c != "speaker"])


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether anything has a path of this pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_baseline(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Segments of a flat ``<root>/rttm`` folder, restricted to ``files`` (corpus, file_id), which name their corpus."""
    return read_rttm(spark, f"{root}/rttm").join(files.select("corpus", "file_id").distinct(), "file_id").select("corpus", "file_id", "speaker", "start_ms", "end_ms")


def store_segments(meetings: DataFrame) -> DataFrame:
    """Segments of a meeting store ``id, segments_json``; missing keys take their defaults, null and empty texts give no
    rows, and a text that is no JSON is an error, so that no meeting vanishes unseen."""
    text = F.col("segments_json")
    sound = F.when(text.isNull() | (text == ""), None).when(F.try_parse_json(text).isNull(), F.raise_error(F.concat(F.lit("no JSON in meeting "), F.col("id").cast("string")))).otherwise(text)
    parsed = meetings.select(F.col("id").alias("file_id"), F.from_json(sound, f"struct<segments:{SEGMENTS}>").getField("segments").alias("s"))
    return segment_rows(parsed.select("file_id", F.explode("s").alias("s")))


def segment_rows(rows: DataFrame) -> DataFrame:
    """``file_id, speaker, start_ms, end_ms`` of ``file_id, s``, s a segment struct."""
    start = F.coalesce("s.startTime", F.lit(0.0))
    end = F.coalesce(F.col("s.endTime"), start)
    return rows.select("file_id", speaker_label(F.coalesce("s.speakerId", F.lit("Unknown"))).alias("speaker"), F.round(start * 1000).cast("long").alias("start_ms"), F.round(F.greatest(end, start + 0.001) * 1000).cast("long").alias("end_ms"))


def response_segments(responses: DataFrame) -> DataFrame:
    """Segments of ``file_id, raw``, raw completions; those that can't be decoded or hold none give no rows."""
    body = F.from_json(response_body("raw"), f"struct<segments:{SEGMENTS}>").getField("segments")
    return segment_rows(responses.select("file_id", F.explode(body).alias("s")))


def read_store(spark: SparkSession, url: str, table: str = "meetings") -> DataFrame:
    """The store over JDBC; the driver's jar must be on the class path. A lookup by id is pushed down."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).load()


def store_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a store kept as Parquet; a store that is not there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.parquet(path).select(F.col("id").cast("string").alias("id")).distinct()


def pick_new(after: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """The keys that are in ``after`` only; ``picked`` marks the smallest, the one taken where several are new."""
    new = after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti")
    return new.join(F.broadcast(new.agg(F.min(key).alias("__least"))), F.lit(True)).select(key, (F.col(key) == F.col("__least")).alias("picked"))  # one row


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON documents: one to a file (or an array of them), however laid out, or with ``multi_line=False`` one to a line."""
    return spark.read.option("multiLine", str(multi_line).lower()).json(path)


def result_document(files: DataFrame, corpora: DataFrame) -> DataFrame:
    """One nested row for each corpus, its files sorted by id, ready for a JSON sink."""
    one = F.struct("file_id", *[c for c in files.columns if c not in ("corpus", "file_id")])
    nested = files.groupBy("corpus").agg(F.array_sort(F.collect_list(one)).alias("files"))
    return corpora.join(nested, "corpus", "left")


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON, replaced as a whole; one line for each document."""
    documents.write.mode("overwrite").json(path)


def only_new(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Idempotent write: what the output does not hold yet."""
    return rows.join(done.select(key), key, "left_anti")


def progress(files: DataFrame, by: str, order: str) -> DataFrame:
    """``i`` of ``n`` within each group."""
    return files.withColumns({"i": F.row_number().over(Window.partitionBy(by).orderBy(order)), "n": F.count("*").over(Window.partitionBy(by))})
