"""Live scans: every micro-batch is scanned by the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import CLASSES
from quillward.operators import places, spans
from quillward.plans.scan import summary
from quillward.sources.corpus import size_of


def scan_stream(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stateless summary rows of a streaming docs(doc_id, source, lang, file_type, text)."""
    return summary(spark, docs)


def status_windows(spark: SparkSession, docs: DataFrame, time_col: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Documents by status in event-time windows; rows later than the watermark are dropped by Spark.

    The time goes through the scan as a plain column and is watermarked after it, so windows can close.
    """
    kind = docs.schema[time_col].dataType.simpleString()
    carried = docs.withColumn("source", F.col(time_col).cast("string"))
    marks = summary(spark, carried).select(F.col("source").cast(kind).alias(time_col), "status").withWatermark(time_col, late)
    return marks.groupBy(F.window(time_col, width), "status").agg(F.count("*").alias("n_docs"))


def chunks(docs: DataFrame, size: int = spans.CHUNK, overlap: int = 2048) -> DataFrame:
    """(doc_id, chunk, start, piece): texts above the streaming limit in overlapping pieces, others as one.

    Starts are code points; every character but the overlap stands in one piece."""
    n = F.length("text")
    count = F.when(n > spans.STREAM_FROM, F.ceil(n / size)).otherwise(F.lit(1)).cast("int")
    own = docs.where("text is not null").select("doc_id", "text", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * size)).alias("chunk", "start"), count.alias("n"))
    piece = F.when(F.col("n") == 1, F.col("text")).otherwise(F.substr(F.col("text"), F.col("start") + 1, F.lit(size + overlap)))
    return own.select("doc_id", "chunk", "start", piece.alias("piece"))


#: Bytes of the input for each task that reads pieces.
DEALT = 16 << 20


def tasks_of(docs: DataFrame) -> int:
    """Tasks among which pieces are dealt: by the size of the input, or the session's number where Spark does not know it."""
    spark, size = docs.sparkSession, size_of(docs)
    known = size // DEALT if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism * 2, known)


def pieces(docs: DataFrame, size: int = spans.CHUNK, overlap: int = 2048) -> DataFrame:
    """(doc_id, chunk, start, own, text) of docs(doc_id, text): every text in pieces of size characters and what the next piece
    begins with; start and own are the place and the length in UTF-16 units of what only this piece has. The pieces
    of one text go to many tasks."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(parts)).alias("parts"))
    rows = rows.withColumn("sizes", F.transform("parts", places.units))
    shared = F.transform("parts", lambda x, i: F.struct(F.concat(x, F.substring(F.coalesce(F.get("parts", i + 1), F.lit("")), 1, overlap)).alias("text"), F.get("sizes", i).alias("own"), F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b).alias("start")))
    return rows.select("row", "doc_id", F.posexplode(shared).alias("chunk", "p")).select("row", "doc_id", "chunk", "p.*").repartition(tasks_of(docs))


def chunked(docs: DataFrame, size: int = spans.CHUNK, overlap: int = 2048) -> DataFrame:
    """(doc_id, detector, name, severity, position, match_len) of phrase hits and direction controls, piece by piece.

    A hit belongs to the piece in whose own part it begins; one that an earlier hit of its rule reaches over is not one
    over the whole text. Three direction controls in the own part of one piece are danger. Hits longer than overlap
    may be cut."""
    control = "".join(CLASSES[f"bidi_{k}"] for k in ("embedding", "override", "isolate"))
    own = pieces(docs, size, overlap)
    role = F.transform(F.regexp_extract_all("text", F.lit(f"[{control}]"), F.lit(0)), lambda c: F.when(c.rlike(f"[{CLASSES['bidi_override']}]"), "override").otherwise("other"))
    streams = F.concat(places.rule_streams(F.col("text"), "direct "), places.stream(F.col("text"), f"[{control}]", "bidi", roles=role))
    rows = own.select(F.monotonically_increasing_id().alias("rid"), "row", "doc_id", "chunk", F.col("start").alias("base"), "own", F.explode(F.array(streams)).alias("e"))
    found = places.placed(rows.select("rid", "row", "doc_id", "chunk", "base", "own", F.inline("e"))).where(F.col("start") < F.col("own"))
    found = found.withColumn("position", F.col("base") + F.col("start"))
    before = Window.partitionBy("row", "what").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("position") + F.col("size")).over(before)
    found = found.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("position") >= F.col("_reach")))
    many = F.count("*").over(Window.partitionBy("row", "chunk", "what")) >= 3
    phrase = F.col("what") != "bidi"
    rule = F.get(F.split("what", " "), 1).try_cast("int")
    names, severities = (F.array(*[F.lit(r[i]) for r in rules.PHRASE_RULES]) for i in (0, 3))
    severity = F.when(phrase, F.get(severities, rule)).when(many | (F.col("role") == "override"), "danger").otherwise("warning")
    return found.select("doc_id", F.when(phrase, "phrase").otherwise("bidi-control").alias("detector"), F.get(names, rule).alias("name"), severity.alias("severity"), F.col("position").cast("int").alias("position"), F.col("size").cast("int").alias("match_len"))
