"""From documents to findings, scores, summaries and top lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.operators import detectors as D
from quillward.operators import exfil, places, spans

#: Text length from which the place of a finding does not count: findings that were merged have it.
MERGED_LENGTH = 2001


def scored(found: DataFrame, length: Column | int | None = None) -> DataFrame:
    """Findings with display category, priority, reason and label. length: of the text in UTF-16 units, by
    default the one of each finding; MERGED_LENGTH for findings of several sources."""
    size = F.col("text_len") if length is None else F.lit(length) if isinstance(length, int) else length
    display = F.when(F.col("detector") == "bidi-control", "bidiOverride").otherwise(F.col("bucket"))
    out = found.withColumn("display", display).withColumn("priority", D.priority(F.col("severity"), F.col("display"), F.col("position"), size))
    return out.withColumn("reason", D.reason(F.col("bucket"), F.col("severity"), F.col("position"), size, F.col("detector"))).withColumn("label", D.label(F.coalesce("name", "technique", "kind", "display")))


def scan(spark: SparkSession, docs: DataFrame, categories: list[str] | None = None, verbosity: str = "normal") -> DataFrame:
    """Scored findings of docs(doc_id, text, file_type). verbosity: normal, or detailed with wider contexts."""
    return scored(spans.findings(spark, docs, categories, verbosity == "detailed"))


def sniffed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the file type that a text given directly has: html with a tag, else text."""
    return docs.withColumn("file_type", F.when(F.col("text").rlike(r"(?i)<[a-z][\x00-\x{10FFFF}]*>"), "html").otherwise("text"))


def merged(*parts: DataFrame) -> DataFrame:
    """Union of findings of several sources, scored anew without the boost of the head."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return scored(out, MERGED_LENGTH)


def top_list(rows: DataFrame, display: str, by: list, per_display: int = 2, total: int = 5) -> DataFrame:
    """The first `total` rows of each document in the order of by, at most per_display of a display, with their rank.

    Every task keeps per_display rows of a group before the exchange (a limit that Spark puts before ranks that are
    bounded), so what is shuffled and ranked grows with documents and not with their findings."""
    own = rows.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", display).orderBy(*by))).where(F.col("_r") <= per_display)
    return own.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*by))).where(F.col("rank") <= total).drop("_r")


def without_noise(rows: DataFrame) -> DataFrame:
    """Rows without the names that count as noise in a document with few of them; only these are counted."""
    noise = F.coalesce("name", F.lit("")).isin(rules.NOISE)
    few = rows.where(noise).groupBy("doc_id", "name").agg(F.count("*").alias("_n")).where(F.col("_n") < rules.TRANSCRIPT_LEAST).select(F.col("doc_id").alias("_doc"), F.col("name").alias("_name"))
    return rows.join(few, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("name") == F.col("_name")), "left_anti")


def top_findings(found: DataFrame, per_display: int = 2, total: int = 5) -> DataFrame:
    """Danger and warning findings by priority, at most two of a display category and five of a document."""
    kept = without_noise(found.where(F.col("severity").isin("danger", "warning")))
    return top_list(kept, "display", [F.desc("priority"), "display", "idx"], per_display, total)


def top_phrases(docs: DataFrame, per_name: int = 2, total: int = 5) -> DataFrame:
    """(doc_id, name, severity, position, priority, rank) of the foremost phrase hits of docs(doc_id, text), after the rules
    of their context, without Python."""
    hits = places.phrase_places(docs)
    milder = F.create_map(*[F.lit(x) for kv in spans.LADDER.items() for x in kv])
    severity = F.when((F.col("in_code") | F.col("in_quote")) & ~F.col("name").isin(rules.NOISE), F.coalesce(milder[F.col("severity")], F.col("severity"))).otherwise(F.col("severity"))
    rows = hits.withColumn("severity", severity).where(F.col("severity").isin("danger", "warning"))
    rows = rows.withColumn("priority", D.priority(F.col("severity"), F.lit("suspiciousPatterns"), F.col("position"), F.col("text_len")))
    return top_list(without_noise(rows), "name", [F.desc("priority"), "name", "position", "match_len", "shadow"], per_name, total).select("doc_id", "name", "severity", "position", "priority", "rank")


COUNTS = ["invisible_unicode", "control_chars", "hidden_html", "suspicious_patterns", "homoglyphs"]
BIDI = ["total", "override", "embedding", "isolate", "danger", "warning"]


def summary_of(text: str | None, file_type: str) -> list[int]:
    """Counts of the five buckets, danger, warning, then of direction controls."""
    out, bidi = [0] * 7, dict.fromkeys(BIDI, 0)
    if not text:
        return out + [0] * 6
    for k, (bucket, found) in enumerate(spans.findings_of(text, file_type).items()):
        out[k] = len(found)
        out[5] += sum(x["severity"] == "danger" for x in found) if bucket != "controlChars" else 0
        out[6] += sum(x["severity"] == "warning" for x in found)
        for x in found:
            if x["detector"] == "bidi-control":
                bidi["total"] += 1
                bidi[x["kind"]] += 1
                if x["severity"] in bidi:
                    bidi[x["severity"]] += 1
    return out + list(bidi.values())


def summary(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for every row of docs(doc_id, source, lang, file_type, text): counts, status, direction controls, and
    whether the text is long enough to be read in chunks.

    Every count comes from the findings with the rules of their context applied, in the scan's own stage: no
    shuffle, and texts that a native test clears do not travel to Python. Null texts are safe.
    """
    names = [*COUNTS, "danger_count", "warning_count", *(f"bidi_{b}" for b in BIDI)]

    hosts = exfil.extra_hosts()

    def rows(batches):
        exfil.use(hosts)
        for batch in batches:
            found = [summary_of(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("file_type").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))]], [*batch.schema.names[:-1], *names])

    size = (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long")
    chunks = F.when(size > spans.STREAM_FROM, F.ceil(size / spans.CHUNK)).otherwise(F.lit(0)).cast("int")
    own = docs.select("doc_id", "source", "lang", F.coalesce("file_type", F.lit("text")).alias("file_type"), F.when(F.octet_length("text") > spans.STREAM_FROM, chunks).otherwise(F.lit(0)).alias("chunk_count"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("text", F.when(spans.may_have_findings(F.col("text"), F.col("file_type")), F.col("text")))
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema[:-1]) + ", " + ", ".join(f"{n} long" for n in names)
    out = own.mapInArrow(rows, form)
    return out.withColumn("status", D.status(F.col("danger_count"), F.col("warning_count"))).withColumn("streamed", F.col("chunk_count") > 0)


def compact(found: DataFrame) -> DataFrame:
    """The compact form of findings: (doc_id, total, max_severity, categories, one_line)."""
    rank = {"safe": 0, "info": 1, "warning": 2, "danger": 3}
    value = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("severity")], F.lit(0))
    own = found.groupBy("doc_id", "bucket").agg(F.count("*").alias("n"), F.max(value).alias("rank"))
    out = own.groupBy("doc_id").agg(F.sum("n").alias("total"), F.max("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    worst = F.element_at(F.array(*map(F.lit, rank)), F.col("rank") + 1)
    return out.select("doc_id", "total", worst.alias("max_severity"), F.map_from_entries("counts").alias("categories"), F.concat(F.lit("⚠ "), F.col("total"), F.lit(" findings, max="), worst).alias("one_line"))


def worst_status(status: Column) -> Column:
    """Aggregate: danger before warning before safe."""
    rank = F.max(F.when(status == "danger", 2).when(status == "warning", 1).otherwise(0))
    return F.element_at(F.array(F.lit("safe"), F.lit("warning"), F.lit("danger")), rank + 1)
