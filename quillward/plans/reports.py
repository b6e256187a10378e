"""Reports and exports of findings, and gates over timings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillward.functions import rules

TITLES = dict(zip(rules.BUCKETS, ["Invisible Unicode", "Control Characters", "Hidden HTML", "Suspicious Patterns", "Homoglyphs"], strict=True))
HINTS = dict(zip(rules.BUCKETS, ["invisible characters may carry instructions", "control characters may hide text", "markup may hide text or carry data away", "wording may steer a model", "letters may stand for others"], strict=True))


def line(found: DataFrame) -> Column:
    """One finding as a line of a report."""
    at = F.concat(F.lit(" at pos "), F.col("position"))
    return F.concat(F.lit("  - "), F.when(F.col("char").isNotNull() & (F.col("bucket") != "homoglyphs"), F.concat(F.coalesce("name", "kind", F.lit("")), F.lit(" "), "char", at))
        .when(F.col("matched").isNotNull(), F.concat(F.coalesce("name", "technique"), F.lit(": "), "matched")).when(F.col("technique").isNotNull(), F.concat("technique", F.lit(" in <"), F.coalesce("element", F.lit("")), F.lit(">")))
        .when(F.col("replacement").isNotNull(), F.concat("original", F.lit(" -> "), "replacement", at)).when(F.col("normalized").isNotNull(), F.concat("kind", F.lit(" "), "char", F.lit(' ~ "'), "normalized", F.lit('"'), at))
        .otherwise(F.concat(F.coalesce("kind", "detector"), F.lit(" depth="), F.coalesce(F.col("stack_depth").cast("string"), F.lit("")), at)))


def text_report(found: DataFrame, summaries: DataFrame, first: int = 0) -> DataFrame:
    """(doc_id, report) for every row of summaries(doc_id, status, danger_count, warning_count); first: findings shown of a bucket, all if 0."""
    own = found.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "bucket").orderBy("idx"))).withColumn("line", line(found))
    shown = own.where(F.col("n") <= first) if first else own
    lists = shown.groupBy("doc_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    counts = found.groupBy("doc_id", "bucket").agg(F.count("*").alias("count"))
    both = lists.join(counts, ["doc_id", "bucket"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("count", "lines")))).alias("by"))
    part = lambda b: F.concat(F.lit(f"[{TITLES[b]}] "), F.coalesce(F.col("by")[b]["count"], F.lit(0)), F.lit(" found"), F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform(F.col("by")[b]["lines"], lambda x: x["line"]), "\n")), F.lit("")))
    head = F.concat(F.lit("=== Scan Report ===\nStatus: "), F.upper("status"), F.lit("\nTotal findings: "), F.col("danger_count") + F.col("warning_count"), F.lit(" (danger: "), "danger_count", F.lit(", warning: "), "warning_count", F.lit(")"))
    return summaries.join(both, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", head, *[part(b) for b in rules.BUCKETS]).alias("report"))


def json_export(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc_id, json) for every summary row: the summary and its findings."""
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "idx", "severity", "label", "position", "match_len", "priority"))).alias("findings"))
    own = summaries.join(rows, "doc_id", "left")
    return own.select("doc_id", F.to_json(F.struct(*[c for c in summaries.columns], F.coalesce("findings", F.expr("array()").cast(own.schema["findings"].dataType)).alias("findings"))).alias("json"))


def cell(text: Column) -> Column:
    """A value inside a Markdown table."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")


def markdown_export(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc_id, markdown): a table of findings of each document with a hint for every bucket that has some."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "bucket", "severity", cell(F.col("label")), F.coalesce(F.col("position").cast("string"), F.lit("-"))), F.lit(" |"))
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "idx", row.alias("row")))).alias("rows"), F.array_sort(F.collect_set("bucket")).alias("some"))
    body = F.concat(F.lit("| Category | Severity | Finding | Position |\n| --- | --- | --- | --- |\n"), F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("\n\n"), F.array_join(F.transform("some", lambda b: F.concat(F.lit("- "), b, F.lit(": "), hint[b])), "\n"))
    return summaries.join(rows, "doc_id", "left").select("doc_id", F.concat(F.lit("## "), F.col("doc_id"), F.lit(" ("), "status", F.lit(")\n\n"), F.coalesce(body, F.lit("No findings."))).alias("markdown"))


#: Names of buckets and states in Japanese (fixed values); English ones are TITLES and the states themselves.
JAPANESE = dict(zip([*rules.BUCKETS, "danger", "warning", "safe"], ["不可視Unicode", "制御文字", "隠しHTML", "不審なパターン", "ホモグリフ", "危険", "警告", "安全"], strict=True))


def titled(name: Column, language: str = "en") -> Column:
    """Name of a bucket or state in a language, as it stands where there is none."""
    names = JAPANESE if language == "ja" else TITLES
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[name], name)


def pdf_export(summaries: DataFrame, most: int = 50) -> bytes:
    """A PDF page list of the first documents by id: one line each with status and counts (a report of ``most`` lines
    by design); characters beyond ASCII become question marks."""
    rows = summaries.select("doc_id", "status", "danger_count", "warning_count").orderBy("doc_id").limit(most).collect()
    lines = ["Scan report", *[f"{r.doc_id}  {r.status}  danger {r.danger_count}  warning {r.warning_count}" for r in rows]]
    clean = lambda x: re.sub(r"([\\()])", r"\\\1", x.encode("ascii", "replace").decode())
    pages = [lines[i : i + 45] for i in range(0, len(lines), 45)]
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>", "<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    for k, page in enumerate(pages):
        body = "BT /F1 11 Tf 50 800 Td 16 TL " + " ".join(f"({clean(x)}) Tj T*" for x in page) + " ET"
        objects += [f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents {5 + 2 * k} 0 R>>", f"<</Length {len(body)}>>stream\n{body}\nendstream"]
    out, places = "%PDF-1.4\n", []
    for k, x in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n{x}\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return (out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF").encode("ascii")


def file_severity(found: DataFrame) -> DataFrame:
    """(doc_id, danger, warning): the form of a bulk list, where every control character and look-alike is a warning."""
    always = F.col("bucket").isin("controlChars", "homoglyphs")
    return found.groupBy("doc_id").agg(F.count_if(~always & (F.col("severity") == "danger")).alias("danger"), F.count_if(always | (F.col("severity") == "warning")).alias("warning"))


def timings(runs: DataFrame) -> DataFrame:
    """(label, detector, median_ms, max_ms) of runs(label, detector, ms)."""
    return runs.groupBy("label", "detector").agg(F.median("ms").alias("median_ms"), F.max("ms").alias("max_ms"))


def gate(now: DataFrame, before: DataFrame, caps: DataFrame, most: float = 0.5, least_ms: float = 5.0) -> DataFrame:
    """Timings with ``over_cap`` and ``regressed``: above the cap of a detector, or more than ``most`` over the run
    before where that took ``least_ms`` at least."""
    old = before.select("label", "detector", F.col("median_ms").alias("before_ms"))
    own = now.join(old, ["label", "detector"], "left").join(F.broadcast(caps), "detector", "left")  # caps: one row a detector
    return own.withColumn("over_cap", F.coalesce(F.col("median_ms") > F.col("cap_ms"), F.lit(False))).withColumn("regressed", F.coalesce((F.col("before_ms") >= least_ms) & (F.col("median_ms") > F.col("before_ms") * (1 + most)), F.lit(False)))


def parity(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two finding sets that differ in number: keys with both counts."""
    a, b = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((one, "left_count"), (two, "right_count")))
    own = a.join(b, keys, "full").fillna(0, ["left_count", "right_count"])
    return own.where("left_count <> right_count")
