"""Files of every supported kind: bytes in, text and structural findings out, and scans of them.

``read`` sends a file to the reader of its extension; archives, notebooks, mails, PDF
attachments and images inside office files come back to it for what they hold. ``scan_files``
gives the findings of a file's text and its structural findings as one table, ``scan_mails``
keeps the sections of mails apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.operators import exfil, sanitize, spans
from quillward.plans.scan import MERGED_LENGTH, scored, worst_status
from quillward.sources import containers, images, mail, office, rich
from quillward.sources.corpus import FILE_TYPES

#: Extensions of files that can be read; how the media types of images go with them; limits of a bulk scan.
TEXT_KINDS = ("txt", "md", "mdc", "cursorrules", "json", "html", "htm", "xml", "svg", "yml", "yaml", "toml")
MEDIA_TYPES = {"image/svg+xml": "svg", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/tiff": "tiff", "text/html": "html", "text/csv": "csv", "application/pdf": "pdf"}
BULK_FILES, BULK_FILE, BULK_TOTAL = 30, 20 << 20, 100 << 20
DIVIDER = "\n\n---\n\n"


def of_container(reader):
    def read_(data: bytes, name: str):
        text, found = reader(data)
        return text, "archive" if reader is containers.archive else "ipynb", [{"technique": t, "severity": s, "bucket": b, "element": "archive" if reader is containers.archive else "notebook", "content": "", "location": at or None} for t, s, b, at in found]

    return read_


def of_mail(data: bytes, name: str = "", depth: int = 0):
    """A mail as one text: headers, body, html and names of attachments, joined by a divider; findings of attachments too."""
    parts, found, scans = mail.sections(data, depth, lambda n, e, b, d: dispatch(n, e, b, d))
    texts = [parts["headers"], parts["body"], parts["html"]]
    if parts["attachment_names"]:
        texts.append("[ATTACHMENTS]\n" + parts["attachment_names"])
    return DIVIDER.join(t for t in texts if t), "html" if parts["html"] else "text", found + [f for s in scans for f in s[3]]


def dispatch(name: str, ending: str, data: bytes, depth: int = 0):
    """(text, file type, findings) of a file, or None for an extension that is not read."""
    if ending in TEXT_KINDS:
        text = data.decode("utf-8", "replace")
        return text, FILE_TYPES[ending], []
    if ending in images.WALKERS:
        return images.read(data, ending)
    if ending == "eml":
        return of_mail(data, name, depth)
    if ending == "pdf":
        return rich.pdf(data, name, lambda n, b: dispatch(n, n.rpartition(".")[2].lower(), b, depth + 1) if depth < 2 else None)
    reader = READERS.get(ending)
    return reader(data, name) if reader else None


READERS = {"csv": rich.csv, "rtf": rich.rtf, "docx": office.docx, "pptx": office.pptx, "xlsx": office.xlsx, "odt": office.odt, "ods": office.ods, "odp": office.odp, "zip": of_container(containers.archive), "ipynb": of_container(containers.notebook)}
SUPPORTED = sorted({*TEXT_KINDS, *READERS, *images.WALKERS, "eml", "pdf"})


def read(name: str, data: bytes | None) -> tuple[str, str, list[dict], str | None]:
    """(text, file type, findings, error) of a file by its extension."""
    ending = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    try:
        out = dispatch(name, ending, data or b"")
    except Exception as e:
        return "", FILE_TYPES.get(ending, "unsupported"), [], f"{type(e).__name__}: {e}"[:200]
    return (*out, None) if out else ("", "unsupported", [], f"Unsupported file extension: .{ending}")


FORM = "path string, file_type string, text string, error string, structural array<struct<technique:string,severity:string,bucket:string,element:string,content:string,location:string>>"


def parsed(files: DataFrame) -> DataFrame:
    """(path, file_type, text, error, structural) of files(path, content); damaged ones have an error, never a failure."""
    struct = pa.struct([(k, pa.string()) for k in ("technique", "severity", "bucket", "element", "content", "location")])

    def rows(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text, kind, found, error = read(path, data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([text.encode("utf-8", "replace").decode()], pa.string()), pa.array([error], pa.string()), pa.array([found], pa.list_(struct))], ["path", "file_type", "text", "error", "structural"])

    return files.select("path", "content").mapInArrow(rows, FORM)


def scan_files(spark: SparkSession, files: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Findings of files(path, content): those of the text, then the structural ones, each bucket numbered on, with
    priorities as for merged findings. Matches inside decoded image fields are not shown."""
    names = ["path", *spans.FIELDS]
    hosts = exfil.extra_hosts()

    def rows(batches):
        exfil.use(hosts)
        for batch in batches:
            out = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text, kind, found, error = read(path, data)
                own = [list(r[1:]) for r in spans.rows_of(0, text, kind, categories)]
                ending = path.rpartition(".")[2].lower()
                if ending in images.WALKERS and text:
                    redact(own, images.ranges(text, data or b"", ending))
                sizes = {b: sum(r[0] == b for r in own) for b in spans.CATEGORIES}
                for f in found:
                    if categories is not None and f["bucket"] not in categories:
                        continue
                    row = dict.fromkeys(spans.FIELDS) | {"bucket": f["bucket"], "idx": sizes[f["bucket"]], "detector": "structure", "severity": f["severity"], "technique": f["technique"], "element": f["element"], "content": f["content"], "context_location": f["location"], "in_code": False, "in_quote": False, "in_url_query": False, "text_len": len(text)}
                    sizes[f["bucket"]] += 1
                    own.append(list(row.values()))
                out += [(path, *r) for r in own]
            if out:
                kinds = [pa.string(), *(spans.ARROW[k] for k in spans.FIELDS.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    form = "path string, " + spans.SCHEMA.removeprefix("doc_id long, ")
    return scored(files.select("path", "content").mapInArrow(rows, form), MERGED_LENGTH)


def redact(rows: list[list], ranges: list[tuple[int, int, str, str]]) -> None:
    """Rows of phrases inside a decoded range show where they come from instead of what they match."""
    at = {k: i for i, k in enumerate(spans.FIELDS)}
    for r in rows:
        if r[at["bucket"]] != "suspiciousPatterns" or r[at["position_cp"]] is None:
            continue
        a = r[at["position_cp"]]
        hit = next((x for x in ranges if x[0] <= a and a + r[at["match_len"]] <= x[1]), None)
        if hit:
            r[at["matched"]] = r[at["context"]] = f"[REDACTED: decoded from {hit[2]} ({hit[3]})]"


def scan_mails(spark: SparkSession, mails: DataFrame) -> DataFrame:
    """Findings of mails(path, content) by section: headers, extended headers, body, html, attachment names, each
    attachment, and structural ones."""
    names = ["path", "section", *spans.FIELDS]
    labels = {"headers": "Headers", "extended_headers": "Extended Headers", "body": "Body", "html": "HTML Body", "attachment_names": "Attachment names"}
    hosts = exfil.extra_hosts()

    def rows(batches):
        exfil.use(hosts)
        for batch in batches:
            out = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                parts, found, scans = mail.sections(data or b"", 0, lambda n, e, b, d: dispatch(n, e, b, d))
                texts = [(k, labels[k], parts[k], "html" if k == "html" else "text") for k in labels]
                texts += [(label, label, t, kind) for label, t, kind, _ in scans]
                for key, label, text, kind in texts:
                    out += [(path, key, *r[1:]) for r in spans.rows_of(0, text, kind, None, False, label)]
                for n, f in enumerate(found + [f for s in scans for f in s[3]]):
                    row = dict.fromkeys(spans.FIELDS) | {"bucket": f["bucket"], "idx": n, "detector": "structure", "severity": f["severity"], "technique": f["technique"], "element": f["element"], "content": f["content"], "context_location": f["location"], "in_code": False, "in_quote": False, "in_url_query": False}
                    out.append((path, "structural", *row.values()))
            if out:
                kinds = [pa.string(), pa.string(), *(spans.ARROW[k] for k in spans.FIELDS.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    form = "path string, section string, " + spans.SCHEMA.removeprefix("doc_id long, ")
    return scored(mails.select("path", "content").mapInArrow(rows, form), MERGED_LENGTH)


def mail_status(found: DataFrame) -> DataFrame:
    """(path, status, danger_count, warning_count, total): the worst of a mail's sections."""
    told = F.when(F.col("bucket") == "controlChars", F.col("severity") == "warning").otherwise(F.col("severity").isin("danger", "warning"))
    own = found.where(told).groupBy("path").agg(worst_status(F.col("severity")).alias("status"), F.count_if(F.col("severity") == "danger").alias("danger_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    return own.withColumn("total", F.col("danger_count") + F.col("warning_count"))


def sanitized_files(spark: SparkSession, files: DataFrame, mode: str = "strip") -> DataFrame:
    """(path, name, cleaned, a count of each bucket, error) of files(path, content): the text of each, cleaned.

    Text-like files keep their ending, others become .txt; archives are refused; Markdown is cleaned as plain text.
    Of files that repeat a path each has its row."""
    names = ["invisible_unicode", "control_chars", "hidden_html", "suspicious_patterns", "homoglyphs"]

    def rows(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = sanitize.sanitized_name(path)
                text, kind, _, error = read(path, data) if name else ("", "archive", [], "archives cannot be sanitized")
                out, counts, _ = sanitize.sanitize(text, kind if kind in ("html", "csv", "xlsx") else "text", mode) if not error else (None, dict.fromkeys(rules.BUCKETS, 0), [])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name], pa.string()), pa.array([out], pa.string()), *[pa.array([c], pa.int64()) for c in counts.values()], pa.array([error], pa.string())], ["path", "name", "cleaned", *names, "error"])

    return files.select("path", "content").mapInArrow(rows, "path string, name string, cleaned string, " + ", ".join(f"{n} long" for n in names) + ", error string")


def save_sanitized(cleaned: DataFrame, folder: str) -> None:
    """Writes cleaned files(name, cleaned) below a folder, one folder a file name, as text."""
    cleaned.where("error is null").select("name", F.col("cleaned").alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def kind_of_name(name: Column) -> Column:
    """text, html, markdown, binary or unsupported, by the extension of a file name."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("txt", "json", "csv"), "text").when(ext.isin("html", "htm", "xml", "svg"), "html").when(ext.isin("md", "mdc", "cursorrules"), "markdown").when(ext.isin(*SUPPORTED), "binary").otherwise("unsupported")


def bulk_check(files: DataFrame) -> DataFrame:
    """One row: empty, tooManyFiles, perFileTooLarge, totalTooLarge or ok, for files(size) of one selection."""
    own = files.agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total"))
    code = F.when(F.col("n") == 0, "empty").when(F.col("n") > BULK_FILES, "tooManyFiles").when(F.col("largest") > BULK_FILE, "perFileTooLarge").when(F.col("total") > BULK_TOTAL, "totalTooLarge").otherwise("ok")
    return own.select("n", code.alias("code"))


def archives(found: DataFrame) -> DataFrame:
    """Sums over the findings of archives(path, technique): what was too large, too deep, protected or over the count."""
    count = lambda *names: F.count_if(F.col("technique").isin(*names))
    return found.groupBy("path").agg(
        count("Archive bomb ratio", "per-entry cap", "total cap").alias("bomb"), count("recursion depth cap").alias("depth"), count("Encrypted archive", "Unsupported or corrupt ZIP").alias("protected"), count("entry count exceeds cap").alias("entry_cap")
    )


def recognised(content: Column) -> Column:
    """zip, 7z, rar or gzip by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304") | head.startswith("504B0506") | head.startswith("504B0708"), "zip").when(head.startswith("377ABCAF271C"), "7z").when(head.startswith("526172211A07"), "rar").when(head.startswith("1F8B"), "gzip")


def numbered(found: DataFrame) -> DataFrame:
    """Structural findings with their number in the file, for limits such as the first five of a section."""
    return found.withColumn("n", F.row_number().over(W.partitionBy("path", "bucket").orderBy("idx")))


