"""Container files: one row of bytes in, text and structural findings out.

ZIP archives are judged by their central directory alone; entries are inflated only
where their kind is read and their size is inside the limits. Notebooks are read cell
by cell. Null content counts as empty; nothing here raises on damaged input.
"""

from __future__ import annotations

import io
import json
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

from quillward.functions import rules
from quillward.functions.rules import pattern

#: Limits of archives and notebooks.
MAX_DEPTH, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 3, 10_000, 25 << 20, 100 << 20
MAX_NOTEBOOK, MAX_CELLS, MAX_OUTPUTS, MAX_OUTPUT = 10 << 20, 5_000, 100, 1 << 20
#: Entries read as text, suspicious endings and tags that hide a cell.
TEXT_ENTRIES = ("txt", "md", "mdc", "cursorrules", "csv", "json", "html", "htm", "xml", "svg")
SUSPICIOUS = ("exe", "bat", "cmd", "com", "scr", "msi", "dll", "lnk", "scf", "hta", "vbs", "ps1", "jar")
HIDE_TAG = re.compile(r"(?:hide[-_]input|hide[-_]cell|hide[-_]source|remove[-_]input|remove[-_]cell|injected[-_]parameters)", re.I)
HIDE_FLAGS, JUPYTER_FLAGS = ("collapsed", "hide_input", "hide_output", "scrolled"), ("source_hidden", "outputs_hidden")
MARKUP_OUTPUTS = ("text/html", "application/javascript", "application/x-javascript")

WORDS = [re.compile(pattern(w, "i", "py")) for w in rules.INSTRUCTION_WORDS]
SCHEMA = "path string, text string, technique string, severity string, bucket string, location string"


def like_instruction(text: str) -> bool:
    """At least 40 characters and two listed words that first stand at different places."""
    return len(text) >= 40 and len({m.start() for m in (w.search(text) for w in WORDS) if m}) >= 2


def slip(name: str) -> bool:
    return "\x00" in name or bool(re.match(r"[A-Za-z]:|[/\\]", name)) or ".." in name.replace("\\", "/").split("/")


def archive(data: bytes, depth: int = 0, where: str = "") -> tuple[str, list[tuple]]:
    """Joined text of the readable entries, and (technique, severity, bucket, location) rows."""
    found: list[tuple] = []
    say = lambda technique, severity, bucket="hiddenHtml", at=where: found.append((technique, severity, bucket, at))
    if data[:4] not in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        say("Archive missing ZIP magic", "warning")
        return "", found
    if depth >= MAX_DEPTH:
        say("recursion depth cap", "warning")
        return "", found
    try:
        packed = zipfile.ZipFile(io.BytesIO(data))
        entries = [e for e in packed.infolist() if not e.is_dir()]
    except Exception:
        say("Unsupported or corrupt ZIP", "warning")
        return "", found
    if len(entries) > MAX_ENTRIES:
        say("entry count exceeds cap", "warning")
        return "", found
    if any(e.filename == "[Content_Types].xml" for e in entries):
        say("Office package renamed", "warning", "suspiciousPatterns")
    texts, total = [], 0
    for e in entries:
        at = (f"{where} > " if where else "") + f"ZIP entry:{e.filename}"
        ext = re.split(r"[/\\]", e.filename)[-1].rstrip().rpartition(".")[2].lower()
        if slip(e.orig_filename) or slip(e.filename):
            say("Path-traversal entry name", "danger", "suspiciousPatterns", at)
        if ext in SUSPICIOUS:
            say("Suspicious archive entry extension", "warning", "suspiciousPatterns", at)
        ratio = e.file_size / e.compress_size if e.compress_size else float("inf") if e.file_size else 0
        if ratio >= 100:
            say("Archive bomb ratio" if ratio >= 1000 else "Elevated compression ratio", "danger" if ratio >= 1000 else "warning", at=at)
        if e.file_size > MAX_ENTRY:
            say("per-entry cap", "danger", at=at)
            continue
        total += e.file_size
        if total > MAX_TOTAL:
            say("total cap", "danger")
            break
        if ext not in (*TEXT_ENTRIES, "zip", "ipynb"):
            continue
        if e.flag_bits & 1:
            say("Encrypted archive", "warning", at=at)
            continue
        try:
            with packed.open(e) as f:
                body = f.read(MAX_ENTRY + 1)  # a false size in the directory inflates no further
        except Exception:
            say("Unsupported or corrupt ZIP", "warning", at=at)
            continue
        if ext == "zip":
            text, inner = archive(body, depth + 1, at)
        elif ext == "ipynb":
            text, inner = notebook(body, at)
        else:
            text, inner = body.decode("utf-8", "replace"), []
        texts.append(text)
        found += inner
    return "\n".join(t for t in texts if t), found


def joined(source) -> str:
    return "".join(x for x in source if isinstance(x, str)) if isinstance(source, list) else source if isinstance(source, str) else ""


def notebook(data: bytes, where: str = "") -> tuple[str, list[tuple]]:
    """Cell sources and markup outputs as text, and rows for hidden cells, tags, outputs and a missing signature."""
    found: list[tuple] = []
    say = lambda technique, severity, at, bucket="suspiciousPatterns": found.append((technique, severity, bucket, (f"{where} > " if where else "") + at))
    if len(data) > MAX_NOTEBOOK:
        say("ipynb-scan-limit", "warning", "file", "hiddenHtml")
        return "", found
    try:
        book = json.loads(data.decode("utf-8-sig", "replace"))
    except (ValueError, RecursionError):
        book = None
    if not isinstance(book, dict):
        say("ipynb-corrupt-json", "warning", "file", "hiddenHtml")
        return "", found
    as_dict = lambda x: x if isinstance(x, dict) else {}
    as_list = lambda x: x if isinstance(x, list) else []
    version = book.get("nbformat")
    if isinstance(version, int) and version >= 4 and not as_dict(book.get("metadata")).get("signature"):
        say("ipynb-untrusted-signature", "warning", "metadata")
    cells, texts = as_list(book.get("cells")), []
    if len(cells) > MAX_CELLS:
        say("ipynb-scan-limit", "warning", "cells", "hiddenHtml")
    for k, cell in enumerate(map(as_dict, cells[:MAX_CELLS])):
        text, meta = joined(cell.get("source")), as_dict(cell.get("metadata"))
        texts.append(text)
        tags = [t for t in as_list(meta.get("tags")) if isinstance(t, str)]
        hidden = any(meta.get(x) is True for x in HIDE_FLAGS) or any(as_dict(meta.get("jupyter")).get(x) is True for x in JUPYTER_FLAGS)
        if hidden and like_instruction(text):
            say("ipynb-hidden-cell-instruction", "danger", f"cell {k}")
        for t in tags:
            if like_instruction(t) or HIDE_TAG.fullmatch(t):
                say("ipynb-metadata-tag-smuggle", "danger" if like_instruction(t) else "warning", f"cell {k}")
        for output in map(as_dict, as_list(cell.get("outputs"))[:MAX_OUTPUTS]):
            for kind, body in as_dict(output.get("data")).items():
                body = joined(body) if kind in MARKUP_OUTPUTS else ""
                if body:
                    say("ipynb-output-html-injection", "danger", f"cell {k}")
                    texts.append(body[:MAX_OUTPUT])
    return "\n\n".join(texts), found


READERS = {"archive": archive, "ipynb": notebook}


def structural(files: DataFrame) -> DataFrame:
    """Rows of files(path, file_type, content): the text once per file, then its findings.

    The first row of a file has its text and no technique; the others have no text.
    """
    def rows(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, kind, data in zip(*(batch.column(c).to_pylist() for c in ("path", "file_type", "content")), strict=True):
                text, found = READERS[kind](data or b"")
                out = [(path, text, None, None, None, None), *((path, None, *f) for f in found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names)

    return files.where(files.file_type.isin(*READERS)).select("path", "file_type", "content").mapInArrow(rows, SCHEMA)
