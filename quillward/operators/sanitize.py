"""Sanitizers: texts cleaned by stripping, masking or placeholders, with counts and ranges of what changed.

Steps in order: look-alikes, invisible characters, control characters, hidden HTML, cells,
phrases. The native form of strip mode is ``detectors.sanitize``; this one also counts, keeps
ranges and has all modes. Ranges of characters are UTF-16 offsets of the text that the step
was given, ranges of marks are offsets of the text that the step gave.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.operators import fields
from quillward.operators.markup import compiled
from quillward.operators.spans import CONTROL, GLYPH, PHRASES, Units, _cls

MODES = ("strip", "mask", "placeholder")
INVISIBLE = re.compile(f"[{_cls('tag', 'known_invisible', 'bidi_embedding', 'bidi_override', 'bidi_isolate')}]")
MASKED = re.compile(f"[{_cls('tag')}{''.join(map(chr, rules.MASK_LABELS))}]")
HIDDEN = [compiled(p) for p in rules.HIDDEN_ELEMENTS]
MARK, GONE = rules.HIDDEN_MARK, "[REMOVED]"


def mask_of(c: str) -> str:
    cp = ord(c)
    if cp in rules.MASK_LABELS:
        return f"[{rules.MASK_LABELS[cp]}]"
    plain = cp - 0xE0000
    return f'[TAG:"{chr(plain)}"]' if 0x20 <= plain <= 0x7E else f"[TAG:{hex(plain)}]"


def control_mask(c: str) -> str:
    cp = ord(c)
    return chr(0x2400 + cp) if cp < 0x20 else "␡" if cp == 0x7F else f"[C1:U+{cp:04X}]"


def spans_of(text: str, regex: re.Pattern, bucket: str, size) -> list[tuple[int, int, str, int]]:
    """Ranges of matches in UTF-16 units with the length of what stands for each."""
    unit = Units(text)
    return [(unit(m.start()), unit(m.end()), bucket, size(m[0])) for m in regex.finditer(text)]


def length(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)


def marks(text: str, mark: str, bucket: str, put: str) -> tuple[str, list]:
    """The text with another mark, and the ranges of the marks before that."""
    found = spans_of(text, re.compile(re.escape(mark)), bucket, lambda _: length(put))
    return (text.replace(mark, put) if put != mark else text), found


def sanitize(text: str, file_type: str = "text", mode: str = "strip", categories=None) -> tuple[str, dict[str, int], list]:
    """(cleaned, counts by bucket, ranges as (start, end, bucket, new length))."""
    if mode not in MODES:
        raise ValueError(f"sanitize: unsupported mode {mode!r} (expected one of strip / mask / placeholder)")
    want = set(rules.BUCKETS if categories is None else categories)
    counts, ranges, out = dict.fromkeys(rules.BUCKETS, 0), [], text
    placeholder = lambda bucket: f"[REDACTED:{bucket}]"
    if "homoglyphs" in want and not out.isascii():
        found = spans_of(out, GLYPH, "homoglyphs", lambda _: 1)
        out = GLYPH.sub(lambda m: rules.LATIN[rules.HOMOGLYPHS.index(m[0])], out)
        counts["homoglyphs"] = len(found)
        ranges += found
    for bucket, all_of, shown, mask in (("invisibleUnicode", INVISIBLE, MASKED, mask_of), ("controlChars", CONTROL, CONTROL, control_mask)):
        if bucket not in want:
            continue
        if mode == "strip":
            ranges += spans_of(out, shown, bucket, lambda _: 0)
            cleaned = all_of.sub("", out)
            counts[bucket] = length(out) - length(cleaned)
        else:
            put = (lambda c: mask(c)) if mode == "mask" else (lambda c, b=bucket: placeholder(b))  # noqa: B023
            found = spans_of(out, shown, bucket, lambda c: length(put(c)))  # noqa: B023
            cleaned = shown.sub(lambda m: put(m[0]), out)  # noqa: B023
            counts[bucket] = len(found)
            ranges += found
        out = cleaned
    if "hiddenHtml" in want and file_type == "html":
        for p in HIDDEN:
            out = p.sub(MARK, out)
        counts["hiddenHtml"] = out.count("[REMOVED: hidden element]")
        put = MARK if mode == "strip" else placeholder("hiddenHtml") if mode == "placeholder" else "[MASKED:hiddenHtml]"
        out, found = marks(out, MARK, "hiddenHtml", put)
        ranges += found
    if "suspiciousPatterns" in want:
        if file_type in ("csv", "xlsx"):
            out, counts["suspiciousPatterns"] = neutral(out)
        for _, p, _, pieces in PHRASES:
            low = out.lower()
            if any(x in low for x in pieces):
                out = p.sub(GONE, out)
        counts["suspiciousPatterns"] += out.count(GONE)
        out, found = marks(out, GONE, "suspiciousPatterns", placeholder("suspiciousPatterns") if mode == "placeholder" else GONE)
        ranges += found
    return out, counts, ranges


def neutral(text: str) -> tuple[str, int]:
    """Risky cells of a csv or spreadsheet text behind an apostrophe, and how many."""
    out, n = [], 0
    for line in text.split("\n"):
        lead, cell, tail = fields.split_cell(line)
        own = fields.plain_cell(cell)
        if own[:1] in ("=", "+", "-", "@", "\t", "\r") and own and not fields.NUMBER.fullmatch(own):
            cell, n = "'" + cell, n + 1
        out.append(lead + cell + tail)
    return "\n".join(out), n


def diff(text: str, ranges: list) -> list[tuple[str, str]]:
    """The text as tokens of kept and changed pieces, in order; overlapping ranges are cut."""
    unit, out, at = Units(text), [], 0
    units = unit.units
    for a, b, bucket, _ in sorted((r for r in ranges if r[2] != "suspiciousPatterns" and r[2] != "hiddenHtml"), key=lambda r: r[:2]):
        a, b = max(a, at), min(b, len(units))
        if a >= b:
            continue
        if a > at:
            out.append(("same", units[at:a]))
        out.append((bucket, units[a:b]))
        at = b
    if at < len(units):
        out.append(("same", units[at:]))
    return [(k, x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")) for k, x in out]


RANGE = "array<struct<start:int,end:int,category:string,new_length:int>>"


def sanitized(spark: SparkSession, docs: DataFrame, mode: str = "strip", categories: list[str] | None = None) -> DataFrame:
    """(doc_id, cleaned, a count of each bucket, ranges) for every row of docs(doc_id, file_type, text); null stays null."""
    if mode not in MODES:
        raise ValueError(f"sanitize: unsupported mode {mode!r} (expected one of strip / mask / placeholder)")
    names = ["invisible_unicode", "control_chars", "hidden_html", "suspicious_patterns", "homoglyphs"]
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("new_length", pa.int32())])

    def rows(batches):
        for batch in batches:
            text, counts, ranges = [], [], []
            for x, kind in zip(batch.column("text").to_pylist(), batch.column("file_type").to_pylist(), strict=True):
                out, n, found = (None, dict.fromkeys(rules.BUCKETS, 0), []) if x is None else sanitize(x, kind, mode, categories)
                text.append(out)
                counts.append(list(n.values()))
                ranges.append([dict(zip(("start", "end", "category", "new_length"), r, strict=True)) for r in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(5)], pa.array(ranges, pa.list_(struct))], ["doc_id", "cleaned", *names, "ranges"])

    kind = F.coalesce(F.col("file_type"), F.lit("text")) if "file_type" in docs.columns else F.lit("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("file_type"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, "doc_id long, cleaned string, " + ", ".join(f"{n} long" for n in names) + f", ranges {RANGE}")


#: File types whose cleaned text keeps its ending; others become plain text.
KEPT_ENDINGS = ("txt", "md", "mdc", "cursorrules", "csv", "json", "html", "htm", "xml", "svg", "yml", "yaml", "toml")


def sanitized_name(path: str) -> str | None:
    """Name of the cleaned copy of a file; archives have none."""
    stem, dot, ext = path.rpartition(".")
    if "/" in ext or not dot:
        stem, ext = path, ""
    if ext.lower() == "zip":
        return None
    return f"{stem}_sanitized.{ext if ext.lower() in KEPT_ENDINGS else 'txt'}"
