"""Tool descriptors: hidden instructions, injected text, names that collide, and descriptors that changed."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.operators.markup import compiled
from quillward.operators.spans import findings_of

HIDDEN = [compiled(p, f) for p, f in rules.TOOL_RULES]
SIGNAL = compiled(f"[{rules.TOOL_SIGNAL}]", "")
CYRILLIC = re.compile(f"[{rules.TOOL_CYRILLIC}]")
TAGS = compiled(r"[\x{E0000}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200F}\x{FEFF}\x{0}-\x{1F}\x{7F}]", "")


def written(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def canonical(raw: str) -> str:
    """JSON with sorted keys and without blanks; anything else as it stands."""
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except (ValueError, RecursionError):
        return raw


def digest(raw: str) -> str:
    return hashlib.sha256(canonical(raw).encode("utf-8", "surrogatepass")).hexdigest()


def tool_name(name) -> str:
    """A name for display: without tags, directions, zero widths and controls, at most 80 characters."""
    if not isinstance(name, str):
        return "(unnamed)"
    return TAGS.sub("", name)[:80] or "(empty)"


def tools_of(raw: str | None) -> list[dict] | None:
    """Tools of a descriptor in one of its four shapes; None for what is no JSON."""
    try:
        top = json.loads(raw or "")
    except (ValueError, RecursionError):
        return None
    only = lambda xs: [x for x in xs if isinstance(x, dict)]
    if isinstance(top, list):
        return only(top)
    if not isinstance(top, dict):
        return []
    if isinstance(top.get("tools"), list):
        return only(top["tools"])
    out, servers = [], top.get("mcpServers")
    for server, entry in (servers.items() if isinstance(servers, dict) else ()):
        if isinstance(entry, dict) and isinstance(entry.get("tools"), list):
            out += [t | {"name": f"{server}:{t['name']}" if isinstance(t.get("name"), str) else server} for t in only(entry["tools"])]
        elif isinstance(entry, dict):
            out.append({"name": server, "description": written(entry)})
    return out


def told(tool: dict) -> str:
    """Name, description and input schema of a tool as one text."""
    parts = [tool[k] for k in ("name", "description") if isinstance(tool.get(k), str)]
    if isinstance(tool.get("inputSchema"), (dict, list)):
        parts.append(written(tool["inputSchema"]))
    return "\n".join(parts)


def mixed_script(text: str) -> bool:
    """Eight ASCII letters or more beside a Cyrillic look-alike."""
    return len(re.findall("[A-Za-z]", text)) >= 8 and bool(CYRILLIC.search(text))


def judged(raw: str | None) -> list[tuple[str, str, str, int]]:
    """(tool, technique, severity, count) of one descriptor: rules by tool, then names that collide."""
    tools, out, names = tools_of(raw) or [], [], {}
    for tool in tools:
        text, name = told(tool), tool_name(tool.get("name"))
        if any(p.search(text) for p in HIDDEN):
            out.append((name, "mcp-hidden-instruction-in-description", "danger", 1))
        if SIGNAL.search(text) or mixed_script(text):
            out.append((name, "mcp-descriptor-injection", "danger", 1))
        else:
            found = findings_of(text, "text", ["suspiciousPatterns", "invisibleUnicode", "homoglyphs"])
            if any(found.values()):
                out.append((name, "mcp-descriptor-injection", "warning", 1))
        key = tool.get("name") if isinstance(tool.get("name"), str) else "(unnamed)"
        names[key] = names.get(key, 0) + 1
    return out + [(tool_name(k), "mcp-shadow-tool-collision", "danger", n) for k, n in names.items() if n >= 2]


def scan_descriptors(spark: SparkSession, descriptors: DataFrame) -> DataFrame:
    """(descriptor_id, tool, technique, severity, count) of descriptors(descriptor_id, raw); what is no JSON has an error row."""
    def rows(batches):
        for batch in batches:
            out = []
            for key, raw in zip(batch.column("descriptor_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                out += [(key, *r) for r in judged(raw)] if tools_of(raw) is not None else [(key, None, "not valid JSON", "error", 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["descriptor_id", "tool", "technique", "severity", "count"])

    own = descriptors.select(F.col("descriptor_id").cast("string").alias("descriptor_id"), F.col("raw").cast("string").alias("raw"))
    return own.mapInArrow(rows, "descriptor_id string, tool string, technique string, severity string, count long")


def with_digest(descriptors: DataFrame) -> DataFrame:
    """descriptors with the digest of their canonical JSON."""
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else digest(x) for x in batch.column("raw").to_pylist()], pa.string())], [*batch.schema.names, "digest"])

    return descriptors.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in descriptors.schema) + ", digest string")


def rug_pulls(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(descriptor_id, technique, severity, baseline, current): descriptors whose digest differs from the baseline's."""
    now = with_digest(current.select("descriptor_id", "raw")).select("descriptor_id", F.col("digest").alias("now"))
    base = with_digest(baseline.select("descriptor_id", "raw")).select("descriptor_id", F.col("digest").alias("base"))
    changed = now.join(base, "descriptor_id").where("now <> base")
    return changed.select("descriptor_id", F.lit("mcp-rug-pull-detected").alias("technique"), F.lit("danger").alias("severity"), F.substring("base", 1, 8).alias("baseline"), F.substring("now", 1, 8).alias("current"))
