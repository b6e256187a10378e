"""Mail files: sections, headers that disagree, and attachments that are read in their turn."""

from __future__ import annotations

import re
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.utils import getaddresses

from quillward.functions import rules
from quillward.operators.markup import compiled, escaped
from quillward.operators.payloads import decoded_host

H, S = "hiddenHtml", "suspiciousPatterns"
#: Limits, endings, two-level domains, headers and content types.
DEPTH, COUNT, BYTES = 3, 50, 25 << 20
DOUBLE_ENDING = re.compile(r"(?i)\.[a-z0-9]{2,5}\.(?:exe|scr|bat|cmd|vbs|js|jar|ps1)$")
TWO_LEVELS = "co.jp ne.jp or.jp ac.jp go.jp co.uk ac.uk org.uk gov.uk co.kr co.nz com.au net.au org.au com.br com.cn".split()
EXTENDED = ["Reply-To", "Return-Path", "Sender", "X-Original-From", "X-Forwarded-For", "X-Mailer", "X-Originating-IP"]
KINDS = [
    ("application/pdf", "pdf"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"), ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx"),
    ("text/html", "html"), ("message/rfc822", "eml"), ("text/csv", "csv"), ("application/json", "json"), ("text/markdown", "md"), ("application/rtf", "rtf"), ("text/rtf", "rtf"),
    ("image/jpeg", "jpg"), ("image/jpg", "jpg"), ("image/png", "png"), ("image/webp", "webp"), ("image/gif", "gif"), ("image/tiff", "tiff"), ("image/tif", "tiff"),
]
FAILED = re.compile(r"(?i)\b(dmarc|spf|dkim)\s*=\s*(fail|softfail|temperror|permerror)\b")
INVISIBLE = compiled(f"[{rules.TOOL_SIGNAL}]", "")
WORD = re.compile(r"=\?[^?\s]+\?[bBqQ]\?[^?]*\?=")


def safe_location(text: str | None) -> str:
    """A place without escapes, controls, directions and zero widths, each as one question mark."""
    out = re.sub(r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\].*?(?:\x07|\x1b\\)|\x1b[@-_]|\x1b", "?", text or "", flags=re.S)
    return re.sub("[\x00-\x1f\x7f\x85  ‪-‮⁦-⁩​-‏؜﻿⁠᠎]", "?", out)[:200]


def ending_of(name: str | None, content_type: str | None) -> str | None:
    """Extension of an attachment: of its name, else of its content type."""
    ext = re.search(r"\.([^./\\]+)$", name or "")
    if ext:
        return ext[1].lower()
    kind = (content_type or "").lower()
    return next((e for k, e in KINDS if k in kind), "txt" if kind.startswith("text/") else None)


def domain_of(text: str | None) -> str | None:
    """Domain of the first address of a header."""
    if not text:
        return None
    address = next((a for _, a in getaddresses([str(text)]) if "@" in a), str(text))
    inner = re.search("<([^<>]+)>", address)
    _, at, host = (inner[1] if inner else address).partition("@")
    host = re.split(r"[>\"';,\s]", host.strip())[0].lower()
    return host if at and host else None


def organisation(domain: str | None) -> str | None:
    if not domain:
        return None
    labels = [x for x in domain.split(".") if x]
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in TWO_LEVELS else labels[-2:])


def scripts(text: str) -> set[str]:
    out = set()
    for c in text:
        cp = ord(c)
        out |= {"Latin"} if 0x41 <= cp <= 0x5A or 0x61 <= cp <= 0x7A else {"Cyrillic"} if 0x400 <= cp <= 0x52F else {"Greek"} if 0x370 <= cp <= 0x3FF else set()
    return out


def decoded_words(text: str) -> str:
    try:
        return str(make_header(decode_header(text)))
    except Exception:
        return text


def row(technique, severity, bucket, element, content="", location=None):
    return {"technique": technique, "severity": severity, "bucket": bucket, "element": element, "content": escaped(str(content)[:200]), "location": location}


def raw_headers(message) -> list[tuple[str, str]]:
    return [(k, re.sub(r"\r?\n[ \t]+", " ", str(v))) for k, v in message.raw_items()]


def anomalies(message) -> list[dict]:
    """Headers that disagree, failed authentication, look-alike domains, encoded words that hide characters."""
    raw = raw_headers(message)
    first = {}
    for k, v in raw:
        first.setdefault(k.lower(), v)
    out, domain = [], {k: domain_of(decoded_words(first.get(k, ""))) for k in ("from", "reply-to", "return-path", "sender")}
    org = {k: organisation(v) for k, v in domain.items()}
    if org["from"] and org["reply-to"] and org["from"] != org["reply-to"]:
        out.append(row("eml-from-reply-to-mismatch", "warning", S, "Email headers", f"{domain['from']} / {domain['reply-to']}", "Headers > Reply-To"))
    if org["from"] and org["return-path"] and org["from"] != org["return-path"]:
        out.append(row("eml-from-reply-to-mismatch", "warning", S, "Email headers", f"{domain['from']} / {domain['return-path']}", "Headers > Return-Path"))
    if org["from"] and org["sender"] and org["from"] != org["sender"]:
        out.append(row("eml-sender-from-mismatch", "warning", S, "Email headers", f"{domain['from']} / {domain['sender']}", "Headers > Sender"))
    failed = [f"{m[1].lower()}={m[2].lower()}" for k, v in raw if k.lower() in ("authentication-results", "arc-authentication-results", "received-spf") for m in FAILED.finditer(v)]
    if failed:
        out.append(row("eml-authentication-failure", "warning", S, "Email headers", " ".join(failed), "Headers > Authentication-Results"))
    seen = set()
    for host in (h for h in domain.values() if h):
        plain = decoded_host(host) or host
        kinds = scripts(plain)
        if plain in seen or not kinds & {"Cyrillic", "Greek"}:
            continue
        seen.add(plain)
        mixed = len(kinds) > 1
        out.append(row("eml-mixed-script-domain" if mixed else "eml-punycode-homograph-domain", "danger" if mixed else "warning", S, "Email headers", host, "Headers"))
    told = set()
    for _, v in raw:
        for m in WORD.finditer(v):
            plain = decoded_words(m[0])
            kinds = scripts(plain)
            if plain[:64] not in told and (INVISIBLE.search(plain) or ("Latin" in kinds and len(kinds) > 1)):
                told.add(plain[:64])
                out.append(row("eml-encoded-word-invisible-unicode", "danger", S, "Email headers", plain, "Headers"))
    return out


def leaves(part):
    """Parts without parts of their own; a mail inside a mail is one."""
    if part.is_multipart() and part.get_content_type() != "message/rfc822":
        for x in part.get_payload():
            yield from leaves(x)
    else:
        yield part


def text_of(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def sections(data: bytes, depth: int = 0, attached=None) -> tuple[dict[str, str], list[dict], list[tuple[str, str, str, list[dict]]]]:
    """Sections by name, findings, and attachments as (label, text, file type, findings).

    attached: reads (name, ending, bytes, depth) into (text, file type, findings), or None.
    """
    message = message_from_bytes(data, policy=policy.compat32)
    raw = raw_headers(message)
    first = {}
    for k, v in raw:
        first.setdefault(k.lower(), decoded_words(v))
    out = {"headers": "\n".join(f"{k}: {first[k.lower()]}" for k in ("From", "To", "Cc", "Subject", "Date", "Reply-To", "Message-ID") if first.get(k.lower()))}
    named = {k.lower() for k in EXTENDED}
    lines = [f"{k}: {first[k.lower()]}" for k in EXTENDED if first.get(k.lower())]
    lines += [f"{k}: {v}" for k, v in dict(reversed(raw)).items() if k.lower().startswith("x-") and k.lower() not in named]
    out["extended_headers"] = "\n".join(lines)
    body, html, files = [], [], []
    for part in leaves(message):
        kind, name = part.get_content_type(), part.get_filename()
        name = decoded_words(name) if name else None
        if kind == "message/rfc822":
            inner = part.get_payload()
            files.append((name, kind, inner[0].as_bytes() if isinstance(inner, list) and inner else b""))
        elif name is None and part.get_content_disposition() != "attachment" and kind in ("text/plain", "text/html"):
            (html if kind == "text/html" else body).append(text_of(part))
        else:
            files.append((name, kind, part.get_payload(decode=True) or b""))
    out |= {"body": "\n".join(body), "html": "\n".join(html), "attachment_names": "\n".join(n or "(unnamed)" for n, _, _ in files)}
    found, scans = anomalies(message), []
    for name, _, _ in files:
        if name and DOUBLE_ENDING.search(name):
            found.append(row("Suspicious double extension", "danger", H, "Email Attachment", name, f"Attachment {safe_location(name)}"))
        if name and "‮" in name:
            found.append(row("Right-to-Left Override in filename (U+202E)", "danger", H, "Email Attachment", name, f"Attachment {safe_location(name)}"))
    if depth + 1 > DEPTH:
        if files:
            found.append(row(f"Recursion depth limit reached ({DEPTH})", "warning", H, "Email Attachment", "(nested email too deep)", "Email > Attachments"))
        return out, found, scans
    if len(files) > COUNT:
        found.append(row(f"Attachment count limit reached ({COUNT})", "warning", H, "Email Attachment", f"(total: {len(files)})", "Email > Attachments"))
    for i, (name, kind, content) in enumerate(files[:COUNT]):
        title = name or f"(unnamed-{i})"
        where, label, ending = f"Attachment {safe_location(title)}", f"attachment[{i}]: {title}", ending_of(name, kind)
        if len(content) > BYTES:
            found.append(row("Attachment size limit exceeded", "warning", H, label, title, where))
            continue
        if not content:
            found.append(row("Empty attachment", "warning", H, "Email Attachment", title, where))
        try:
            inner = attached(title, ending, content, depth + 1) if attached and ending else None
        except Exception as e:
            found.append(row("Attachment parse error", "warning", H, label, str(e), where))
            continue
        if inner is None:
            continue
        if 0 < len(content) <= 64 and not inner[0].strip():
            found.append(row("whitespace-only-attachment", "warning", S, "Email Attachment", title, where))
        scans.append((label, inner[0], inner[1], [f | {"location": f["location"] if (f["location"] or "").startswith(where) else where + (f" > {f['location']}" if f["location"] else "")} for f in inner[2]]))
    return out, found, scans
