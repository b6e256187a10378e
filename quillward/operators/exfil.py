"""Image links that carry data away: hosts in tiers, query keys, Markdown and HTML images."""

from __future__ import annotations

import ipaddress
import os
import re
from html import unescape
from urllib.parse import parse_qsl, urlsplit

from quillward.functions import rules
from quillward.functions.linear import opened, upto
from quillward.operators.markup import compiled, escaped

INLINE = compiled(r"!\[([^\]]*)\]\(\s*(\S+?)(?:\s+[\"'][^\"']*[\"'])?\s*\)", "")
REFERENCE = compiled(r"!\[([^\]]*)\]\[([^\]]+)\]", "")
DEFINITION = compiled(r"\[([^\]]+)\]:\s*(\S+)", "")
BANG, LINE_BRACKET, TAG = re.compile(r"!\["), re.compile(r"^[^\S\n]*\[", re.M), re.compile(r"(?i)<img\b")
IMAGE = compiled(r"<img\b[^>]*?\bsrc\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>'\"]+))[^>]*>")
PERCENT = re.compile("%(?:2[0Ff]|26|3[DdFf]|23)")
ENTITY = re.compile("&(?:quot|apos|amp|lt|gt);|&#[0-9]+;|&#[xX][0-9a-fA-F]+;")
SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")


def extra_hosts() -> list[str]:
    """Trusted hosts that the driver's environment adds, comma-separated."""
    return [h for h in (x.strip().lower() for x in os.environ.get("TRUSTED_HOSTS_EXTRA", "").split(",")) if re.fullmatch(r"[a-z0-9.\-]+", h)]


#: In a task, the trusted hosts that the driver was given; elsewhere those of this process.
TRUSTED: frozenset[str] | None = None


def use(hosts: list[str]) -> None:
    """In a task: trust the hosts that extra_hosts() gave where the job was made, whatever this machine's environment says."""
    global TRUSTED
    TRUSTED = frozenset([*rules.TRUSTED_HOSTS, *hosts])


def below(host: str, names) -> bool:
    """Whether the host is one of the names or lies below one."""
    parts = host.split(".")
    return any(".".join(parts[k:]) in names for k in range(len(parts)))


IMAGE_HOSTS, CONTENT_HOSTS = frozenset(rules.IMAGE_HOSTS), frozenset(rules.CONTENT_HOSTS)


def address(host: str):
    """The IP address that a host writes out, in any of the forms that URL parsers read as IPv4; else None."""
    bare = host.strip("[]")
    if ":" in bare:
        if not re.fullmatch("[0-9a-fA-F:.]+", bare):
            return None
        try:
            return ipaddress.IPv6Address(bare)
        except ValueError:
            return None
    parts = bare.rstrip(".").split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch("0[xX][0-9a-fA-F]*|[0-9]+", p) for p in parts):
        return None
    try:
        values = [int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
        if any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
            return None
        return ipaddress.IPv4Address(sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1])) + values[-1])
    except ValueError:
        return None


def private(ip) -> bool:
    if ip.version == 4:
        a, b = ip.packed[:2]
        return a in (0, 10, 127) or (a, b) in ((169, 254), (192, 168)) or (a == 172 and 16 <= b <= 31)
    return ip == ipaddress.IPv6Address("::1") or ip.packed[0] in (0xFC, 0xFD) or (ip.packed[0] == 0xFE and 0x80 <= ip.packed[1] <= 0xBF)


def tier(host: str) -> str:
    """image-only, ip-literal-private, ip-literal-public, trusted-allowlist or unknown."""
    host = host.lower()
    if not host:
        return "unknown"
    if below(host, IMAGE_HOSTS) or host in CONTENT_HOSTS:
        return "image-only"
    ip = address(host)
    if ip is not None:
        return "ip-literal-private" if private(ip) else "ip-literal-public"
    return "trusted-allowlist" if below(host, frozenset([*rules.TRUSTED_HOSTS, *extra_hosts()]) if TRUSTED is None else TRUSTED) else "unknown"


def split_url(raw: str) -> tuple[str, str] | None:
    """Host and query of an http(s) address as a browser reads it; None for others."""
    url = re.sub("[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = re.match(r"(?i)(https?):[/\\]*", url)
    if not m:
        return None
    try:
        parts = urlsplit(f"{m[1].lower()}://" + re.sub(r"\\", "/", url[m.end() :].split("?")[0].split("#")[0]) + url[m.end() + len(url[m.end() :].split("?")[0].split("#")[0]) :])
        host = parts.hostname
        if not host or re.search(r"[\s<>^|%]", host):
            return None
        _ = parts.port
        ip = address(host)
        if ip is None and not host.isascii():
            host = host.encode("idna").decode()
        return (str(ip) if ip is not None else host), parts.query
    except (ValueError, UnicodeError):
        return None


def judge(raw: str) -> tuple[str, str, dict] | None:
    """(severity, technique, meta) of an address as it stands."""
    found = split_url(raw)
    if found is None:
        return None
    host, query = found
    kind = tier(host)
    if kind == "image-only":
        return None
    keys = [k.lower() for k, _ in parse_qsl(query, keep_blank_values=True, max_num_fields=None)]
    strong, weak = [k for k in keys if k in rules.STRONG_KEYS], [k for k in keys if k in rules.WEAK_KEYS]
    if not strong and not weak:
        return None
    meta = {"host": host, "matchedKey": (strong or weak)[0]}
    if kind == "trusted-allowlist":
        if strong:
            return "warning", "md-exfil-allowlist-downgraded", meta | {"hostTier": kind, "strongHits": len(strong), "weakHits": len(weak), "originalSeverity": "danger", "allowlistDowngraded": True}
        return "info", "md-exfil-allowlist-suppressed", meta | {"hostTier": kind, "weakHits": len(weak), "suppressedByAllowlist": True}
    if kind.startswith("ip-literal"):
        own = kind.rpartition("-")[2]
        if own == "private":
            return ("warning", "Markdown image exfiltration (private IP host)", meta | {"ipKind": own}) if strong else None
        return "danger" if strong else "warning", "Markdown image exfiltration (public IP host)", meta | {"ipKind": own}
    if strong:
        return "danger", "Markdown image exfiltration (strong key)", meta | {"strongHits": len(strong), "weakHits": len(weak)}
    return "warning", "Markdown image exfiltration (weak key)", meta | {"weakHits": len(weak)}


def verdict(raw: str) -> tuple[str, str, dict] | None:
    """judge(), and where that finds nothing once more with the reserved characters decoded."""
    found = judge(raw)
    if found or "%" not in raw:
        return found
    decoded = PERCENT.sub(lambda m: chr(int(m[0][1:], 16)), raw)
    found = judge(decoded) if decoded != raw else None
    return found and (found[0], found[1], found[2] | {"percentDecoded": True})


def definitions(text: str):
    """Definitions of references: brackets at the start of a line that a colon follows."""
    at = 0
    while m := LINE_BRACKET.search(text, at):
        end = text.find("]", m.end())
        if end < 0:
            return
        found = DEFINITION.match(text, m.end() - 1) if text.startswith(":", end + 1) else None
        if found:
            yield found
        at = max(found.end() if found else end + 1, m.start() + 1)


def images(text: str) -> list[dict]:
    """Findings of inline images, reference images (at their definition) and <img> elements."""
    out = []

    def say(element, url, at, found):
        if found:
            out.append({"detector": "image-exfil", "element": element, "technique": found[1], "content": escaped(url[:300]), "severity": found[0], "at": at, "size": len(url), "meta": found[2]})

    if "![" in text:
        named = {}
        for m in definitions(text):
            if m[1].strip():
                named[m[1].strip().lower()] = (m[2], m.start(2))
        for m in opened(text, BANG, "]", "(", INLINE):
            say("md-image", m[2], m.start(2), verdict(m[2]))
        for m in opened(text, BANG, "]", "[", REFERENCE):
            if m[2].strip().lower() in named:
                url, at = named[m[2].strip().lower()]
                say("md-image-ref", url, at, verdict(url))
    if "<" in text:
        for m in opened(upto(text, ">"), TAG, ">", "", IMAGE):
            k = next(k for k in (1, 2, 3) if m[k])
            url, found = m[k], verdict(m[k])
            if not found and "&" in url:
                plain = ENTITY.sub(lambda e: unescape(e[0]), url)
                if len(plain) > 1 and plain[0] == plain[-1] and plain[0] in "\"'":
                    plain = plain[1:-1]
                found = verdict(plain) if plain != url else None
                found = found and (found[0], found[1], found[2] | {"entityDecoded": True})
            say("html-img", url, m.start(k), found)
    return out
