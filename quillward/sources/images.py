"""Metadata of JPEG, PNG, WebP, GIF and TIFF images as text and findings; pixels are never decoded.

Damaged images give what came before the damage and a finding; nothing here raises.
"""

from __future__ import annotations

import re
import struct
import zlib

from quillward.operators.markup import escaped, like_instruction

#: Limits, tags and fields that are read.
MOST, INFLATED, JOINED, FIELDS = 5 << 20, 5 << 20, 1 << 20, 64
IFDS, IFD_DEPTH = 4, 3
TAGS = {0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x013B: "Artist", 0x013C: "HostComputer", 0x8298: "Copyright", 0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA433: "LensMake"}
SUB_IFDS = (0x8769, 0x8825, 0xA005)
IPTC = {5: "ObjectName", 25: "Keywords", 40: "SpecialInstructions", 105: "Headline", 116: "CopyrightNotice", 120: "Caption"}
PNG_KEYS = ("title", "author", "description", "copyright", "creation time", "software", "disclaimer", "warning", "source", "comment", "parameters", "prompt", "workflow", "xml:com.adobe.xmp")
XMP_FIELDS = "dc:title dc:description dc:creator dc:subject dc:rights dc:source dc:publisher dc:contributor xmp:CreatorTool xmp:Label xmp:Nickname photoshop:Headline photoshop:Instructions photoshop:CaptionWriter photoshop:Credit photoshop:Source photoshop:AuthorsPosition xmpRights:UsageTerms xmpRights:Marked Iptc4xmpCore:Title exif:UserComment tiff:ImageDescription tiff:Artist".split()
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
S = "suspiciousPatterns"


class Damaged(Exception):
    pass


def decoded(data: bytes) -> str:
    """UTF-16 with a mark, strict UTF-8, else Latin-1; zero bytes at the end go."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace").rstrip("\0")
    data = data.rstrip(b"\0")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def inflated(data: bytes) -> tuple[str, bool]:
    tool = zlib.decompressobj()
    try:
        out = tool.decompress(data, INFLATED)
    except zlib.error:
        return "", False
    return decoded(out), bool(tool.unconsumed_tail)


def references(text: str) -> str:
    named = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}

    def one(m):
        if m[1] in named:
            return named[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        return chr(code) if code <= 0x10FFFF else m[0]

    return re.sub("&(?:(lt|gt|quot|apos|amp)|#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6}));", one, text)


def xmp(text: str, where: str):
    """Enumerated fields, as elements or attributes, each value once."""
    seen = set()
    for name in XMP_FIELDS:
        own = [re.sub("<[^>]+>", " ", m[1]) for m in re.finditer(rf"<{name}\b[^>]*>(.*?)</{name}>", text, re.S)]
        own += [m[1] or m[2] or "" for m in re.finditer(rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", text)]
        for v in own:
            v = " ".join(references(v).split())
            if v and (name, v) not in seen:
                seen.add((name, v))
                yield f"{where} > {name}", v, "XMP", False


def tiff(data: bytes, where: str):
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise Damaged("no TIFF header")
    order, seen, todo = ("<" if data[:2] == b"II" else ">"), set(), []
    first = struct.unpack_from(order + "I", data, 4)[0]
    todo.append((first, 0, 0))
    while todo:
        at, chain, depth = todo.pop(0)
        if not at or at in seen or chain >= IFDS or depth > IFD_DEPTH:
            continue
        seen.add(at)
        if at + 2 > len(data):
            raise Damaged("IFD beyond the file")
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 2 + 12 * n + 4 > len(data):
            raise Damaged("IFD cut short")
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            size = WIDTHS.get(kind, 0) * count
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            if tag in SUB_IFDS and size == 4:
                todo.append((struct.unpack_from(order + "I", data, place + 8)[0], chain, depth + 1))
            elif tag in TAGS and size and start + size <= len(data):
                raw = data[start : start + size]
                if tag == 0x9286:
                    lead, raw = raw[:8], raw[8:]
                    text = raw.decode("utf-16-le" if order == "<" else "utf-16-be", "replace") if lead.startswith(b"UNICODE") else decoded(raw)
                elif 0x9C9B <= tag <= 0x9C9F:
                    text = raw.decode("utf-16-le", "replace")
                else:
                    text = decoded(raw)
                yield f"{where} > {TAGS[tag]}", text.strip("\0 "), "TIFF", False
        todo.append((struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0], chain + 1, depth))


def iptc(data: bytes, where: str):
    at, wide = 0, False
    while at + 5 <= len(data):
        if data[at] != 0x1C:
            at += 1
            continue
        record, key, size = data[at + 1], data[at + 2], struct.unpack_from(">H", data, at + 3)[0]
        own = data[at + 5 : at + 5 + size]
        if record == 1 and key == 90:
            wide = own == b"\x1b%G"
        elif record == 2 and key in IPTC:
            yield f"{where} > {IPTC[key]}", own.decode("utf-8", "replace") if wide else decoded(own), "IPTC", False
        at += 5 + size


def jpeg(data: bytes):
    if data[:2] != b"\xff\xd8":
        raise Damaged("no JPEG header")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Damaged("marker expected")
        mark = data[at + 1]
        if mark in (0xD9, 0xDA):
            return
        if mark == 0xFF or 0xD0 <= mark <= 0xD7:
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        own = data[at + 4 : at + 2 + size]
        if size < 2 or at + 2 + size > len(data):
            raise Damaged("segment cut short")
        if mark == 0xFE:
            yield "JPEG COM", decoded(own), "JPEG", False
        elif mark == 0xE1 and own.startswith(b"Exif\0\0"):
            yield from tiff(own[6:], "JPEG Exif")
        elif mark == 0xE1 and own.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            yield from xmp(decoded(own[29:]), "JPEG XMP")
        elif mark == 0xED:
            yield from iptc(own, "JPEG IPTC")
        at += 2 + size


def png(data: bytes):
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Damaged("no PNG header")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise Damaged("chunk cut short")
        own = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = own.partition(b"\0")
            name = key.decode("latin-1")
            cut = False
            if kind == b"zTXt":
                text, cut = inflated(rest[1:])
            elif kind == b"iTXt":
                body = rest[2:].split(b"\0", 2)
                raw = body[2] if len(body) > 2 else b""
                text, cut = inflated(raw) if rest[:1] == b"\1" else (raw.decode("utf-8", "replace"), False)
            else:
                text = decoded(rest)
            label = name if name.lower() in PNG_KEYS else "other"
            if name == "XML:com.adobe.xmp":
                yield from xmp(text, "PNG XMP")
            else:
                yield f"PNG {kind.decode()}:{label}", text, "PNG", cut
        elif kind == b"eXIf":
            yield from tiff(own, "PNG Exif")
        elif kind == b"IEND":
            return


def webp(data: bytes):
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("no WebP header")
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        own = data[at + 8 : at + 8 + size]
        if kind == b"EXIF":
            yield from tiff(own[6:] if own.startswith(b"Exif\0\0") else own, "WebP Exif")
        elif kind == b"XMP ":
            yield from xmp(decoded(own), "WebP XMP")
        at += 8 + size + (size & 1)


def gif(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise Damaged("no GIF header")

    def blocks(at):
        out = []
        while at < len(data) and data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(out), at + 1

    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)
    while at < len(data):
        if data[at] == 0x3B:
            return
        if data[at] == 0x2C and at + 10 <= len(data):
            flags = data[at + 9]
            _, at = blocks(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        elif data[at] == 0x21 and at + 2 < len(data):
            kind = data[at + 1]
            if kind == 0xFF and data[at + 3 : at + 14] == b"XMP DataXMP":
                end = data.find(b"\x01\xff\xfe", at)
                yield from xmp(decoded(data[at + 14 : end if end > 0 else len(data)]), "GIF XMP")
                at = data.find(b"\0\0", at) + 2 if data.find(b"\0\0", at) > 0 else len(data)
                continue
            own, at = blocks(at + 2)
            if kind == 0xFE:
                yield "GIF comment", decoded(own), "GIF", False
            elif kind == 0x01:
                yield "GIF plain text", decoded(own[12:]), "GIF", False
        else:
            raise Damaged("unknown block")


WALKERS = {"jpg": jpeg, "jpeg": jpeg, "png": png, "webp": webp, "gif": gif, "tif": lambda d: tiff(d, "TIFF"), "tiff": lambda d: tiff(d, "TIFF")}


def fields_of(data: bytes, ending: str) -> tuple[list[tuple[str, str, str, bool]], str]:
    """(location, value, encoding, cut) of the fields, and what broke the walk."""
    out: list[tuple[str, str, str, bool]] = []
    try:
        for f in WALKERS[ending](data):
            if f[1].strip():
                out.append(f)
    except (Damaged, struct.error, IndexError, ValueError, RecursionError) as e:
        return out, str(e) or "damaged"
    return out, ""


def read(data: bytes, ending: str) -> tuple[str, str, list[dict]]:
    """Joined text of all fields, the file type, and findings."""
    found: list[dict] = []

    def say(technique, severity, content="", location=None):
        found.append({"technique": technique, "severity": severity, "bucket": S, "element": "image metadata", "content": escaped(content[:200]), "location": location})

    if len(data) > MOST:
        say("image-metadata-oversize", "warning", f"{len(data)} bytes", "image")
        return "", "image", found
    fields, broken = fields_of(data, ending)
    if broken:
        say("image-metadata-parse-failed", "warning", broken, "image")
    loud = [f for f in fields if like_instruction(f[1])]
    for where, value, _, _ in loud[:FIELDS]:
        say("image-metadata-injection", "warning", value, where)
    if len(loud) > FIELDS:
        say("image-metadata-field-flood", "warning", f"{len(loud)} fields", "image")
    for where, _, _, cut in fields:
        if cut:
            say("image-metadata-zlib-truncated", "warning", where, where)
    text = "\n----\n".join(f"[IMG {where}] {value}" for where, value, _, _ in fields)
    if len(text) > JOINED:
        say("image-metadata-truncated", "warning", f"{len(text)} characters", "image")
        text = text[:JOINED]
    if len(fields) >= 2 and len(loud) < len(fields) and like_instruction(" ".join(v for _, v, _, _ in fields)):
        say("image-metadata-split-payload", "danger", " ".join(v for _, v, _, _ in fields), "image")
    return text, "image", found


def ranges(text: str, data: bytes, ending: str) -> list[tuple[int, int, str, str]]:
    """(start, end, location, encoding) of the field values in the joined text."""
    out, at = [], 0
    for where, value, encoding, _ in fields_of(data, ending)[0]:
        start = text.find(value, at + len(f"[IMG {where}] "))
        if start < 0:
            break
        out.append((start, start + len(value), where, encoding))
        at = start + len(value)
    return out
