"""RTF, PDF and CSV files as text and structural findings, with the standard library alone."""

from __future__ import annotations

import re
import zlib

from quillward.operators.markup import escaped

H, S = "hiddenHtml", "suspiciousPatterns"
#: Limits, and destinations that RTF readers know.
RTF_MOST, RTF_EACH, RTF_BINARY, RTF_SMALL = 10 << 20, 50, 8, 8
DESTINATIONS = frozenset("""aftncn aftnsep aftnsepc annotation atnauthor atndate atnid atnref atrfend atrfstart author background bkmkend bkmkstart blipuid buptim category
 colorschememapping colortbl company creatim datafield datastore defchp defpap docvar falt fldinst fldrslt fonttbl footer footerf footerl footerr footery footnote ftncn ftnsep ftnsepc generator
 header headerf headerl headerr headery hlinkbase info keywords latentstyles leveltext levelnumbers list listhybrid listlevel listname listoverride listoverridetable listpicture listrestarthdn
 listsimple listtable listtemplateid manager mmathpr nonshppict objalias objclass objdata objname objsect objtime operator panose passwordhash pgptbl picprop pict pntext pntxta pntxtb
 printim propname protusertbl private revtbl revtim result rsidtbl rxe shp shpgrp shpinst shppict shptxt sn sp staticval stylesheet subject sv tc template themedata title txe ud upr
 userprops wgrffmtfilter xmlnstbl xmlattrname xmlattrvalue xmlclose xmlname xmlopen""".split())
CSV_BYTES, CSV_ROWS = 10 << 20, 100_000
PDF_MOST, PDF_ATTACHED = 25 << 20, 5 << 20
RTF_TOKEN = re.compile(r"\\\*\s*\\([a-zA-Z]+)|\\([a-zA-Z]+)(-?[0-9]+)? ?|\\'..|\\.|([{}])|([^\\{}]+)", re.S)


def row(technique: str, severity: str, bucket: str, element: str, content: str = "", location: str | None = None) -> dict:
    return {"technique": technique, "severity": severity, "bucket": bucket, "element": element, "content": escaped(content[:200]), "location": location}


def rtf(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    """One pass over the tokens; at most RTF_EACH findings of a kind, and no text."""
    source, out, counts, at = data[:RTF_MOST].decode("latin-1"), [], {}, 0
    hidden, unseen, wants_class = False, 0, False

    def say(technique, severity, content, location):
        counts[technique] = counts.get(technique, 0) + 1
        if counts[technique] <= RTF_EACH:
            out.append(row(technique, severity, S, f"RTF {location}", content, f"RTF > {location}"))

    def close():
        nonlocal hidden, unseen
        if hidden and unseen:
            say("rtf-hidden-text-v", "warning", str(unseen), "\\v")
        hidden, unseen = False, 0

    while m := RTF_TOKEN.match(source, at):
        at = m.end()
        if m[1]:
            if m[1].lower() not in DESTINATIONS:
                say("rtf-unknown-destination", "warning", m[1].lower(), "\\* destination")
            at = m.start(1) - 1  # the destination is a word as well
        elif m[2]:
            word, number = m[2].lower(), int(m[3]) if m[3] else None
            if word == "bin" and number is not None and number >= 0:
                if number >= RTF_BINARY:
                    say("rtf-binary-block", "warning", str(number), "\\bin")
                at += number
            elif word == "objdata":
                say("rtf-ole-object", "danger", "objdata", "OLE object")
            elif word == "objclass":
                wants_class = True
            elif word == "v":
                close()
                hidden = number != 0
            elif word == "fs" and number is not None and 0 < number <= RTF_SMALL:
                say("rtf-microscopic-font", "warning", f"{number / 2:g}pt", "\\fs")
            elif word == "field":
                link = re.search(r'(?i)HYPERLINK\s+"([^"]+)"', source[at : at + 4096])
                if link:
                    base = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*:)//([^/?#]*)", link[1].strip())
                    say("rtf-field-hyperlink", "warning", f"{base[1].lower()}//{base[2].lower()}" if base else link[1].strip(), "\\field")
        elif m[4] == "}":
            close()
            wants_class = False
        elif m[5]:
            if wants_class and m[5].strip():
                say("rtf-ole-object", "danger", m[5].strip(), "OLE object")
                wants_class = False
            if hidden:
                unseen += len(re.sub("[ \r\n]", "", m[5]))
    close()
    return "", "rtf", out


def csv_cells(text: str):
    """Rows of cells: quotes may open anywhere, a doubled one inside quotes is one, a row ends at CR, LF or both."""
    cells, cell, quoted, i, n = [], [], False, 0, len(text)
    while i < n:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                end = text.find('"', i)
                end = n if end < 0 else end
                cell.append(text[i:end])
                i = end - 1
        elif c == '"':
            quoted = True
        elif c == ",":
            cells.append("".join(cell))
            cell = []
        elif c in "\r\n":
            yield [*cells, "".join(cell)]
            cells, cell = [], []
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
        else:
            cell.append(c)
        i += 1
    if cells or cell:
        yield [*cells, "".join(cell)]


def csv(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    out = []
    if len(data) > CSV_BYTES:
        out.append(row("csv-scan-limit-bytes", "warning", H, "CSV", f"{len(data)} bytes", "CSV"))
        data = data[:CSV_BYTES]
    text = data.decode("utf-16", "replace") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-8-sig", "replace")
    lines = []
    for n, cells in enumerate(csv_cells(text)):
        if n >= CSV_ROWS:
            out.append(row("csv-scan-limit-rows", "warning", H, "CSV", f"more than {CSV_ROWS} rows", "CSV"))
            break
        lines += [c for c in cells if c]
    return "\n".join(lines), "csv", out


class Objects:
    """Objects of a PDF by number: their source text, and streams as they unpack."""

    def __init__(self, data: bytes):
        self.source: dict[int, str] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(\d{1,9})\s+\d{1,5}\s+obj\b(.*?)endobj", data, re.S):
            self._add(int(m[1]), m[2])
        for k in list(self.streams):
            if "/ObjStm" in self.source[k]:
                self._unpack(k)

    def _add(self, number: int, body: bytes) -> None:
        head, mark, rest = body.partition(b"stream")
        self.source[number] = head.decode("latin-1")
        if mark:
            raw = re.sub(rb"^\r?\n", b"", rest, count=1).rpartition(b"endstream")[0]
            if b"/FlateDecode" in head:
                try:
                    raw = zlib.decompressobj().decompress(raw, PDF_MOST)
                except zlib.error:
                    raw = b""
            self.streams[number] = raw

    def _unpack(self, k: int) -> None:
        first = re.search(r"/First\s+(\d+)", self.source[k])
        if first:
            raw, start = self.streams[k], int(first[1])
            pairs = raw[:start].split()
            places = [(int(a), int(b)) for a, b in zip(pairs[::2], pairs[1::2], strict=False) if a.isdigit() and b.isdigit()]
            for (number, at), (_, end) in zip(places, [*places[1:], (0, len(raw) - start)], strict=True):
                self.source.setdefault(number, raw[start + at : start + end].decode("latin-1"))


PDF_STRING = re.compile(r"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<([0-9A-Fa-f\s]*)>", re.S)
#: Kinds of annotations and actions that are told, once each.
PDF_KINDS = {"RichMedia": "pdf-richmedia-embed", "3D": "pdf-3d-embed", "Sound": "pdf-sound-action", "Movie": "pdf-movie-action"}
PDF_ACTIONS = {"SubmitForm": "pdf-submit-form-action", "GoToR": "pdf-goto-remote-action"}


def pdf_text(token: str) -> str:
    """A PDF string as text."""
    if token.startswith("<"):
        digits = re.sub(r"\s", "", token[1:-1])
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        named = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
        raw = re.sub(r"\\([0-7]{1,3})|\\(\r?\n)|\\(.)", lambda m: chr(int(m[1], 8) & 255) if m[1] else "" if m[2] else named.get(m[3], m[3]), token[1:-1], flags=re.S).encode("latin-1", "replace")
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def pdf(data: bytes, name: str = "", attached=None) -> tuple[str, str, list[dict]]:
    """Text operators of content streams, document fields, annotations, actions and attachments.

    attached: reads an attachment's (name, bytes) into the same triple, or None.
    """
    objects, out, texts = Objects(data[:PDF_MOST]), [], []
    for k, raw in objects.streams.items():
        if "/Image" in objects.source[k] or "/FontFile" in objects.source[k] or b"BT" not in raw:
            continue
        body, size, line = raw.decode("latin-1"), 1.0, []
        for m in re.finditer(r"/\S+\s+(-?[0-9.]+)\s+Tf\b|(" + PDF_STRING.pattern + r")\s*(?:Tj|'|\")|\[((?:[^\[\]\\(]|\\.|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|\b(ET)\b", body, re.S):
            if m[1]:
                size = float(m[1]) if re.fullmatch(r"-?\d*\.?\d+", m[1]) else size
            elif m[2] or m[4]:
                own = pdf_text(m[2]) if m[2] else "".join(pdf_text(x[0]) for x in PDF_STRING.finditer(m[4]))
                line.append(own)
                if 0 < abs(size) < 1 and own.strip():
                    out.append(row("microscopic-text", "danger", H, "PDF text", own, "PDF page"))
            elif m[5] and line:
                texts.append(" ".join(line))
                line = []
        if line:
            texts.append(" ".join(line))
    told: set[str] = set()

    def once(technique, content):
        if technique not in told:
            told.add(technique)
            out.append(row(technique, "warning", H, "PDF", content, "PDF"))

    for source in objects.source.values():
        own = {m[1]: pdf_text(m[2]) for m in re.finditer(r"/(Title|Author|Subject|Keywords|Creator|Producer|Contents|URI|V|TU|T|Alt|ActualText|JS)\s*(" + PDF_STRING.pattern + ")", source, re.S)}
        label = "annotation" if "/Annot" in source or "/Subtype" in source else "info" if {"Producer", "Author", "Title"} & set(own) else "field"
        texts += [f"[PDF {label} {key}={value}]" if key != "JS" else f"[PDF action JS] {value}" for key, value in own.items() if value.strip()]
        if re.search(r"/S\s*/JavaScript|/JS\b", source):
            once("pdf-embeds-javascript-actions", own.get("JS", "JavaScript"))
            if "/Widget" in source:
                once("pdf-widget-action", own.get("JS", "JavaScript"))
        for key, technique in PDF_ACTIONS.items():
            if re.search(rf"/S\s*/{key}\b", source):
                once(technique, key)
        for key, technique in PDF_KINDS.items():
            if re.search(rf"/Subtype\s*/{key}\b", source):
                once(technique, key)
        if "/Filespec" in source and "/EF" in source:
            title = next((pdf_text(m[1]) for m in re.finditer(r"/(?:UF|F)\s*(" + PDF_STRING.pattern + ")", source, re.S)), "(unnamed)")
            ref = re.search(r"/EF\s*<<[^>]*/(?:UF|F)\s+(\d+)\s", source)
            body = objects.streams.get(int(ref[1]), b"") if ref else b""
            where = f"Attachment {title}"
            kind = objects.source.get(int(ref[1]), "") if ref else ""
            if len(body) > PDF_ATTACHED:
                out.append(row("pdf-oversize-attachment", "warning", H, "PDF attachment", title, where))
            elif not body.strip():
                out.append(row("pdf-empty-attachment", "warning", H, "PDF attachment", title, where))
            else:
                if re.search("(?i)/Subtype\\s*/text#2Fhtml", kind):
                    out.append(row("pdf-embedded-html", "warning", H, "PDF attachment", title, where))
                inner = attached(title, body) if attached else None
                if inner:
                    texts.append(inner[0])
                    out += [f | {"location": where + (f" > {f['location']}" if f["location"] else "")} for f in inner[2]]
    return "\n".join(t for t in texts if t), "text", out

