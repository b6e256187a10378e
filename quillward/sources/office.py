"""Office packages: Word, PowerPoint, Excel and OpenDocument files as text and structural findings.

Parts are read as trees; a part that is no XML, or too large, counts as absent (spreadsheets
say so). Every reader gives (text, file type, findings); a finding is a dict with technique,
severity, bucket, element, content and location.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from quillward.operators import fields
from quillward.operators.markup import escaped, like_instruction
from quillward.sources import images

#: Limits, magic bytes, endings, names and patterns of office files.
MEDIA_COUNT, MEDIA_BYTES = 50, 5 << 20
SHEET_ARCHIVE, SHEET_PART, SHEETS, SHEET_CELLS = 15 << 20, 8 << 20, 50, 50_000
CFB = bytes.fromhex("d0cf11e0a1b11ae1")
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "webp", "gif", "tif", "tiff")
REMOTE = re.compile(r"(?i)^(?:https?:|file:|ftp:|\\\\)")
BENIGN_FIELD = re.compile(r"(?i)^(?:PAGE|NUMPAGES|TIME|DATE|TOC|REF|PAGEREF|NOTEREF|STYLEREF|SEQ|SET|IF|LISTNUM|FORMTEXT|FORMCHECKBOX|FORMDROPDOWN|SYMBOL|NUMERIC|FILLIN)(?:\s|$)")
FIELD_URL = re.compile("(?i)(?:https?|javascript|data|file|vbscript):")
TEMPLATE_KINDS = ("attachedtemplate", "slidemaster", "oleobject", "frame", "externallink", "hyperlink")
AUTO_NAMES = re.compile(r"(?i)^_xlnm\.?(?:Auto_Open|Auto_Close|Auto_Activate|Auto_Deactivate)$|^Auto_Open$|^Workbook_Open$")
SHEET_DANGER = re.compile(r"(?i)\b(?:HYPERLINK|WEBSERVICE|FILTERXML|IMPORTXML|IMPORTHTML|IMPORTDATA|IMPORTFEED|IMPORTRANGE|CALL|REGISTER|EXEC|RTD|DDE|DDEAUTO)\b|cmd\||powershell")
SHELL_SERVICE = re.compile("(?i)^(?:cmd|powershell|mshta|wscript|cscript|rundll32|regsvr32)$")
SHELL = re.compile(r"(?i)\b(?:cmd(?:\.exe)?|powershell|pwsh|mshta|wscript|cscript|rundll32|regsvr32)\b")
WEB_QUERY = re.compile(r"\b(?:Web\.Contents|Web\.BrowserContents)\b")
EMBED_ENDING = re.compile(r"(?i)\.(?:exe|scr|bat|lnk|hta|cmd|com|js|jse|vbs|vbe|ps1|wsf|wsh)$")
CALLBACK = re.compile(r'(?i)\b(onLoad|onAction|getEnabled|getVisible|getLabel|getImage|getContent)\s*=\s*"([^"]+)"')
CORE_FIELDS = ("title", "subject", "description", "keywords", "category", "creator", "lastModifiedBy")
APP_FIELDS = ("Manager", "Company", "HeadingPairs", "TitlesOfParts")
CUSTOM_XML_MOST = 8 << 10
MACRO_SETTINGS = ("MacroSecurityLevel", "LoadReadonly", "LinkUpdateMode", "ApplyUserData", "MacroExecMode", "DisableMacrosExecution", "UpdateFromTemplate")
BASIC_SINK = re.compile(r"(?i)\b(?:Shell|CreateObject|createUnoService|WScript|Environ|Kill|DDE\w*)\s*\(")
SCRIPT_TARGET = re.compile(r"(?i)^(?:vnd\.sun\.star\.script|javascript|macro|https?|file):|^\\\\")


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = [e.filename for e in self.zip.infolist() if not e.is_dir()]
        self.sizes = {e.filename: e.file_size for e in self.zip.infolist()}

    def bytes(self, name: str, most: int = 25 << 20) -> bytes | None:
        """A part, its first ``most`` bytes; None if it is absent or damaged."""
        if name not in self.sizes:
            return None
        try:
            with self.zip.open(name) as f:
                return f.read(most)
        except Exception:
            return None

    def text(self, name: str, most: int = 25 << 20) -> str:
        return (self.bytes(name, most) or b"").decode("utf-8", "replace")

    def tree(self, name: str, most: int = 25 << 20):
        try:
            return ElementTree.fromstring(self.bytes(name, most) or b"")
        except (ElementTree.ParseError, ValueError, LookupError):
            return None

    def like(self, pattern: str) -> list[str]:
        """Names of a pattern, by the last number in them."""
        found = [n for n in self.names if re.fullmatch(pattern, n)]
        return sorted(found, key=lambda n: (int((re.findall(r"\d+", n) or ["0"])[-1]), n))


def plain(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def every(tree, *names: str):
    return (e for e in tree.iter() if plain(e.tag) in names) if tree is not None else iter(())


def value(element, name: str) -> str | None:
    """An attribute by its name without a namespace."""
    return next((v for k, v in element.attrib.items() if plain(k) == name), None)


def words(element) -> str:
    return "".join(element.itertext())


class Report:
    def __init__(self):
        self.texts: list[str] = []
        self.found: list[dict] = []

    def say(self, technique: str, severity: str, bucket: str, element: str, content: str = "", location: str | None = None) -> None:
        self.found.append({"technique": technique, "severity": severity, "bucket": bucket, "element": element, "content": escaped(content[:200]), "location": location})

    def add(self, text: str) -> None:
        if text:
            self.texts.append(text)


H, S = "hiddenHtml", "suspiciousPatterns"


def relationships(tree) -> list[tuple[str, str, str, str]]:
    """(id, type, target, mode) of a relationships part."""
    return [(e.get("Id", ""), e.get("Type", ""), e.get("Target", ""), e.get("TargetMode", "")) for e in every(tree, "Relationship")]


def media(package: Package, report: Report, folder: str, label: str) -> None:
    """Embedded images: empty and oversize ones, and what the others' metadata say."""
    for n, name in enumerate(x for x in package.names if re.fullmatch(f"{folder}/[^/]+", x) and x.rpartition(".")[2].lower() in IMAGE_ENDINGS):
        if n >= MEDIA_COUNT:
            break
        short = name.rpartition("/")[2]
        data, at = package.bytes(name, MEDIA_BYTES + 1), f"{label} media:{short}"
        if data is None:
            continue
        if not data or len(data) > MEDIA_BYTES:
            report.say("oversize-embedded-image" if data else "empty-embedded-image", "warning", H, f"{label} Embedded Image", short, at)
            continue
        text, _, found = images.read(data, name.rpartition(".")[2].lower())
        if text.strip():
            report.texts += [f"[{at}]", text]
        for f in found:
            report.found.append(f | {"location": f"{at} > {f['location']}" if f["location"] else at})


def embedded(package: Package, report: Report, pattern: str, label: str) -> None:
    for name in package.like(pattern):
        data = package.bytes(name, MEDIA_BYTES + 1) or b""
        if len(data) <= MEDIA_BYTES and data[:8] == CFB:
            report.say("office-embedded-ole-cfb", "warning", S, f"{label} Embedded OLE", name, name)


def custom_properties(package: Package, report: Report) -> None:
    for p in every(package.tree("docProps/custom.xml"), "property"):
        for v in every(p, "lpwstr", "lpstr"):
            if like_instruction(words(v)):
                report.say("custom-property-instruction", "warning", S, f"docProps custom:{escaped(p.get('name', ''))}", words(v))


def docx(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    package, report = Package(data), Report()
    body = package.tree("word/document.xml")
    boxes = {id(r) for box in every(body, "txbxContent") for r in every(box, "r")}
    for run in every(body, "r"):
        text = "".join(words(t) for t in run if plain(t.tag) == "t")
        look = next((x for x in run if plain(x.tag) == "rPr"), None)
        if look is None or not text.strip():
            continue
        marks = {plain(x.tag): value(x, "val") for x in look}
        if "vanish" in marks:
            report.say("hidden-text-vanish", "danger", H, "w:r (Word run)", text)
        if (marks.get("color") or "").upper() == "FFFFFF":
            report.say("white-font-color", "danger", H, "w:r (Word run)", text)
        if marks.get("sz") in ("0", "1", "2", "3"):
            report.say("microscopic-font-size", "danger", H, "w:r (Word run, shape textbox)" if id(run) in boxes else "w:r (Word run)", text)
    for t in every(body, "t"):
        report.add(words(t))
    for t in every(body, "delText"):
        if words(t).strip():
            report.say("tracked-change-deletion", "danger" if like_instruction(words(t)) else "warning", H, "w:del (Tracked-change deletion)", words(t))
    for t in every(body, "instrText"):
        own = words(t)
        loud = bool(FIELD_URL.search(own)) or like_instruction(own)
        if own.strip() and (loud or not BENIGN_FIELD.match(own.strip())):
            report.say("field-instruction", "danger" if loud else "warning", H, "w:instrText (Word field)", own)
    custom_properties(package, report)
    template = next(every(package.tree("word/settings.xml"), "attachedTemplate"), None)
    if template is not None:
        to = next((t for i, _, t, _ in relationships(package.tree("word/_rels/settings.xml.rels")) if i == value(template, "id") and REMOTE.match(t)), None)
        if to:
            report.say("docx-attached-template-remote", "danger", S, "w:attachedTemplate (Word settings)", to)
    for frame in every(package.tree("word/webSettings.xml"), "frame"):
        to = value(frame, "src") or next((value(x, "val") for x in frame if plain(x.tag) == "sourceFileName"), "") or ""
        if REMOTE.match(to):
            report.say("docx-websettings-external-load", "danger", S, "w:frame (Word webSettings frameset)", to)
    for part in package.like(r"customXml/item\d+\.xml"):
        own = " ".join(re.sub("<[^>]+>", " ", package.text(part)).split())
        if like_instruction(own):
            report.say("docx-customxml-instruction", "warning", S, f"customXml {part.rpartition('/')[2]}", own)
    embedded(package, report, r"word/embeddings/[^/]+\.bin", "DOCX")
    comments = " ".join(words(t) for t in every(package.tree("word/comments.xml"), "t"))
    if comments.strip():
        if like_instruction(comments):
            report.say("comment-instruction", "warning", H, "Word Comment", comments)
        report.add(f"[COMMENT] {comments}")
    for part in package.like(r"word/(?:header|footer)\d*\.xml"):
        for t in every(package.tree(part), "t"):
            report.add(words(t))
    media(package, report, "word/media", "DOCX")
    return "\n".join(report.texts), "text", report.found


def slide_text(tree) -> list[str]:
    return [t for p in every(tree, "p") if (t := "".join(words(x) for x in every(p, "t")))]


def pptx(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    package, report = Package(data), Report()

    def part(path: str, label: str, element: str):
        tree = package.tree(path)
        own = slide_text(tree)
        if own:
            report.add(f"[{label}] " + " ".join(own))
        alt = [(k, v) for e in every(tree, "cNvPr") for k in ("descr", "title") if (v := (value(e, k) or "").strip())]
        if alt:
            report.add(f"[{element.lower().replace(' ', '') if ' ' in element else label} alt text] " + " ".join(v for _, v in alt))
        for k, v in alt:
            if like_instruction(v):
                report.say(f"Alt text ({k}=) with instruction-like content", "warning", H, element, v, element)
        return tree, " ".join(own)

    for path in package.like(r"ppt/slides/slide\d+\.xml"):
        k = re.findall(r"\d+", path)[-1]
        where = f"Slide {k}"
        tree, own = part(path, where, where)
        if own.strip() and any(value(e, "hidden") == "1" for e in (tree.iter() if tree is not None else ())):
            report.say('Hidden shape (hidden="1")', "warning", H, where, own, where)
        for shape in every(tree, "sp", "pic", "graphicFrame"):
            for off in every(shape, "off"):
                x, y = (int(off.get(a, "0") or 0) for a in ("x", "y"))
                near = " ".join(words(t) for t in every(shape, "t"))
                if (x < -914400 or y < -914400 or x > 15_000_000 or y > 10_000_000) and near.strip():
                    report.say(f"Off-screen element (x:{x}, y:{y})", "danger", H, where, near, where)
        if any((value(e, "val") or "").upper() == "FFFFFF" for e in (tree.iter() if tree is not None else ())):
            report.say("White font color (#FFFFFF) detected", "warning", H, where, "(May contain invisible text on white background)", where)
    for kind, label in (("slideMaster", "SlideMaster"), ("slideLayout", "SlideLayout")):
        for path in package.like(rf"ppt/{kind}s/{kind}\d+\.xml"):
            k = re.findall(r"\d+", path)[-1]
            part(path, f"{kind}{k}", f"{label} {k}")
    for path in package.like(r"ppt/notesSlides/notesSlide\d+\.xml"):
        k, own = re.findall(r"\d+", path)[-1], " ".join(words(t) for t in every(package.tree(path), "t"))
        if own.strip():
            report.add(f"[Note {k}] {own}")
            if like_instruction(own):
                report.say("Speaker note with instruction-like text", "warning", H, f"Speaker Note (Slide {k})", own, f"Slide {k} > Notes")
    if 'show="0"' in package.text("ppt/presentation.xml"):
        report.say('Hidden slide(s) detected (show="0")', "warning", H, "Presentation", "(Slides set to be hidden during presentation)", "Presentation")
    media(package, report, "ppt/media", "PPTX")
    for _, kind, to, mode in relationships(package.tree("ppt/_rels/presentation.xml.rels")):
        if mode.lower() == "external" and REMOTE.match(to) and kind.rpartition("/")[2].lower() in TEMPLATE_KINDS:
            report.say("pptx-attached-template-remote", "danger", S, "ppt rel (presentation.xml.rels)", to)
    embedded(package, report, r"ppt/embeddings/[^/]+\.bin", "PPTX")
    return "\n".join(report.texts), "text", report.found


def external_target(target: str) -> tuple[str, str] | None:
    """(severity, scheme) of a target outside the package."""
    if re.match(r"\\\\[^\\]+\\|(?i:file:///?\\\\)", target):
        return "danger", "unc"
    if re.match("(?i)javascript:|data:", target):
        return "danger", "jsOrData"
    if re.match("(?i)https?://", target):
        return "warning", "http"
    return ("warning", "file") if re.match("(?i)file:", target) else None


def hides_value(code: str) -> bool:
    """Whether a number format shows nothing, or in white."""
    return bool(re.fullmatch(";+", code.strip()) or re.search(r"(?i)\[(?:White|#FFFFFF|#FFF)\]", code))


def column_letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def cell_place(ref: str) -> tuple[int, int] | None:
    """(column, row) of a reference such as B12."""
    m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", ref)
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return col, int(m[2])


def xlsx(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    report = Report()
    limit = lambda what, at: report.say("xlsx-scan-limit", "warning", H, "XLSX", what, at)
    if len(data) > SHEET_ARCHIVE:
        limit(f"(archive > {SHEET_ARCHIVE} bytes; not scanned)", "XLSX Archive")
        return "", "xlsx", report.found
    try:
        package = Package(data)
    except Exception as e:
        report.say("xlsx-corrupt-zip", "warning", H, "XLSX", str(e), "XLSX Archive")
        return "", "xlsx", report.found

    def tree(part: str):
        if package.sizes.get(part, 0) > SHEET_PART:
            limit(f"({part} inflated > {SHEET_PART} bytes)", part)
            return None
        return package.tree(part, SHEET_PART)

    report.add("[XLSX members] " + " ".join(package.names) if package.names else "")
    for part in ("xl/vbaProject.bin", "xl/vbaProjectSignature.bin"):
        if part in package.sizes:
            report.say("vba-macro-project", "danger", H, "XLSX VBA", part, "xl/vbaProject.bin")
            break
    if (not name or name.lower().endswith(".xlsx")) and any("macroenabled" in (e.get("ContentType") or "").lower() for e in every(tree("[Content_Types].xml"), "Override")):
        report.say("extension-content-type-mismatch", "danger", H, "XLSX", "macroEnabled content type declared but extension is .xlsx", "[Content_Types].xml")
    if package.like(r"(?i)xl/macrosheets/[^/]+"):
        report.say("xlm-macrosheet", "warning", H, "XLSX", "xl/macrosheets/", "xl/macrosheets/")
    book = tree("xl/workbook.xml")
    sheets = [(e.get("name") or "", (e.get("state") or "visible").lower()) for e in every(book, "sheet") if e.get("name")]
    state = dict(reversed(sheets))
    for sheet, how in sheets:
        if how != "visible":
            technique, severity = {"hidden": ("hidden-sheet", "warning"), "veryhidden": ("veryhidden-sheet", "danger")}.get(how, ("sheet-state-confusion", "warning"))
            report.say(technique, severity, H, "XLSX sheet", sheet, f"Sheet '{sheet}'")
    for e in every(book, "definedName"):
        if AUTO_NAMES.search(e.get("name") or ""):
            to = re.match(r"'([^']+)'!|([A-Za-z_][^!]*)!", words(e).strip())
            hidden = to is not None and state.get(to[1] or to[2], "visible") != "visible"
            report.say("auto-run-defined-name", "danger" if hidden or SHEET_DANGER.search(words(e)) else "warning", S, "XLSX definedName", words(e).strip(), e.get("name"))
    for part in package.like(r"xl/externalLinks/externalLink\d+\.xml"):
        own = tree(part)
        for e in every(own, "ddeLink"):
            if e.get("ddeService"):
                report.say("dde-link", "danger" if SHELL_SERVICE.match(e.get("ddeService").strip()) else "warning", S, "XLSX ddeLink", f"{e.get('ddeService')}|{e.get('ddeTopic') or ''}", f"{part} > ddeLink")
        for e in every(own, "oleLink"):
            if value(e, "progId"):
                report.say("external-ole-link", "warning", S, "XLSX oleLink", value(e, "progId"), f"{part} > oleLink")
    for part in package.like(r"(?i)(?:xl/.+|_rels/)\.rels"):
        for to in dict.fromkeys(t for _, _, t, mode in relationships(tree(part)) if mode.lower() == "external"):
            found = external_target(to)
            if found:
                report.say("external-relationship", found[0], S, "XLSX relationship", to, part)
    shared = ["".join(words(t) for t in every(e, "t")) for e in every(tree("xl/sharedStrings.xml"), "si")]
    styles = tree("xl/styles.xml")
    formats = {e.get("numFmtId") for e in every(styles, "numFmt") if hides_value(e.get("formatCode") or "")}
    fonts = [font for group in every(styles, "fonts") for font in group]
    white = {str(k) for k, font in enumerate(fonts) if any(re.fullmatch("(?i)(?:FF)?FFFFFF", c.get("rgb") or "") for c in every(font, "color"))}
    looks = [x for group in every(styles, "cellXfs") for x in group]
    unseen = {str(k): "Hidden cell (numFmt ';;;') carries text" if x.get("numFmtId") in formats else "White-on-white font carries text" for k, x in enumerate(looks) if x.get("numFmtId") in formats or x.get("fontId") in white}
    for n, part in enumerate(package.like(r"xl/worksheets/sheet\d+\.xml")):
        if n >= SHEETS:
            limit(f"(sheet count > {SHEETS}; trailing sheets skipped)", "XLSX Archive")
            break
        k = int(re.findall(r"\d+", part)[-1])
        sheet = sheets[k - 1][0] if 0 < k <= len(sheets) else f"Sheet{k}"
        own, shown = tree(part), 0
        if own is None:
            continue
        report.add(f"[Sheet name] {sheet}")
        hidden_rows = {id(c) for row in every(own, "row") if row.get("hidden") == "1" for c in every(row, "c")}
        late = []
        for c in every(own, "c"):
            if shown >= SHEET_CELLS:
                limit(f"(cell count > {SHEET_CELLS}; trailing cells skipped)", part)
                break
            formula = next((words(f).strip() for f in every(c, "f")), "")
            raw = next((words(v) for v in every(c, "v")), "")
            if c.get("t") == "s":
                text = shared[int(raw)] if raw.strip().isdigit() and int(raw) < len(shared) else ""
            elif c.get("t") == "inlineStr":
                text = "".join(words(t) for t in every(c, "t"))
            else:
                text = "" if formula and c.get("t") != "str" else raw
            at = f"Sheet '{sheet}'!{c.get('r') or '?'}"
            if formula or text:
                shown += 1
                report.add(f"[{at}] " + (formula if formula.startswith("=") else f"={formula}" if formula else text))
            body = text or formula
            if c.get("s") in unseen and body.strip():
                report.say(unseen[c.get("s")], "danger" if like_instruction(body) else "warning", H, "XLSX cell", body, at)
            if id(c) in hidden_rows and text and c.get("t") in ("s", "inlineStr") and like_instruction(text):
                late.append((text, at))
        for text, at in late:
            report.say("Hidden row contains instruction-like text", "warning", H, "XLSX row", text, at)
    for part, names in (("docProps/core.xml", CORE_FIELDS), ("docProps/app.xml", APP_FIELDS)):
        for e in every(tree(part), *names):
            if like_instruction(words(e).strip()):
                report.say("docprops-prompt-injection", "warning", S, "XLSX docProps", words(e).strip(), f"{part} > {plain(e.tag)}")
    for e in every(tree("docProps/app.xml"), "HyperlinkBase"):
        if re.match(r"(?i)https?://|file:|\\\\", words(e).strip()):
            report.say("hyperlink-base-rewrite", "danger", S, "XLSX docProps", words(e).strip(), "docProps/app.xml > HyperlinkBase")
    person = {e.get("id"): e.get("displayName") for part in package.like(r"xl/persons/person\d*\.xml") for e in every(tree(part), "person")}
    for pattern, tag, who in ((r"xl/comments\d*\.xml", "comment", "authorId"), (r"xl/threadedComments/threadedComment\d*\.xml", "threadedComment", "personId")):
        for part in package.like(pattern):
            for e in every(tree(part), tag):
                text = " ".join(words(t) for t in every(e, "t", "text")).strip()
                if like_instruction(text):
                    by = person.get(e.get(who) or "") or ""
                    report.say("instruction-shaped-comment", "warning", H, "XLSX comment", text, f"{part} > {e.get('ref') or '?'}" + (f" > {by}" if by else ""))
    total = 0
    for part in package.like(r"(?i)customXml/item\d+\.xml"):
        own = package.text(part, SHEET_PART)
        total += len(own)
        flat = " ".join(re.sub("<[^>]+>", " ", own).split())
        if like_instruction(flat):
            report.say("CustomXML payload", "warning", H, "XLSX customXml", flat, part)
    if total > CUSTOM_XML_MOST:
        report.say("CustomXML oversize", "warning", H, "XLSX customXml", f"{total} bytes", "customXml/")
    for part in package.like(r"(?i)xl/embeddings/[^/]+"):
        if package.sizes[part] > MEDIA_BYTES:
            report.say("oversize-embedded-object", "warning", H, "XLSX embedding", part, part)
        else:
            head = package.bytes(part, 8) or b""
            report.say("embedded-ole-object", "danger" if head == CFB and EMBED_ENDING.search(re.sub(r"\.bin$", "", part)) else "warning", H, "XLSX embedding", part, part)
    for part in package.like(r"(?i)(?:xl/queries/.+|customXml/item\d+\.xml|xl/connections\.xml)"):
        if WEB_QUERY.search(package.text(part, SHEET_PART)):
            report.say("xlsx-power-query-webcontents", "danger", S, "XLSX query", part, part)
    for e in every(tree("xl/connections.xml"), "connection"):
        own = " ".join([*e.attrib.values(), *(v for x in e.iter() for v in x.attrib.values())])
        if SHELL.search(own):
            report.say("xlsx-data-connection-shell", "danger", S, "XLSX connection", own, "xl/connections.xml")
    for part in package.like(r"(?i)xl/activeX/[^/]+\.xml"):
        report.say("xlsx-activex-control", "warning", S, "XLSX activeX", part, part)
    for part in package.like(r"(?i)customUI/[^/]+\.xml"):
        for key, to in dict.fromkeys(CALLBACK.findall(package.text(part, SHEET_PART))):
            report.say("xlsx-custom-ui-callback", "warning", S, "XLSX customUI", f"{key}::{to}", part)
    media(package, report, "xl/media", "XLSX")
    return "\n".join(report.texts), "xlsx", report.found


def opened(data: bytes, report: Report, technique: str, bucket: str, label: str) -> Package | None:
    try:
        return Package(data)
    except Exception as e:
        report.say(technique, "warning", bucket, label, str(e), f"{label} Archive")
        return None


def odt(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    report = Report()
    package = opened(data, report, "odt-corrupt-package", S, "ODT")
    if package is None:
        return "", "text", report.found
    content = package.tree("content.xml")
    for e in every(content, "p", "h"):
        report.add(words(e))
    for e in every(content, "event-listener"):
        to = value(e, "href") or ""
        if SCRIPT_TARGET.match(to):
            report.say("odt-external-event-listener", "danger", S, "ODT event-listener", to, "content.xml")
    for e in every(package.tree("meta.xml"), "title", "subject", "description", "creator", "keyword", "user-defined"):
        if like_instruction(words(e)):
            report.say("odt-meta-prompt-injection", "warning", S, f"ODT meta:{plain(e.tag)}", words(e), "meta.xml")
    for e in every(package.tree("settings.xml"), "config-item"):
        if value(e, "name") in MACRO_SETTINGS:
            report.say("odt-office-settings-macro", "danger" if re.search("[A-Za-z0-9]", words(e)) else "warning", S, "ODT settings", f"{value(e, 'name')}={words(e)}", "settings.xml")
    for part in package.like(r"Basic/[^/]+/[^/]+\.xml")[:50]:
        report.say("odt-starbasic-macro", "danger" if BASIC_SINK.search(package.text(part)) else "warning", S, "ODT macro", part, part)
    embedded(package, report, r"(?:Object \d+/.*|ObjectReplacements/.*)\.bin", "ODT")
    return "\n".join(report.texts), "text", report.found


def ods(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    report = Report()
    if len(data) > SHEET_ARCHIVE:
        report.say("ods-scan-limit", "warning", H, "ODS", f"(archive > {SHEET_ARCHIVE} bytes; not scanned)", "ODS Archive")
        return "", "ods", report.found
    package = opened(data, report, "ods-corrupt-zip", H, "ODS")
    if package is None:
        return "", "ods", report.found
    content = None
    if package.sizes.get("content.xml", 0) > SHEET_PART:
        report.say("ods-scan-limit", "warning", H, "ODS", f"(content.xml inflated > {SHEET_PART} bytes)", "content.xml")
    else:
        content = package.tree("content.xml", SHEET_PART)
    if any(n.startswith("Basic/") for n in package.names) or any("script" in (value(e, "href") or value(e, "language") or "") for e in every(content, "event-listener")):
        report.say("ods-macro-bearing", "danger", S, "ODS", "Basic/", "ODS Archive")
    unseen = {value(s, "name") for s in every(content, "style") if any(value(p, "display") == "false" for p in every(s, "table-properties"))}
    lines = []
    for n, sheet in enumerate(every(content, "table")):
        title = value(sheet, "name") or f"Sheet{n + 1}"
        if n >= SHEETS:
            report.say("ods-scan-limit", "warning", H, "ODS", f"(sheet count > {SHEETS}; trailing sheets skipped)", "ODS Archive")
            break
        hidden = value(sheet, "style-name") in unseen or value(sheet, "protected") == "true" or value(sheet, "display") == "false"
        report.add(f"[Sheet name] {title}")
        row = shown = 0
        for r in every(sheet, "table-row"):
            row, col = row + 1, 1
            for c in r:
                if plain(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                if shown >= SHEET_CELLS:
                    break
                formula = re.sub("^(?:of|oooc|msoxl):", "", value(c, "formula") or "")
                text = "\n".join(words(p) for p in c if plain(p.tag) == "p")
                at = f"ODS Sheet '{title}'!{column_letters(col)}{row}"
                body = formula if formula.startswith("=") else f"={formula}" if formula else text
                if body:
                    shown += 1
                    lines.append((at, body))
                    report.add(f"[{at}] {body}")
                if formula and re.search(r"(?i)\bDDE\s*\(", formula) and SHELL.search(formula):
                    report.say("ods-external-dde-link", "danger", S, "ODS cell", formula, at)
                if hidden and like_instruction(text):
                    report.say("ods-hidden-sheet-instruction", "danger", S, "ODS cell", text, at)
                col += min(64, int(value(c, "number-columns-repeated") or 1))
    for n, e in enumerate(every(package.tree("settings.xml", SHEET_PART), "config-item")):
        if n < 64 and (external_target(words(e).strip()) or SHELL.search(words(e))):
            report.say("ods-external-dde-link", "danger", S, "ODS settings", words(e).strip(), "settings.xml")
    for at, body in lines:
        found = fields.risk(body)
        if found:
            report.say("ods-formula-injection", found[1], S, "ODS cell", body, at)
    return "\n".join(report.texts), "ods", report.found


def odp(data: bytes, name: str = "") -> tuple[str, str, list[dict]]:
    report = Report()
    package = opened(data, report, "odp-corrupt-package", S, "ODP")
    if package is None:
        return "", "text", report.found
    for part, label in (("content.xml", "Slide"), ("styles.xml", "Master")):
        own = package.tree(part)
        for k, page in enumerate(every(own, "page" if label == "Slide" else "master-page"), 1):
            notes = {id(p) for n in every(page, "notes") for p in every(n, "p")}
            body, said = ([words(p) for p in every(page, "p") if (id(p) in notes) == want] for want in (False, True))
            where = f"{label} {k}"
            if body:
                report.add(f"[{where}] " + " ".join(body))
            if said:
                report.add(f"[{where} notes] " + " ".join(said))
            if like_instruction(" ".join(said)):
                report.say("odp-notes-prompt-injection", "danger", S, f"Speaker Note ({where})", " ".join(said), f"{where} > Notes")
            if label == "Master" and like_instruction(" ".join(body)):
                report.say("odp-master-slide-instruction", "warning", S, where, " ".join(body), where)
            for e in every(page, "event-listener", "sound"):
                to = value(e, "href") or ""
                if re.match("(?i)(?:vnd\\.sun\\.star\\.script|javascript|macro):", to):
                    report.say("odp-slide-transition-macro", "danger", S, where, to, where)
            for e in every(page, "object"):
                to = value(e, "href") or ""
                if re.match(r"(?i)https?:|file:|\\\\|\.\./\.\./", to) or to.startswith("../"):
                    report.say("odp-embedded-object-external", "warning", S, where, to, where)
    for e in every(package.tree("settings.xml"), "config-item"):
        if re.match(r"(?i)https?:|file:|\\\\", words(e).strip()):
            report.say("odp-embedded-object-external", "warning", S, "ODP settings", words(e).strip(), "settings.xml")
    media(package, report, "Pictures", "ODP")
    return "\n".join(report.texts), "text", report.found
