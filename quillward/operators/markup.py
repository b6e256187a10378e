"""Hidden elements, comments and style rules of HTML, and the markup rules of vector images.

The tree is lenient: void elements end at once, an end tag closes what stands open inside
its element, one without a start counts for nothing. Every function gives findings as
dicts; positions are code points of the text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from quillward.functions import rules
from quillward.functions.linear import upto
from quillward.functions.rules import pattern

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same kind ends.
SIBLINGS = {"p": ("p",), "li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def compiled(rule: str, flags: str = "i") -> re.Pattern:
    return re.compile(pattern(rule, flags, "py"))


STYLES = [(compiled(p), t) for p, t in rules.ELEMENT_STYLES]
CSS = [(p, compiled(p)) for p in rules.CSS_HIDING]
FRONT, BACK = compiled(r"(?:^|;)\s*color\s*:\s*([^;]+)"), compiled(r"background(?:-color)?\s*:\s*([^;]+)")
COMMENT = re.compile(r"<!--(.*?)-->", re.S)
WORDS = [compiled(w) for w in rules.INSTRUCTION_WORDS]
SVG = {name: (compiled(p, "" if name == "svg-cdata-section" else "i"), severity) for name, p, severity in rules.SVG_RULES}
ENDS = {"svg-script-element": ">", "svg-foreignobject-html": ">", "svg-use-external-ref": ">", "svg-cdata-section": "]]>"}
USE_HREF = compiled(r"\s(?:xlink:href|href)\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>]+))")
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
TRIM = pattern(r"\s", "", "py").removeprefix("(?a)")
EDGES = re.compile(f"^(?:{TRIM})+|(?:{TRIM})+$")


def escaped(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def trimmed(text: str) -> str:
    return EDGES.sub("", text)


def like_instruction(text: str) -> bool:
    """At least 40 characters and two listed words that first stand at different places."""
    return len(text) >= 40 and len({m.start() for m in (w.search(text) for w in WORDS) if m}) >= 2


class Elements(HTMLParser):
    """Elements with a style or the hidden attribute, and their text as a range of the page's."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.size, self.stack, self.found, self.styles = 0, [], [], []
        self.counts: dict[str, int] = {}
        self.feed(page)
        self.close()
        self.pop_to(0)
        self.whole = "".join(self.text)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, mark = self.stack.pop()
            self.counts[tag] -= 1
            if mark is not None:
                self.found[mark][-1] = self.size

    def end(self, tags: tuple[str, ...]) -> None:
        if any(self.counts.get(t) for t in tags):
            k = len(self.stack) - 1
            while self.stack[k][0] not in tags:
                k -= 1
            self.pop_to(k)

    def handle_starttag(self, tag, attrs):
        if tag in SIBLINGS:
            self.end(SIBLINGS[tag])
        elif tag in BLOCKS:
            self.end(("p",))
        own, mark = dict(reversed(attrs)), None
        if "style" in own or "hidden" in own:
            mark = len(self.found)
            self.found.append([tag, own.get("style") or "", "hidden" in own, self.size, self.size])
        if tag in VOID:
            return
        self.stack.append((tag, mark))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag == "style":
            self.styles.append([])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.end((tag,))

    def handle_data(self, data):
        self.text.append(data)
        self.size += len(data)
        if self.stack and self.stack[-1][0] == "style":
            self.styles[-1].append(data)


def hidden(text: str) -> list[dict]:
    """Elements whose style, colours or attribute hide their text, style rules that hide, comments that instruct."""
    out = []
    if "<" not in text:
        return out
    page = Elements(text)
    for tag, style, attribute, a, b in page.found:
        own = trimmed(page.whole[a:b])
        if not own:
            continue
        hits = [t for p, t in STYLES if p.search(style)]
        hits += ["hidden attribute"] * attribute
        front, back = FRONT.search(style), BACK.search(style)
        if front and back and front[1].strip().lower() == back[1].strip().lower():
            hits.append(f"Same fg/bg color ({front[1].strip().lower()})")
        out += [{"detector": "hidden-element", "element": tag, "technique": t, "content": escaped(own[:200]), "severity": "danger"} for t in hits]
    for parts in page.styles:
        css = "".join(parts)
        out += [{"detector": "css-rule", "element": "<style>", "technique": f"CSS rule: {source}", "content": "(stylesheet contains hiding rules)", "severity": "warning"} for source, p in CSS if p.search(css)]
    for m in COMMENT.finditer(upto(text, "-->")):
        own = trimmed(m[1])
        if len(own) > 10 and like_instruction(own):
            out.append({"detector": "html-comment", "element": "<!-- comment -->", "technique": "HTML comment with instruction", "content": escaped(own[:200]), "severity": "warning"})
    return out


def vector(text: str, most: int | None = rules.SVG_MOST, cap: int | None = rules.SVG_CAP) -> list[dict]:
    """Markup rules of vector images in the first most characters, at most cap findings of each; None lifts either."""
    out = []
    text = text if most is None else text[:most]

    def value(m, first):
        return next((m[k] for k in range(first, first + 3) if m[k] is not None), "")

    for name, (regex, severity) in SVG.items():
        n = 0
        for m in regex.finditer(upto(text, ENDS[name]) if name in ENDS else text):
            if cap is not None and n >= cap:
                break
            element, content, meta = "svg", m[0], None
            if name == "svg-event-handler":
                element, content, meta = "svg attribute", value(m, 2), {"attribute": m[1].lower()}
            elif name == "svg-javascript-href":
                element, content = "svg href", value(m, 1)
                if not re.sub("^[\x00-\x20]+", "", content).lower().startswith("javascript:"):
                    continue
            elif name == "svg-cdata-section":
                element, content = "svg CDATA section", m[1]
            elif name == "svg-use-external-ref":
                ref = USE_HREF.search(m[1])
                to = trimmed(value(ref, 1)) if ref else ""
                if not to or to.startswith("#"):
                    continue
                element, meta = "svg:use", {"href": to[:200]}
            else:
                element = "svg:" + ("script" if name == "svg-script-element" else "foreignObject")
            n += 1
            out.append({"detector": "svg", "element": element, "technique": name, "content": escaped(content[:200]), "severity": severity, "meta": meta})
    return out
