"""Detectors as Catalyst expressions: counts, runs and rewrites, inside the scan's own stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import CLASSES, pattern


#: Blocks of characters that hold all look-alikes: quick to test.
NEAR_GLYPHS = r"[\x{410}-\x{587}\x{13A0}-\x{13FF}\x{FF21}-\x{FF23}]"


def hits(text: str | Column, regex: str) -> Column:
    """Non-overlapping matches, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(regex)), F.lit(0)).cast("long")


def in_class(text: str | Column, name: str) -> Column:
    return hits(text, f"[{CLASSES[name]}]")


def held(text: Column) -> Column:
    """Generates the text once more as a column of its own, so that what is read often is not computed often."""
    return F.explode(F.array(text))


def phrase_hits(text: str | Column, low: Column | None = None) -> list[Column]:
    """Hits of every phrase rule, in rule order. A rule's pattern runs only where the text in lower case (low)
    holds one of the pieces that it needs."""
    low = F.lower(text) if low is None else low
    out = []
    for (_, p, f, _), pieces in zip(rules.PHRASE_RULES, rules.PHRASE_PIECES, strict=True):
        some = low.contains(pieces[0])
        for x in pieces[1:]:
            some = some | low.contains(x)
        out.append(F.when(some, rule_hits(text, len(out))).otherwise(F.lit(0).cast("long")))
    return out


def tamed(text: Column, put: str = "$1\uffff") -> Column:
    """The text with words that begin no statement made unlike it; the mark behind them can be taken out again."""
    lost, word = (pattern(p, "i") for p in rules.LOST)
    return F.array_join(F.zip_with(F.split(text, lost, -1), F.regexp_extract_all(text, F.lit(lost), F.lit(0)), lambda a, x: F.concat(a, F.regexp_replace(F.coalesce(x, F.lit("")), word, put))), "")


def rule_hits(text: str | Column, k: int) -> Column:
    """Hits of a phrase rule in linear time."""
    find, test = rules.linear(k)
    text = F.col(text) if isinstance(text, str) else text
    if not test:
        return hits(tamed(text) if k == rules.LOST_RULE else text, find)
    return F.coalesce(F.size(F.filter(F.regexp_extract_all(text, F.lit(find), F.lit(0)), lambda x: x.rlike(test))), F.lit(0)).cast("long")


def without_rule(text: Column, k: int, put: str) -> Column:
    """The text with put in place of the hits of a phrase rule."""
    find, test = rules.linear(k)
    if test:
        one = lambda a, x: F.concat(a, F.when(x.rlike(test), put).otherwise(F.coalesce(x, F.lit(""))))
        return F.array_join(F.zip_with(F.split(text, find, -1), F.regexp_extract_all(text, F.lit(find), F.lit(0)), one), "")
    if k == rules.LOST_RULE:
        marked = F.replace(F.regexp_replace(tamed(text), find, put), F.lit("\uffff"), F.lit(""))
        return F.when(text.contains("\uffff"), F.regexp_replace(text, find, put)).otherwise(marked)
    return F.regexp_replace(text, find, put)


def upto(text: Column, end: str) -> Column:
    """The text as far as the last end mark, from where on nothing that opens is closed."""
    behind = F.instr(F.reverse(text), end[::-1])
    return F.when(behind > 0, F.substr(text, F.lit(1), F.length(text) - behind + 1)).otherwise(F.lit(""))


def summed(cells: list[Column]) -> Column:
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return total


def phrases_of(text: str | Column, severity: str, low: Column | None = None) -> Column:
    return summed([c for c, r in zip(phrase_hits(text, low), rules.PHRASE_RULES, strict=True) if r[3] == severity])


def bidi(text: str | Column) -> dict[str, Column]:
    """Breakdown of direction controls; from three on all of them are danger."""
    embed, over, iso = (in_class(text, f"bidi_{k}") for k in ("embedding", "override", "isolate"))
    total = embed + over + iso
    return {"total": total, "embedding": embed, "override": over, "isolate": iso, "danger": F.when(total >= 3, total).otherwise(over), "warning": F.when(total >= 3, F.lit(0).cast("long")).otherwise(embed + iso)}


def homoglyphs(text: str | Column) -> Column:
    """Look-alike letters with an ASCII letter on either side; most texts have none in the blocks of the look-alikes."""
    own = f"[{rules.HOMOGLYPHS}]"
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(NEAR_GLYPHS) & text.rlike(own), hits(text, f"(?<=[A-Za-z]){own}|{own}(?=[A-Za-z])")).otherwise(F.lit(0).cast("long"))


def runs(text: str | Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{CLASSES[name]}]+"), F.lit(0))


def stripped(text: str | Column) -> Column:
    """The text without invisible characters, the first shadow."""
    return F.regexp_replace(text, f"[{CLASSES['stripped']}]", "")


def decoded_payloads(text: str | Column, kind: str) -> Column:
    """Decoded base64 or hex runs of the fixed sizes that are three quarters printable, as UTF-8."""
    if kind == "base64":
        found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
        found = F.filter(found, lambda x: (F.length(x) % 4 == 0) & (F.length(x) <= rules.BASE64_SIZES[1]))
        data = F.transform(found, lambda x: F.try_to_binary(x, F.lit("base64")))
    else:
        found = F.regexp_extract_all(text, F.lit("(?i)[0-9a-f]{40,}"), F.lit(0))
        found = F.filter(found, lambda x: (F.length(x) % 2 == 0) & (F.length(x) <= rules.HEX_SIZES[1]))
        data = F.transform(found, lambda x: F.try_to_binary(x, F.lit("hex")))
    odd = lambda x: F.regexp_count(F.decode(x, "ISO-8859-1"), F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    data = F.filter(data, lambda x: x.isNotNull() & (F.octet_length(x) > 0) & (odd(x) * 4 <= F.octet_length(x)))
    return F.transform(data, lambda x: F.make_valid_utf8(x.cast("string")))


def instruction_payloads(text: str | Column, kind: str) -> Column:
    """Decoded payloads that hold an instruction phrase."""
    phrase = "|".join(f"(?:{pattern(p, '')})" for p in rules.DECODED_PHRASES)
    return F.size(F.filter(decoded_payloads(text, kind), lambda x: F.substring(x, 1, 4096).rlike("(?i)" + phrase))).cast("long")


def like_instruction(text: str | Column) -> Column:
    """At least 40 characters and two words of the list that first stand at different places."""
    text = F.col(text) if isinstance(text, str) else text
    places = F.array(*[F.regexp_instr(text, F.lit(pattern(w))) for w in rules.INSTRUCTION_WORDS])
    return (F.length(text) >= 40) & (F.size(F.array_distinct(F.filter(places, lambda p: p > 0))) >= 2)


def image_links(text: str | Column) -> Column:
    """Inline Markdown images: array of (url, strong, weak) with their query keys counted."""
    urls = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*(?:\]\(\s*([^)\s]+)|\]|\z)"), F.lit(1))  # what is no image is passed up to its bracket
    urls = F.filter(urls, lambda u: u != "")

    def keyed(u):
        query = F.regexp_extract(u, r"\?([^#]*)", 1)
        keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.lower(F.element_at(F.split(p, "="), 1)))
        count = lambda names: F.size(F.filter(keys, lambda k: k.isin(names))).cast("long")
        return F.struct(u.alias("url"), count(rules.STRONG_KEYS).alias("strong"), count(rules.WEAK_KEYS).alias("weak"))

    return F.transform(urls, keyed)


def plain_cell(cell: Column) -> Column:
    """A cell without leading blanks and stacked function prefixes, other equals signs as '='."""
    clean = F.regexp_replace(cell, r"^[ \x{A0}]+", "")
    clean = F.regexp_replace(clean, r"^[\x{FF1D}\x{FE66}\x{2E40}]", "=")
    return F.regexp_replace(clean, r"(?i)^(=?)(?:_xlfn\.(?:_xlws\.)?){1,16}", "$1")


def cell_of(line: Column) -> Column:
    """The cell of a line: without the carriage return at its end and a location in brackets before it."""
    body = F.regexp_replace(line, r"\r\z", "")
    close = F.instr(body, "] ")
    return F.when(body.startswith("[") & (close > 1), F.substr(body, close + 2)).otherwise(body)


def formula_kind(cell: Column) -> Column:
    """Name of the rule that a cell breaks, or null: a function or command, a control character, or another risky start."""
    clean = plain_cell(cell)
    first = F.substring(clean, 1, 1)
    kind = F.when(~first.isin("=", "+", "-", "@", "\t", "\r") | (clean == ""), F.lit(None).cast("string"))
    for name, p in rules.FORMULA_RULES:
        kind = kind.when(clean.rlike(pattern(p)), name)
    number = clean.rlike(r"\A(?:[+-]?[0-9]+(?:\.[0-9]+)?|[+-]?[0-9]*\.[0-9]+|\+[0-9]{1,3}[0-9 \-()]{5,})\z")
    return kind.when(first.isin("\t", "\r"), "Formula-prefix control char").when(number, F.lit(None).cast("string")).otherwise("Formula prefix")


def neutral_line(line: Column) -> Column:
    """A line with its risky cell behind an apostrophe; location, line end and numbers stay."""
    own = cell_of(line)
    clean = plain_cell(own)
    number = clean.rlike(r"\A(?:[+-]?[0-9]+(?:\.[0-9]+)?|[+-]?[0-9]*\.[0-9]+|\+[0-9]{1,3}[0-9 \-()]{5,})\z")
    risky = F.substring(clean, 1, 1).isin("=", "+", "-", "@", "\t", "\r") & (clean != "") & ~number
    lead = F.length(F.regexp_replace(line, r"\r\z", "")) - F.length(own)
    return F.when(risky, F.concat(F.substr(line, F.lit(1), lead), F.lit("'"), F.substr(line, lead + 1))).otherwise(line)


def neutral_formula(text: str | Column) -> Column:
    """Every risky cell of a csv or spreadsheet text behind an apostrophe."""
    return F.array_join(F.transform(F.split(text, "\n", -1), neutral_line), "\n")


def sanitize(text: str | Column, file_type: Column | None = None) -> Column:
    """Strip mode: look-alikes, invisible and control characters, hidden HTML, formulas, phrases."""
    return plain_sanitize(latinized(text), file_type)


def latinized(text: str | Column) -> Column:
    """Look-alikes with an ASCII letter on either side in the given text become Latin letters."""
    own = f"[{rules.HOMOGLYPHS}]"
    near = F.lit(f"(?<=[A-Za-z]){own}|{own}(?=[A-Za-z])")
    rest, found = F.split(text, near, -1), F.regexp_extract_all(text, near, F.lit(0))
    return F.array_join(F.zip_with(rest, found, lambda a, g: F.concat(a, F.translate(F.coalesce(g, F.lit("")), rules.HOMOGLYPHS, rules.LATIN))), "")


def without_hidden(text: str | Column) -> Column:
    """HTML without the elements that a double-quoted style or the attribute hides."""
    out = F.col(text) if isinstance(text, str) else text
    for p in rules.HIDDEN_ELEMENTS:
        out = F.regexp_replace(out, pattern(p), rules.HIDDEN_MARK)
    return out


def plain_sanitize(out: Column, file_type: Column | None = None) -> Column:
    """The steps of strip mode after look-alikes."""
    names = ("tag", "known_invisible", "bidi_embedding", "bidi_override", "bidi_isolate")
    out = F.regexp_replace(out, "[" + "".join(CLASSES[n] for n in names) + "]", "")
    out = F.regexp_replace(out, f"[{CLASSES['control']}]", "")
    if file_type is not None:  # one use of the text: lines of other types pass as they are
        out = F.element_at(F.transform(F.array(out), lambda x: F.when(file_type == "html", without_hidden(x)).otherwise(x)), 1)
        cells = file_type.isin("csv", "xlsx")
        out = F.array_join(F.transform(F.split(out, "\n", -1), lambda c: F.when(cells, neutral_line(c)).otherwise(c)), "\n")
    return F.element_at(F.transform(F.array(out), without_phrases), 1)


def _linear_step(k: int):
    """A rule that names its text often, where the text holds a piece of it."""
    def step(x):
        low = F.lower(x)
        some = low.contains(rules.PHRASE_PIECES[k][0])
        for piece in rules.PHRASE_PIECES[k][1:]:
            some = some | low.contains(piece)
        return F.when(some, without_rule(x, k, "[REMOVED]")).otherwise(x)

    return step


def without_phrases(text: Column) -> Column:
    """Every phrase rule's matches replaced, rule by rule; texts without a piece of any rule pass as they are."""
    low = F.lower(text)
    some = F.lit(False)
    for piece in sorted({p for pieces in rules.PHRASE_PIECES for p in pieces}):
        some = some | low.contains(piece)
    out = text
    for k, (_, p, f, _) in enumerate(rules.PHRASE_RULES):
        out = F.element_at(F.transform(F.array(out), _linear_step(k)), 1) if k in rules.LINEAR else F.regexp_replace(out, pattern(p, f), "[REMOVED]")
    return F.when(some, out).otherwise(text)


def priority(severity: Column, bucket: Column, position: Column, length: Column) -> Column:
    """0 to 100: severity base, bucket weight, and up to 15 % more near the start of short texts."""
    base = F.lit(10)
    for k, v in rules.BASE_PRIORITY.items():
        base = F.when(severity == k, F.lit(v)).otherwise(base)
    weight = F.lit(1.0)
    for k, v in rules.BUCKET_WEIGHT.items():
        weight = F.when(bucket == k, F.lit(v)).otherwise(weight)
    head = F.when((length > 0) & (length <= 2000) & position.isNotNull(), 1 + 0.15 * F.greatest(F.lit(0.0), 1 - position / length)).otherwise(F.lit(1.0))
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), base * weight * head)) + 0.5).cast("int")


def reason(bucket: Column, severity: Column, position: Column, length: Column, detector: Column) -> Column:
    """Why a finding ranks where it does; the first of five rules that holds."""
    head = position.isNotNull() & (length > 0) & (length <= 2000) & (position <= length * 0.15)
    out = F.when((severity == "danger") & (bucket == "suspiciousPatterns"), "danger-pattern")
    out = out.when((detector == "bidi-control") | (bucket == "hiddenHtml"), "hidden-html-category-weight").when(head, "head-of-prompt-boost")
    return out.when(severity == "warning", "warning-pattern").otherwise("category-weight")


def label(text: Column) -> Column:
    """A name for display: without control, direction and zero-width characters, cut to 60."""
    clean = F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")
    return F.when(F.length(clean) <= 60, clean).otherwise(F.concat(F.substring(clean, 1, 57), F.lit("...")))


def zip_slip(name: str | Column) -> Column:
    """nullbyte, drive, absolute, dotdot or null, in that order of precedence."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return F.when(name.contains("\x00"), "nullbyte").when(name.rlike("^[A-Za-z]:"), "drive").when(name.rlike(r"^[/\\]"), "absolute").when(F.array_contains(parts, ".."), "dotdot")


def bomb_class(compressed: Column, full: Column) -> Column:
    """safe, elevated from 100, bomb from 1000; nothing compressed to zero bytes is a bomb if full."""
    ratio = F.when(compressed > 0, full / compressed).otherwise(F.when(full > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    return F.when(ratio >= 1000, "bomb").when(ratio >= 100, "elevated").otherwise("safe")


def status(danger: Column, warning: Column) -> Column:
    return F.when(danger > 0, "danger").when(warning > 0, "warning").otherwise("safe")
