"""Places of rule hits, of their shadows and of the ranges around them, as rows and without Python.

One stage reads the texts and gives small events: for every rule, and for every kind of range, the lengths of the
gaps and of the matches in order. All else are windows over the events of a text, which one exchange brings
together: places are sums of what stands before; a hit in a shadow goes back to the text by the sum of what the
shadow left out or stretched; whether a place lies in a range is the farthest end of the ranges that began. So
work grows with hits and ranges, not with texts, and no text crosses the network.

Places and lengths are UTF-16 code units. Null texts have no hits. Rows of one doc_id stay apart.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import CLASSES, pattern
from quillward.operators import detectors as D

#: Characters that an escaped match shows as so many more.
ESCAPED = {"&": 4, "<": 3, ">": 3, '"': 5, "'": 4}
#: Shadows of a text, in the order in which a hit names them.
STRIPPED, FOLDED = "invisibleStripped", "nfkcNormalized"
#: Ranges: a fence opens or closes, code within a line, code elements, quoted lines, addresses.
FENCE = r"(\A|\n)[ \t]{0,3}(`{3,}+|~{3,}+)[^\n]*\n"
INLINE = r"`[^`\n]+`"
TAG = r"(?i)<(?:pre|code)\b[^<>]*>|</(?:pre|code)>"
QUOTE = r"(?:\A|(?<=\n))[ \t]*>[^\n]*"
ADDRESS = "(?i)" + pattern(r"https?://[^\s<>'\"`)]+", "")


def class_of(points: list[int]) -> str:
    """Code points as the body of a bracket expression."""
    runs: list[list[int]] = []
    for cp in sorted(points):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs)


@lru_cache(1)
def folding() -> tuple[str, dict[str, str]]:
    """Of the characters that compatibility normalisation changes one by one: a class of all, and what those become
    that turn into something with an ASCII character; no rule tells the others apart."""
    changed, to = [], {}
    for cp in range(128, 0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2A6DF or cp >= 0xF0000:  # none of them changes
            continue
        new = unicodedata.normalize("NFKC", chr(cp))
        if new != chr(cp):
            changed.append(cp)
            if any(c < "\x80" for c in new):
                to[chr(cp)] = new
    return class_of(changed), to


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def shown(match: Column) -> Column:
    """Length of a match when markup characters are escaped."""
    out = units(match)
    for c, more in ESCAPED.items():
        out = out + (F.length(match) - F.length(F.replace(match, F.lit(c), F.lit("")))) * more
    return out


def event(what: Column, k: Column, gap: Column, size: Column, extra: Column, role: Column) -> Column:
    """gap: units before a match and after the one before it. size: of the match. extra: see stream()."""
    return F.struct(what.alias("what"), k.alias("k"), gap.cast("int").alias("gap"), size.cast("int").alias("size"), extra.cast("int").alias("extra"), role.alias("role"))


NONE = "array<struct<what:string,k:int,gap:int,size:int,extra:int,role:string>>"


def stream(text: Column, regex: Column | str, what: Column | str, extra=None, roles: Column | None = None, test: Column | None = None) -> Column:
    """The events of the matches of a pattern; extra: a function of the match; roles: an array with one for each match.
    Matches without what test finds are passed: their role is `pass`, and placed() drops them."""
    regex, what = (F.lit(x) if isinstance(x, str) else x for x in (regex, what))

    def events(found):
        one = lambda m, i: event(what, i, units(F.get(found["gaps"], i)), units(m), extra(m) if extra else F.lit(0), F.get(found["roles"], i) if test is None else F.when(~F.rlike(m, test), "pass"))
        return F.transform(found["hits"], one)

    own = F.array().cast("array<string>") if roles is None else roles
    both = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hits"), own.alias("roles"))
    return F.when(F.rlike(text, regex), let(both, events)).otherwise(F.array().cast(NONE))


def rule_streams(text: Column, kind: str) -> Column:
    """The streams of all phrase rules of which a text holds a piece: what is the kind and the rule's number."""
    known = F.array(*[F.struct(F.lit(f"{kind}{k}").alias("what"), F.lit(rules.linear(k)[0]).alias("regex"), F.lit(rules.linear(k)[1]).alias("test"), F.array(*map(F.lit, pieces)).alias("pieces")) for k, pieces in enumerate(rules.PHRASE_PIECES)])
    lost = f"{kind}{rules.LOST_RULE}"

    def of(t):
        some = lambda low: F.filter(known, lambda r: F.exists(r["pieces"], lambda x: low.contains(x)))
        def hits(r):
            own = F.when(r["what"] == lost, D.tamed(t, "UPDAT_")).otherwise(t)
            return let(own, lambda x: stream(x, r["regex"], r["what"], shown, test=r["test"]))

        return F.flatten(F.transform(let(F.lower(t), some), hits))

    return let(text, of)


def folded(text: Column) -> tuple[Column, Column]:
    """(the text after compatibility normalisation, the stream of the characters it changes: extra is their new size)."""
    _, to = folding()
    one = {a: b for a, b in to.items() if len(b) == 1}
    more = {a: b for a, b in to.items() if len(b) > 1}
    own = rf"(?![\x00-\x7F])[{class_of([*map(ord, to)])}]"
    keys, values = F.lit("".join(more)), F.split(F.lit("\n".join(more.values())), "\n")
    single = lambda c: F.translate(c, "".join(one), "".join(one.values()))
    new = lambda c: F.when(F.instr(keys, c) > 0, F.get(values, F.instr(keys, c) - 1)).otherwise(single(c))
    whole = F.array_join(F.zip_with(F.split(text, own, -1), F.regexp_extract_all(text, F.lit(own), F.lit(0)), lambda a, c: F.concat(a, F.coalesce(new(c), F.lit("")))), "")
    return whole, stream(text, own, f"mark {FOLDED}", lambda c: units(new(c)))


def roles_of(letters: Column, regex: str) -> Column:
    """One role for each letter: a match of the pattern opens at its first letter and closes at its last, or stays open
    where its last letter is not of its kind; all else has none."""
    closed = lambda t: (F.length(t) > 1) & (F.lower(F.substr(t, F.lit(1), F.lit(1))) == F.substr(t, F.lit(-1), F.lit(1)))
    inside = lambda t: F.when(closed(t), F.concat(F.lit("o"), F.repeat(F.lit("."), F.length(t) - 2), F.lit("c"))).otherwise(F.concat(F.lit("u"), F.repeat(F.lit("."), F.length(t) - 1)))
    both = F.zip_with(F.split(letters, regex, -1), F.regexp_extract_all(letters, F.lit(regex), F.lit(0)), lambda a, t: F.concat(F.repeat(F.lit("."), F.length(a)), F.coalesce(inside(t), F.lit(""))))
    return F.split(F.array_join(both, ""), "")


def fence_roles(text: Column) -> Column:
    """A fence opens unless one is open, and the next of the same mark closes it; one that stays open takes all the rest."""
    marks = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)), lambda m: F.substr(m, F.lit(1), F.lit(1))), "")
    return let(marks, lambda m: roles_of(m, r"`[^`]*(?:`|\z)|~[^~]*(?:~|\z)"))


def tag_roles(text: Column) -> Column:
    """A start tag opens if an end tag of its kind follows, and the first of these closes it."""
    letter = lambda t: F.when(F.lower(t).startswith("</p"), "p").when(F.lower(t).startswith("</c"), "c").when(F.lower(t).startswith("<p"), "P").otherwise("C")
    letters = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), letter), "")

    def closed(x, start, end):
        """Start tags behind the last end tag of their kind become x, so that no search for an end runs in vain."""
        last = F.length(x) - F.instr(F.reverse(x), end) + 1
        cut = F.when(F.instr(x, end) > 0, last).otherwise(0)
        return F.concat(F.substr(x, F.lit(1), cut), F.translate(F.substr(x, cut + 1), start, "x"))

    return let(let(let(letters, lambda x: closed(x, "P", "p")), lambda x: closed(x, "C", "c")), lambda x: roles_of(x, "P[^p]*p|C[^c]*c"))


def range_streams(text: Column) -> Column:
    """The streams of fences, code, quotes and addresses; extra is the line end before a fence, and where an address
    has its question mark."""
    some = lambda test, value: F.when(test, value).otherwise(F.array().cast(NONE))
    lower = F.lower(text)
    return F.concat(
        some(text.contains("```") | text.contains("~~~"), stream(text, FENCE, "fence", lambda m: F.when(m.startswith("\n"), 1).otherwise(0), fence_roles(text))),
        some(text.contains("`"), stream(text, INLINE, "inline")),
        some(lower.contains("</pre>") | lower.contains("</code>"), stream(text, TAG, "tag", roles=tag_roles(text))),
        some(text.contains(">"), stream(text, QUOTE, "quote")),
        some(text.contains("?") & lower.contains("://"), stream(text, ADDRESS, "address", lambda m: F.instr(m, "?"))),
    )


def events(docs: DataFrame, ranges: bool = True, hits: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, units, what, k, gap, size, extra, role) of docs(doc_id, text), the events of a text in one task, with
    the columns of keep.

    A text without a hit has none. rid tells rows apart; it lives within this exchange only."""
    changed = folding()[0]
    strip = f"[{CLASSES['stripped']}]+"
    text = F.col("text")
    own = docs.where("text is not null").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    found = F.array().cast(NONE)
    if hits:
        whole, marks = folded(text)
        less = F.concat(rule_streams(F.regexp_replace(text, strip, ""), STRIPPED + " "), stream(text, strip, f"mark {STRIPPED}"))
        alike = F.concat(let(whole, lambda t: rule_streams(t, FOLDED + " ")), marks)
        # The class of all changed characters is dear to test: only what is rare is put to it, once each.
        rare = F.array_join(F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F\x{C0}-\x{FF}]+", ""), "")), "")
        found = F.concat(rule_streams(text, "direct "), F.when(text.rlike(strip), less).otherwise(F.array().cast(NONE)), F.when(rare.rlike(f"[{changed}]"), alike).otherwise(F.array().cast(NONE)))
    rows = own.select("rid", "doc_id", "text", *keep, F.explode(F.array(found)).alias("found"))
    if hits:
        rows = rows.where(F.exists("found", lambda e: ~e["what"].startswith("mark")))
    if ranges:
        rows = rows.select("rid", "doc_id", "text", *keep, F.concat("found", range_streams(text)).alias("found"))
    return rows.select("rid", "doc_id", *keep, F.explode(F.array(units(text))).alias("units"), "found").select("rid", "doc_id", *keep, "units", F.inline("found")).repartition("rid")


def events_of(docs: DataFrame, streams: Column) -> DataFrame:
    """(rid, doc_id, events) of the streams of docs(doc_id, text), the events of a row in one task."""
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(streams)).alias("found"))
    return own.select("rid", "doc_id", F.inline("found")).repartition("rid")


def placed(found: DataFrame) -> DataFrame:
    """Events with start, and with place: where the event stands in the shadow that its mark makes."""
    order = Window.partitionBy("rid", "what").orderBy("k")
    to, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    out = found.withColumns({"_gaps": F.sum("gap").over(to), "_sizes": F.coalesce(F.sum("size").over(before), none), "_extras": F.coalesce(F.sum("extra").over(before), none)})
    out = out.withColumn("start", F.col("_gaps") + F.col("_sizes")).withColumn("place", F.when(F.col("what").startswith("mark"), F.col("_gaps") + F.col("_extras")))
    return out.where(F.col("role").isNull() | (F.col("role") != "pass")).drop("_gaps", "_sizes", "_extras", "gap")


def hits_of(found: DataFrame) -> DataFrame:
    """placed() events with a and b for hits: their range in the text itself; other events keep null there.

    A mark is a stretch that the shadow shortens to extra units (none for characters left out). A place behind it moves
    by the difference; a place inside it belongs to the whole stretch. The same window runs for the first and the last
    unit of a hit."""
    kind = F.split(F.col("what"), " ")
    shadow = F.when(F.col("what").startswith("mark"), F.get(kind, 1)).when(F.col("what").startswith("direct") | F.col("what").startswith(STRIPPED) | F.col("what").startswith(FOLDED), F.get(kind, 0))
    mark = F.col("what").startswith("mark")
    out = found.withColumn("shadow", shadow).withColumn("_mark", mark)
    hit = F.col("shadow").isNotNull() & ~F.col("_mark")
    out = out.withColumns({"_first": F.coalesce("place", F.col("start")), "_last": F.coalesce("place", F.col("start") + F.col("size") - 1)})
    for at, to in (("_first", "a"), ("_last", "b")):
        span = Window.partitionBy("rid", "shadow").orderBy(at, F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0)
        more = F.when(F.col("_mark"), F.col("size") - F.col("extra"))
        last = F.last(F.when(F.col("_mark"), F.struct(F.col("place").alias("at"), F.col("extra").alias("extra"), F.col("size").alias("size"))), ignorenulls=True).over(span)
        out = out.withColumns({"_shift": F.coalesce(F.sum(more).over(span), F.lit(0)), "_on": last})
        within = F.coalesce(F.col("_on.at") + F.col("_on.extra") > F.col(at), F.lit(False))
        begin = F.col("_on.at") + F.col("_shift") - (F.col("_on.size") - F.col("_on.extra"))
        whole = begin if to == "a" else begin + F.col("_on.size")
        plain = F.col(at) + F.col("_shift") + (0 if to == "a" else 1)
        out = out.withColumn(to, F.when(hit, F.when(within, whole).otherwise(plain)))
    return out.drop("_first", "_last", "_shift", "_on", "_mark")


def ranges_of(found: DataFrame) -> DataFrame:
    """placed() events with kind, low and high for those that make a range: fence, inline, code, quote or query."""
    before = Window.partitionBy("rid", "what").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    opened = F.last(F.when(F.col("role") == "o", end), ignorenulls=True).over(before)
    what, role, first = F.col("what"), F.col("role"), F.col("start") + F.col("extra")
    pair, alone = F.col("role") == "c", (what == "fence") & (role == "u")
    low = F.when(pair, opened).when(alone, end).when(what == "inline", F.col("start") + 1).when(what == "quote", F.col("start")).when((what == "address") & (F.col("extra") > 0), first)
    high = F.when(pair, first).when(alone, F.col("units")).when(what == "inline", end - 1).when(what.isin("quote", "address"), end)
    kind = F.when(what == "fence", "fence").when(what == "inline", "inline").when(what == "tag", "code").when(what == "quote", "quote").when(what == "address", "query")
    out = found.withColumns({"low": low, "high": high}).withColumn("kind", F.when(F.col("low") < F.col("high"), kind))
    # Code within a line counts only outside of fences.
    begun = Window.partitionBy("rid").orderBy("low", F.col("kind") != "fence").rowsBetween(Window.unboundedPreceding, 0)
    far = F.max(F.when(F.col("kind") == "fence", F.col("high"))).over(begun)
    return out.withColumn("_far", far).withColumn("kind", F.when((F.col("kind") == "inline") & (F.col("_far") > F.col("low")), F.lit(None)).otherwise(F.col("kind"))).drop("_far")


#: Columns of a hit, and its flags by the kinds of ranges.
FLAGS = {"in_code": ("fence", "inline", "code"), "in_quote": ("quote",), "in_url_query": ("query",)}


def inside(points: DataFrame, at: str, kinds: dict[str, tuple[str, ...]] = FLAGS) -> DataFrame:
    """Rows with a flag for each group of kinds: whether a range of it begins at or before the row's place and ends after
    it. The join of places and ranges is one sorted pass: the farthest end of what has begun."""
    row = Window.partitionBy("rid").orderBy(F.coalesce("low", F.col(at)), F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    far = {flag: F.max(F.when(F.col("kind").isin(*names), F.col("high"))).over(row) for flag, names in kinds.items()}
    return points.withColumns({flag: F.coalesce(x > F.col(at), F.lit(False)) for flag, x in far.items()})


def unexplained(hits: DataFrame) -> DataFrame:
    """Hits of shadows that no direct hit of the same name, place and shown length explains, and all direct hits. It is an
    anti-join within the texts' own partitions, so it needs no exchange."""
    direct = F.col("shadow") == "direct"
    size = F.when(direct, F.col("extra")).otherwise(F.col("b") - F.col("a"))
    known = F.max(direct).over(Window.partitionBy("rid", "name", "a", "_size"))
    return hits.withColumn("_size", size).withColumn("_known", known).where(direct | ~F.col("_known")).drop("_size", "_known")


def phrase_places(docs: DataFrame, contexts: bool = True) -> DataFrame:
    """(doc_id, name, severity, position, match_len, shadow, text_len) of every hit of a phrase rule in docs(doc_id, text),
    with in_code, in_quote and in_url_query unless contexts is false. shadow is null for direct hits; for others it
    names the shadows that show the hit, joined by a plus sign. Severities are those of the rules."""
    found = hits_of(placed(events(docs, ranges=contexts)))
    if contexts:
        found = inside(ranges_of(found), "a")
    flags = [*FLAGS] if contexts else []
    rule = F.get(F.split("what", " "), 1).try_cast("int")
    names, severities = (F.array(*[F.lit(r[i]) for r in rules.PHRASE_RULES]) for i in (0, 3))
    hits = found.where("a is not null").withColumns({"name": F.get(names, rule), "severity": F.get(severities, rule)})
    kept = unexplained(hits)
    shadows = F.array_join(F.array_sort(F.collect_set(F.when(F.col("shadow") != "direct", F.col("shadow")))), "+")
    each = F.when(F.col("shadow") == "direct", F.col("what"))
    out = kept.groupBy("rid", "doc_id", "name", "a", "b", each.alias("_direct")).agg(F.max("units").alias("text_len"), F.min("severity").alias("severity"), shadows.alias("shadow"), *(F.max(f).alias(f) for f in flags))
    return out.select("doc_id", "name", "severity", F.col("a").cast("int").alias("position"), (F.col("b") - F.col("a")).cast("int").alias("match_len"), F.when(F.col("_direct").isNull(), F.col("shadow")).alias("shadow"), F.col("text_len").cast("int").alias("text_len"), *flags)


def context_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end) of every range of code, quotes and address queries in docs(doc_id, text)."""
    found = ranges_of(placed(events(docs, hits=False)))
    return found.where("kind is not null").select("doc_id", "kind", F.col("low").cast("int").alias("start"), F.col("high").cast("int").alias("end"))
