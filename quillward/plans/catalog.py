"""Named queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import CLASSES, pattern
from quillward.operators import detectors as D
from quillward.operators import markup, sanitize, spans
from quillward.plans import scan
from quillward.sources.corpus import corpus, corpus_sql, quoted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def n_(regex: str, text: str = "text") -> str:
    """DuckDB: number of matches."""
    return f"len(regexp_extract_all({text}, {quoted(regex)}))"


def cls_(name: str, text: str = "text") -> str:
    return n_(f"[{CLASSES[name]}]", text)


def rule_(k: int, text: str = "text") -> str:
    _, p, f, _ = rules.PHRASE_RULES[k]
    return n_(pattern(p, f, "re2"), text)


def phrases_(severity: str, text: str = "text") -> str:
    return "(" + " + ".join(rule_(k, text) for k, r in enumerate(rules.PHRASE_RULES) if r[3] == severity) + ")"


def _low(docs: DataFrame) -> DataFrame:
    """docs with the text in lower case as a column of its own."""
    return docs.select("*", F.explode(F.array(F.lower("text"))).alias("low"))


C = corpus_sql()
BIDI_ = f"({cls_('bidi_embedding')} + {cls_('bidi_override')} + {cls_('bidi_isolate')})"
#: Look-alikes with a Latin neighbour, without lookaround: windows of three characters.
GLYPHS_ = f"len(list_filter(range(1, length(text) + 1), lambda i: contains('{rules.HOMOGLYPHS}', text[i]) and (regexp_matches(text[i + 1], '^[A-Za-z]') or (i > 1 and regexp_matches(text[i - 1], '^[A-Za-z]')))))"
GLYPH_ROWS_ = f"case when regexp_matches(text, '[{rules.HOMOGLYPHS}]') then {GLYPHS_} else 0 end"


@query(f"select r.idx::int idx, r.name as name, r.severity severity, sum(r.n)::bigint hits, count(*) filter (r.n > 0)::bigint docs from {C} c, lateral (select unnest([{', '.join(f"{{'idx': {k}, 'name': {quoted(r[0])}, 'severity': {quoted(r[3])}, 'n': {rule_(k)}}}" for k, r in enumerate(rules.PHRASE_RULES))}]) r) group by all")
def phrase_rule_counts(spark, sf_dir):
    """Hits and documents of every phrase rule: one scan, partial sums, then 43 rows."""
    cells = F.explode(F.array(F.array(*D.phrase_hits("text", F.col("low"))))).alias("h")
    sums = [x for k in range(len(rules.PHRASE_RULES)) for x in (F.sum(F.col("h")[k]).alias(f"h{k}"), F.count_if(F.col("h")[k] > 0).alias(f"d{k}"))]
    total = _low(corpus(spark, sf_dir)).select(cells).agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(r[0]).alias("name"), F.lit(r[3]).alias("severity"), F.coalesce(f"h{k}", F.lit(0)).cast("long").alias("hits"), F.col(f"d{k}").alias("docs")) for k, r in enumerate(rules.PHRASE_RULES)])
    return total.select(F.inline(rows))


@query(f"select doc_id, {phrases_('danger')}::bigint danger_count, {phrases_('warning')}::bigint warning_count, case when {phrases_('danger')} > 0 then 'danger' when {phrases_('warning')} > 0 then 'warning' else 'safe' end status from {C}")
def phrase_doc_status(spark, sf_dir):
    low = F.col("low")
    counts = F.struct(D.phrases_of("text", "danger", low).alias("danger_count"), D.phrases_of("text", "warning", low).alias("warning_count"))
    found = _low(corpus(spark, sf_dir)).select("doc_id", F.explode(F.array(counts)).alias("c")).select("doc_id", "c.*")
    return found.withColumn("status", D.status(F.col("danger_count"), F.col("warning_count")))


@query(f"select source, lang, sum({phrases_('danger')} + {phrases_('warning')})::bigint hits, count(*)::bigint docs from {C} group by rollup (source, lang)")
def phrase_hits_by_source_lang(spark, sf_dir):
    found = _low(corpus(spark, sf_dir)).select("source", "lang", (D.phrases_of("text", "danger", F.col("low")) + D.phrases_of("text", "warning", F.col("low"))).alias("h"))
    return found.rollup("source", "lang").agg(F.sum("h").alias("hits"), F.count("*").alias("docs"))


def _class_query(name: str, classes: list[str]):
    sql = " + ".join(cls_(c) for c in classes)

    @query(f"select doc_id, ({sql})::bigint hits from {C} where ({sql}) > 0")
    def f(spark, sf_dir):
        return corpus(spark, sf_dir).select("doc_id", D.summed([D.in_class("text", c) for c in classes]).alias("hits")).where("hits > 0")

    del QUERIES["f"]
    QUERIES[name], ORACLES[name] = f, ORACLES.pop("f")


for _name, _classes in {"tag_chars": ["tag"], "bidi_controls": ["bidi_embedding", "bidi_override", "bidi_isolate"], "known_invisible": ["known_invisible"], "private_use": ["private_use"], "control_chars": ["control"]}.items():
    _class_query(_name, _classes)


@query(f"select doc_id, {BIDI_}::bigint total, {cls_('bidi_embedding')}::bigint embedding, {cls_('bidi_override')}::bigint override_count, {cls_('bidi_isolate')}::bigint isolate, (case when {BIDI_} >= 3 then {BIDI_} else {cls_('bidi_override')} end)::bigint danger, (case when {BIDI_} >= 3 then 0 else {cls_('bidi_embedding')} + {cls_('bidi_isolate')} end)::bigint warning from {C} where {BIDI_} > 0")
def bidi_breakdown(spark, sf_dir):
    b = D.bidi("text")
    return corpus(spark, sf_dir).select("doc_id", *[c.alias("override_count" if k == "override" else k) for k, c in b.items()]).where("total > 0")


@query(f"select count(*)::bigint docs from {C} where {BIDI_} >= 3")
def bidi_overuse(spark, sf_dir):
    return corpus(spark, sf_dir).where(D.bidi("text")["total"] >= 3).agg(F.count("*").alias("docs"))


@query(f"select doc_id, ({GLYPH_ROWS_})::bigint hits from {C} where {GLYPH_ROWS_} > 0")
def homoglyph_hits(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.homoglyphs("text").alias("hits")).where("hits > 0")


@query("select glyph, latin from (values " + ", ".join(f"('{g}', '{x}')" for g, x in zip(rules.HOMOGLYPHS, rules.LATIN, strict=True)) + ") v(glyph, latin) where not regexp_matches(latin, '^[A-Za-z]$') or ord(glyph) < 128")
def homoglyph_map_audit(spark, sf_dir):
    """Map entries that do not lead from a non-ASCII letter to a Latin one; none is expected."""
    rows = spark.createDataFrame(list(zip(rules.HOMOGLYPHS, rules.LATIN, strict=True)), "glyph string, latin string")
    return rows.where(~F.col("latin").rlike("^[A-Za-z]$") | (F.ascii("glyph") < 128))


@query(f"select doc_id, length(r)::bigint run_length, case when length(r) >= 4 then 'danger' when length(r) >= 2 then 'warning' else 'info' end severity, count(*)::bigint runs from (select doc_id, unnest(regexp_extract_all(text, {quoted('[' + CLASSES['math'] + ']+')})) r from {C}) group by all")
def math_runs(spark, sf_dir):
    r = corpus(spark, sf_dir).select("doc_id", F.explode(D.runs("text", "math")).alias("r"))
    return r.select("doc_id", F.length("r").cast("long").alias("run_length")).withColumn("severity", F.expr("case when run_length >= 4 then 'danger' when run_length >= 2 then 'warning' else 'info' end")).groupBy("doc_id", "run_length", "severity").agg(F.count("*").alias("runs"))


@query(f"select doc_id, length(r)::bigint run_length, count(*)::bigint runs from (select doc_id, unnest(regexp_extract_all(text, {quoted('[' + CLASSES['variation'] + ']+')})) r from {C}) group by all")
def variation_selector_runs(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.explode(D.runs("text", "variation")).alias("r")).groupBy("doc_id", F.length("r").cast("long").alias("run_length")).agg(F.count("*").alias("runs"))


@query(f"select doc_id, length(r)::bigint stack_depth, case when length(r) >= 15 then 'danger' else 'warning' end severity from (select doc_id, unnest(regexp_extract_all(text, {quoted('[' + CLASSES['combining'] + ']+')})) r from {C}) where length(r) >= 8")
def combining_stacks(spark, sf_dir):
    r = corpus(spark, sf_dir).select("doc_id", F.explode(D.runs("text", "combining")).alias("r")).where(F.length("r") >= 8)
    return r.select("doc_id", F.length("r").cast("long").alias("stack_depth"), F.when(F.length("r") >= 15, "danger").otherwise("warning").alias("severity"))


SHADOW_ = f"regexp_replace(text, {quoted('[' + CLASSES['stripped'] + ']')}, '', 'g')"


@query(f"select doc_id, (length(text) - length({SHADOW_}))::bigint removed, sha256({SHADOW_}) shadow_sha256 from {C} where {SHADOW_} <> text and {SHADOW_} <> ''")
def shadow_invisible_stripped(spark, sf_dir):
    s = corpus(spark, sf_dir).withColumn("s", D.stripped("text")).where("s <> text and s <> ''")
    return s.select("doc_id", (F.length("text") - F.length("s")).cast("long").alias("removed"), F.sha2("s", 256).alias("shadow_sha256"))


@query(f"select doc_id, {phrases_('danger', 's')}::bigint shadow_danger, {phrases_('danger')}::bigint direct_danger from (select *, {SHADOW_} s from {C}) where s <> text and {phrases_('danger', 's')} > {phrases_('danger')}")
def shadow_new_hits(spark, sf_dir):
    s = corpus(spark, sf_dir).withColumn("s", D.stripped("text")).where("s <> text")
    return s.select("doc_id", D.phrases_of("s", "danger").alias("shadow_danger"), D.phrases_of("text", "danger").alias("direct_danger")).where("shadow_danger > direct_danger")


@query(f"select doc_id, len(r)::bigint runs, list_sum(list_transform(r, lambda x: length(x)))::bigint chars from (select doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]{{20,}}={{0,2}}'), lambda x: length(x) % 4 = 0) r from {C}) where len(r) > 0")
def base64_runs(spark, sf_dir):
    r = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0)), lambda x: F.length(x) % 4 == 0)
    d = corpus(spark, sf_dir).select("doc_id", r.alias("r")).where(F.size("r") > 0)
    return d.select("doc_id", F.size("r").cast("long").alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


DECODED_ = "(?i)" + "|".join(f"(?:{pattern(p, '', 're2')})" for p in rules.DECODED_PHRASES)


def _decoded_query(name: str, kind: str, regex: str, multiple: int, most: int, decode: str):
    sql = f"select doc_id, count(*)::bigint payloads from (select doc_id, unnest(regexp_extract_all(text, {quoted(regex)})) x from {C}) where length(x) % {multiple} = 0 and length(x) <= {most} and regexp_matches(substring(coalesce(try(decode({decode})), ''), 1, 4096), {quoted(DECODED_)}) and len(regexp_extract_all(coalesce(try(decode({decode})), ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) * 4 <= octet_length({decode}) group by doc_id"

    def f(spark, sf_dir):
        return corpus(spark, sf_dir).select("doc_id", D.instruction_payloads("text", kind).alias("payloads")).where("payloads > 0")

    QUERIES[name], ORACLES[name] = f, sql


_decoded_query("base64_instructions", "base64", "[A-Za-z0-9+/]{20,}={0,2}", 4, 8192, "from_base64(x)")
_decoded_query("hex_instructions", "hex", "(?i)[0-9a-f]{40,}", 2, 16384, "unhex(x)")


def like_(text: str) -> str:
    """DuckDB: instruction-like text; the length of what stands before a word is its place."""
    places = ", ".join(f"case when regexp_matches({text}, {quoted(pattern(w, 'i', 're2'))}) then length(string_split_regex({text}, {quoted(pattern(w, 'i', 're2'))})[1]) end" for w in rules.INSTRUCTION_WORDS)
    return f"(length({text}) >= 40 and len(list_distinct([{places}])) >= 2)"


@query(f"select doc_id from {C} where {like_('text')}")
def instruction_like(spark, sf_dir):
    return corpus(spark, sf_dir).where(D.like_instruction("text")).select("doc_id")


PAGES_ = f"(select page_id id, html as text from pages union all select -doc_id - 1, text from {C} where file_type = 'html')"


def _html(spark, sf_dir):
    own = corpus(spark, sf_dir).where("file_type = 'html'").select((-F.col("doc_id") - 1).alias("id"), "text")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")).union(own)


@query(f"select id, count(*)::bigint comments, count(*) filter (length(trim(b)) > 10 and {like_('b')})::bigint instruction_comments from (select id, unnest(regexp_extract_all(text, '(?s)<!--(.*?)-->', 1)) b from {PAGES_}) group by id")
def html_comments(spark, sf_dir):
    b = _html(spark, sf_dir).select("id", F.explode(F.regexp_extract_all(D.upto(F.col("text"), "-->"), F.lit("(?s)<!--(.*?)-->"), F.lit(1))).alias("b"))
    return b.groupBy("id").agg(F.count("*").alias("comments"), F.count_if((F.length(F.trim("b")) > 10) & D.like_instruction(F.col("b"))).alias("instruction_comments"))


@query(f"select r.rule as rule, count(*)::bigint styles from (select unnest(regexp_extract_all(text, '(?is)<style[^>]*>(.*?)</style>', 1)) s from {PAGES_}), lateral (select unnest([{', '.join(f"{{'rule': {quoted(p)}, 'hit': regexp_matches(s, {quoted(pattern(p, 'i', 're2'))})}}" for p in rules.CSS_HIDING)}]) r) where r.hit group by 1")
def css_hiding_rules(spark, sf_dir):
    s = _html(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("(?is)<style[^>]*>(.*?)</style>"), F.lit(1))).alias("s"))
    rows = F.array(*[F.struct(F.lit(p).alias("rule"), F.col("s").rlike(pattern(p)).alias("hit")) for p in rules.CSS_HIDING])
    return s.select(F.inline(rows)).where("hit").groupBy("rule").agg(F.count("*").alias("styles"))


#: Whole matches of the markup rules, and what a match must hold besides.
SVG_WHOLE = {
    "svg-script-element": (r"<script\b[^>]*>", ""),
    "svg-event-handler": (r"\son[a-z]{1,30}\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", ""),
    "svg-javascript-href": (r"\s(?:xlink:href|href)\s*=\s*(?:\"[^\"]+\"|'[^']+'|[^\s>]+)", r"=\s*[\"']?[\x00-\x20]*javascript:"),
    "svg-foreignobject-html": (r"<foreignObject\b[^>]*>", ""),
    "svg-cdata-section": (r"<!\[CDATA\[[\x00-\x{10FFFF}]*?\]\]>", ""),
    "svg-use-external-ref": (r"<use\b[^>]*>", r"\s(?:xlink:href|href)\s*=\s*(?:\"\s*[^\"#\s][^\"]*\"|'\s*[^'#\s][^']*'|[^\s>#\"'][^\s>]*)"),
}


def svg_(rule: str) -> str:
    whole, more = SVG_WHOLE[rule]
    return f"len(list_filter(regexp_extract_all(text, {quoted(pattern(whole, 'i', 're2'))}), lambda x: regexp_matches(x, {quoted(pattern(more, 'i', 're2'))})))"


@query(f"select id, r.technique technique, r.severity severity, least(r.n, {rules.SVG_CAP})::bigint findings from {PAGES_}, lateral (select unnest([{', '.join(f"{{'technique': '{t}', 'severity': '{s}', 'n': {svg_(t)}}}" for t, _, s in rules.SVG_RULES)}]) r) where r.n > 0")
def svg_rules(spark, sf_dir):
    def count(rule):
        whole, more = SVG_WHOLE[rule]
        text = D.upto(F.col("text"), markup.ENDS[rule]) if rule in markup.ENDS else F.col("text")  # what is never closed is not tried
        return F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern(whole)), F.lit(0)), lambda x: x.rlike(pattern(more)))).cast("long")

    rows = F.array(*[F.struct(F.lit(t).alias("technique"), F.lit(s).alias("severity"), F.least(count(t), F.lit(rules.SVG_CAP).cast("long")).alias("findings")) for t, _, s in rules.SVG_RULES])
    return _html(spark, sf_dir).select("id", F.inline(rows)).where("findings > 0")


KEYS_ = "list_transform(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: lower(string_split(p, '=')[1]))"


@query(f"select doc_id, u url, len(list_filter(k, lambda x: x in ({', '.join(map(quoted, rules.STRONG_KEYS))})))::bigint strong, len(list_filter(k, lambda x: x in ({', '.join(map(quoted, rules.WEAK_KEYS))})))::bigint weak from (select doc_id, u, {KEYS_} k from (select doc_id, unnest(regexp_extract_all(text, {quoted(r'!\[[^\]]*\]\(\s*([^)\s]+)')}, 1)) u from {C}))")
def image_exfil_urls(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.inline(D.image_links("text")))


NUMBER_ = r"^(?:[+-]?[0-9]+(?:\.[0-9]+)?|[+-]?[0-9]*\.[0-9]+|\+[0-9]{1,3}[0-9 \-()]{5,})$"
BODY_ = "regexp_replace(l, '\\x0d$', '')"
CELL_ = f"case when {BODY_}[1] = '[' and strpos({BODY_}, '] ') > 1 then substring({BODY_}, strpos({BODY_}, '] ') + 2) else {BODY_} end"
LINE_ = f"regexp_replace(regexp_replace(regexp_replace({CELL_}, '^[ \\x{{A0}}]+', ''), '^[\\x{{FF1D}}\\x{{FE66}}\\x{{2E40}}]', '='), '(?i)^(=?)(?:_xlfn\\.(?:_xlws\\.)?){{1,16}}', '\\1')"
KIND_ = f"case when f = '' or not (f[1] in ('=', '+', '-', '@', chr(9), chr(13))) then null {' '.join(f'when regexp_matches(f, {quoted(pattern(p, "i", "re2"))}) then {quoted(n)}' for n, p in rules.FORMULA_RULES)} when f[1] in (chr(9), chr(13)) then 'Formula-prefix control char' when regexp_matches(f, {quoted(NUMBER_)}) then null else 'Formula prefix' end"
CELLS_ = f"(select doc_id, line_no, l, {KIND_} kind, {CELL_} cell from (select doc_id, line_no, l, {LINE_} f from (select doc_id, unnest(range(0, len(ls)))::int line_no, unnest(ls) l from (select doc_id, string_split(text, chr(10)) ls from {C} where file_type = 'csv'))))"


@query(f"select doc_id, line_no, kind from {CELLS_} where kind is not null")
def formula_cells(spark, sf_dir):
    lines = corpus(spark, sf_dir).where("file_type = 'csv'").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "l"))
    return lines.select("doc_id", "line_no", D.formula_kind(D.cell_of(F.col("l"))).alias("kind")).where("kind is not null")


@query(f"select doc_id, count(*)::bigint quote_lines from (select doc_id, unnest(string_split(text, chr(10))) l from {C}) where regexp_matches(l, '^[ \\t]*>') group by doc_id")
def context_ranges_blockquote(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("^[ \t]*>"))
    return corpus(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("quote_lines")).where("quote_lines > 0")


#: What the rules say of each payload (fixed values, taken from the rules and not from this engine's plans):
#: bucket, detector, label, severity, findings.
EXPECTED = {
    0: [("S", "phrase", "Instruction override attempt", "danger", 1), ("S", "phrase", "Prompt extraction attempt", "danger", 1)],
    1: [("S", "phrase", "Role reassignment attempt", "danger", 2), ("S", "phrase", "System prompt injection", "danger", 1), ("S", "phrase", "Jailbreak keyword", "danger", 1)],
    2: [("S", "phrase", "Instruction bypass attempt", "danger", 1), ("S", "phrase", "ChatML role injection", "danger", 1), ("S", "phrase", "ChatML role token", "warning", 2), ("S", "phrase", "Llama instruction token", "warning", 2)],
    3: [("S", "phrase", "Override attempt", "danger", 1), ("S", "phrase", "Conversation turn marker", "warning", 4), ("S", "phrase", "Markdown heading impersonation", "warning", 1)],
    4: [("I", "known-invisible", "Zero-Width Space", "warning", 2), ("I", "known-invisible", "Zero-Width Joiner", "warning", 1), ("I", "known-invisible", "Zero-Width No-Break Space (BOM)", "warning", 1), ("S", "shadow", "Instruction override attempt", "danger", 1)],
    5: [("I", "tags", 'Unicode Tag (ASCII: "A")', "danger", 1), ("I", "tags", 'Unicode Tag (ASCII: "B")', "danger", 1), ("I", "tags", 'Unicode Tag (ASCII: "C")', "danger", 1), ("S", "shadow", "Jailbreak keyword", "danger", 1)],
    6: [("I", "bidi-control", "Right-to-Left Override (RLO)", "danger", 1), ("I", "bidi-control", "Pop Directional Formatting (PDF)", "danger", 1), ("I", "bidi-control", "Left-to-Right Isolate (LRI)", "danger", 1), ("I", "bidi-control", "Pop Directional Isolate (PDI)", "danger", 1)],
    7: [("I", "bidi-control", "Left-to-Right Override (LRO)", "danger", 1)],
    8: [("H", "homoglyph", "homoglyphs", "warning", 4)],
    9: [("I", "combining-stack", "combiningStack", "warning", 1)],
    10: [("H", "math-alphanumeric", "mathAlphanumeric", "danger", 4), ("H", "math-alphanumeric", "mathAlphanumeric", "info", 1), ("H", "math-alphanumeric", "mathAlphanumeric", "warning", 2)],
    11: [("C", "control", "BEL", "warning", 1), ("C", "control", "ESC", "warning", 1), ("C", "control", "DEL", "warning", 1)],
    12: [("I", "private-use", "Private Use Area", "warning", 3)],
    13: [("I", "variation-selectors", "variationSelector", "danger", 1), ("I", "variation-selectors", "variationSelector", "warning", 2)],
    14: [("S", "encoded", "encoded-base64-instruction", "danger", 1)],
    15: [("S", "encoded", "encoded-hex-instruction", "danger", 1)],
    16: [("M", "image-exfil", "Markdown image exfiltration (strong key)", "danger", 1)],
    17: [("M", "hidden-element", "display: none", "danger", 1), ("M", "html-comment", "HTML comment with instruction", "warning", 1)],
    18: [("M", "css-rule", r"CSS rule: display\s*:\s*none", "warning", 1), ("M", "css-rule", r"CSS rule: font-size\s*:\s*0", "warning", 1), ("S", "svg", "svg-script-element", "danger", 1), ("S", "svg", "svg-event-handler", "danger", 1)],
    19: [("S", "formula", "DDE Excel command", "danger", 1), ("S", "formula", "Excel network exfil function", "danger", 1), ("S", "formula", "Formula prefix", "warning", 1)],
    20: [("S", "phrase", "Instruction override attempt", "warning", 1)],
    21: [("S", "phrase", "Authority impersonation", "danger", 1), ("S", "phrase", "Fake system message boundary", "danger", 1), ("S", "phrase", "Template injection pattern", "danger", 1), ("S", "phrase", "Code execution pattern", "danger", 1), ("S", "phrase", "SQL injection pattern", "danger", 1)],
    22: [("S", "formula", "DDE Excel command", "danger", 1), ("S", "formula", "Excel network exfil function", "danger", 1), ("S", "formula", "Formula-prefix control char", "warning", 1)],
    23: [("S", "phrase", "Role reassignment attempt", "danger", 1), ("S", "structured-text", "frontmatter-prompt-injection", "danger", 2), ("S", "structured-text", "yaml-dangerous-tag", "danger", 1)],
    24: [("S", "phrase", "Instruction override attempt", "danger", 1), ("S", "structured-text", "toml-instruction-key", "danger", 1), ("S", "structured-text", "frontmatter-prompt-injection", "danger", 1)],
    25: [("S", "phrase", "Instruction override attempt", "danger", 1), ("S", "structured-text", "jsonld-description-injection", "danger", 1), ("S", "svg", "svg-script-element", "danger", 1)],
    26: [("S", "encoded", "encoded-html-entity-instruction", "danger", 1)],
    27: [("S", "encoded", "punycode-host-homograph", "danger", 1)],
    28: [("M", "image-exfil", "md-exfil-allowlist-suppressed", "info", 1), ("M", "image-exfil", "Markdown image exfiltration (public IP host)", "warning", 1), ("M", "image-exfil", "Markdown image exfiltration (private IP host)", "warning", 1), ("M", "image-exfil", "md-exfil-allowlist-downgraded", "warning", 1), ("M", "image-exfil", "Markdown image exfiltration (strong key)", "danger", 3)],
    29: [("M", "hidden-element", "hidden attribute", "danger", 1), ("M", "hidden-element", "White text on white background", "danger", 1), ("M", "hidden-element", "Same fg/bg color (#fff)", "danger", 1), ("M", "hidden-element", "Microscopic font-size", "danger", 1), ("M", "hidden-element", "Off-screen positioning", "danger", 1), ("M", "hidden-element", "opacity: 0", "danger", 1), ("M", "hidden-element", "Same fg/bg color (red)", "danger", 1)],
    30: [("I", "known-invisible", "Zero-Width Space", "danger", 1), ("I", "variation-selectors", "url-query-variation-selector", "danger", 1)],
    31: [("S", "phrase", "Privilege escalation attempt", "warning", 1), ("S", "phrase", "Jailbreak keyword", "warning", 1)],
    32: [("S", "svg", "svg-javascript-href", "danger", 1), ("S", "svg", "svg-foreignobject-html", "warning", 1), ("S", "svg", "svg-cdata-section", "warning", 1), ("S", "svg", "svg-use-external-ref", "warning", 1)],
    33: [("S", "encoded", "multi-layer-encoded-payload", "danger", 1)],
    34: [("I", "known-invisible", "Soft Hyphen", "warning", 1), ("S", "shadow", "Jailbreak keyword", "danger", 1)],
}
KEYS_OF = dict(zip("ICMSH", scan.COUNTS, strict=True))
E_ = "(values " + ", ".join(f"({k}, '{b}', {quoted(d)}, {quoted(label)}, '{severity}', {n})" for k, rows in EXPECTED.items() for b, d, label, severity, n in rows) + ") e(payload, bucket, detector, label, severity, n)"
#: Counts by payload, by the rules: five buckets, danger (of all but control characters) and warning.
BY_PAYLOAD_ = f"(select payload, {', '.join(f"coalesce(sum(n) filter (bucket = '{b}'), 0)::bigint {name}" for b, name in KEYS_OF.items())}, coalesce(sum(n) filter (severity = 'danger'), 0)::bigint danger_count, coalesce(sum(n) filter (severity = 'warning'), 0)::bigint warning_count from {E_} group by payload)"
SUMMARY_ = f"""select *, case when danger_count > 0 then 'danger' when warning_count > 0 then 'warning' else 'safe' end status from
 (select doc_id, source, lang, file_type, {', '.join(f'coalesce({c}, 0)::bigint {c}' for c in [*scan.COUNTS, 'danger_count', 'warning_count'])} from {C} c left join {BY_PAYLOAD_} p on c.payload_id = p.payload)"""
SUMMARY_COLUMNS = ["doc_id", "source", "lang", "file_type", *scan.COUNTS, "danger_count", "warning_count", "status"]


@query(SUMMARY_)
def summary_by_category(spark, sf_dir):
    """Counts by bucket and severity and the status of every document, from all detectors."""
    return scan.summary(spark, corpus(spark, sf_dir)).select(*SUMMARY_COLUMNS)


@query(f"select detector, label, severity, sum(n * docs)::bigint findings, sum(docs)::bigint docs from {E_} join (select payload_id, count(*) docs from {C} group by 1) c on payload = payload_id group by all")
def finding_labels(spark, sf_dir):
    """Findings and documents by detector, label and severity after the rules of context."""
    found = scan.scan(spark, corpus(spark, sf_dir))
    return found.groupBy("detector", "label", "severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("docs"))


@query(f"select status, file_type, count(*)::bigint docs, sum(danger_count)::bigint danger, sum(warning_count)::bigint warning from ({SUMMARY_}) group by cube (status, file_type)")
def batch_rollup(spark, sf_dir):
    s = scan.summary(spark, corpus(spark, sf_dir))
    return s.cube("status", "file_type").agg(F.count("*").alias("docs"), F.sum("danger_count").alias("danger"), F.sum("warning_count").alias("warning"))


@query(f"select l.quality::int quality, l.toxic::int toxic, s.status status, count(*)::bigint docs from ({SUMMARY_}) s join labels l using (doc_id) group by all")
def labels_join(spark, sf_dir):
    s = scan.summary(spark, corpus(spark, sf_dir)).select("doc_id", "status")
    return s.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), "status").agg(F.count("*").alias("docs"))


TURNS_ = "(select conv_id, string_agg(case role when 'user' then 'Human: ' else 'Assistant: ' end || text, chr(10) order by turn, text) as text from conversations group by conv_id)"


@query(f"select conv_id, {rule_(36)}::bigint human, {rule_(37)}::bigint assistant, ({rule_(36)} + {rule_(37)} >= 3) banner from {TURNS_}")
def transcript_noise(spark, sf_dir):
    said = F.concat(F.when(F.col("role") == "user", "Human: ").otherwise("Assistant: "), "text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", said.alias("said")))), lambda x: x["said"]), "\n").alias("text"))
    hits = D.phrase_hits("text")
    return turns.select("conv_id", hits[36].alias("human"), hits[37].alias("assistant")).withColumn("banner", F.col("human") + F.col("assistant") >= 3)


@query()
def sanitize_strip(spark, sf_dir):
    """Strip mode over every document, as digest and counts of what it removed."""
    return sanitize.sanitized(spark, corpus(spark, sf_dir), "strip").withColumn("cleaned", F.sha2("cleaned", 256)).withColumnRenamed("cleaned", "cleaned_sha256").drop("ranges")


@query(f"select doc_id, sha256(string_agg(case when kind is null then l else substring(l, 1, length({BODY_}) - length(cell)) || chr(39) || substring(l, length({BODY_}) - length(cell) + 1) end, chr(10) order by line_no)) cleaned_sha256 from {CELLS_} group by doc_id")
def sanitize_formula(spark, sf_dir):
    return corpus(spark, sf_dir).where("file_type = 'csv'").select("doc_id", F.sha2(D.neutral_formula("text"), 256).alias("cleaned_sha256"))


NAMES = ["a/b.txt", "../x", "/abs/y", "C:\\w.exe", "ok\\..\\z.js", "plain.docx", "d/run.ps1", "x..y/z"]
SIZES = [(10, 100), (1, 100), (1, 1000), (0, 5), (0, 0), (7, 699)]


@query("select name, case when regexp_matches(name, '^[A-Za-z]:') then 'drive' when regexp_matches(name, '^[/\\\\]') then 'absolute' when list_contains(string_split(replace(name, chr(92), '/'), '/'), '..') then 'dotdot' end kind from (values " + ", ".join(f"({quoted(n)})" for n in NAMES) + ") v(name)")
def zip_slip_names(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", D.zip_slip("name").alias("kind"))


@query("select a, b, case when (a > 0 and b / a >= 1000) or (a = 0 and b > 0) then 'bomb' when a > 0 and b / a >= 100 then 'elevated' else 'safe' end kind from (values " + ", ".join(f"({a}::bigint, {b}::bigint)" for a, b in SIZES) + ") v(a, b)")
def bomb_ratio(spark, sf_dir):
    return spark.createDataFrame(SIZES, "a long, b long").select("a", "b", D.bomb_class(F.col("a"), F.col("b")).alias("kind"))


@query()
def findings(spark, sf_dir):
    """All text findings with positions, context flags and priorities."""
    return scan.scan(spark, corpus(spark, sf_dir))


@query()
def top_findings(spark, sf_dir):
    return scan.top_findings(scan.scan(spark, corpus(spark, sf_dir)))


@query(f"select {', '.join(f'sum({rule_(k)})::bigint r{k}' for k in range(len(rules.PHRASE_RULES)))} from {C}".replace("select", "with t as (select", 1) + ") select sum(x)::bigint hits from (select unnest([" + ", ".join(f"r{k}" for k in range(len(rules.PHRASE_RULES))) + "]) x from t)")
def findings_match_counts(spark, sf_dir):
    """Direct phrase findings of the positional path; must equal the native counts."""
    return spans.findings(spark, corpus(spark, sf_dir)).where("detector = 'phrase'").agg(F.count("*").alias("hits"))


@query(f"select doc_id, 'Jailbreak keyword' as name, 'danger' severity, 'nfkcNormalized' shadow, 9::bigint match_len from {C} where payload_id = 34")
def shadow_nfkc(spark, sf_dir):
    """Phrases that only the normalised text shows, with the length that they have in the given one."""
    return spans.findings(spark, corpus(spark, sf_dir)).where("shadow like '%nfkcNormalized%'").select("doc_id", "name", "severity", "shadow", F.col("match_len").cast("long").alias("match_len"))


@query(f"select detector, severity, in_code, in_quote, in_url_query, sum(n * docs)::bigint findings from (values (20, 'phrase', 'warning', false, true, false, 1), (30, 'known-invisible', 'danger', false, false, true, 1), (30, 'variation-selectors', 'danger', false, false, true, 1), (31, 'phrase', 'warning', true, false, false, 2)) v(payload, detector, severity, in_code, in_quote, in_url_query, n) join (select payload_id, count(*) docs from {C} group by 1) c on payload = payload_id group by all")
def context_demotion(spark, sf_dir):
    """Findings in code, quotes and queries, with the severity they have there."""
    found = spans.findings(spark, corpus(spark, sf_dir)).where("in_code or in_quote or in_url_query")
    return found.groupBy("detector", "severity", "in_code", "in_quote", "in_url_query").agg(F.count("*").alias("findings"))


@query()
def sanitize_full(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.sanitize("text", F.col("file_type")).alias("cleaned"))
