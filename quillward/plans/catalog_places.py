"""Queries on places: rule hits with positions, their shadows, and the ranges that they stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import CLASSES, pattern
from quillward.operators import elements, encoded, places, spans
from quillward.plans import scan
from quillward.plans.catalog import C, query
from quillward.sources.corpus import corpus, quoted, table
from quillward.streaming import stream


def starts_(gaps: str, hits: str) -> str:
    """DuckDB: the places from 0 of matches, from the gaps between them."""
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)::bigint"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {size(f'{gaps}[1:i]')} + {size(f'{hits}[1:i - 1]')})"


def units_(text: str, at: str) -> str:
    """DuckDB: a place in code points as one in UTF-16 units."""
    return f"({at} + len(regexp_extract_all(substr({text}, 1, {at}::bigint), '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def matches_(regex: str, text: str = "text") -> str:
    return f"{{'g': string_split_regex({text}, {quoted(regex)}), 'h': regexp_extract_all({text}, {quoted(regex)})}}"


def hits_sql() -> str:
    """Common tables up to `kept`: hits of all phrase rules in the texts and their shadows, explained ones left out."""
    strip = f"[{CLASSES['stripped']}]"
    changed, to = places.folding()
    fold = "map {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in to.items()) + "}"
    each = ", ".join(f"{{'name': {quoted(n)}, 'severity': {quoted(s)}, 'm': case when regexp_matches(text, {quoted(pattern(p, f, 're2'))}) then {matches_(pattern(p, f, 're2'))} end}}" for n, p, f, s in rules.PHRASE_RULES)
    shown = "length(replace(replace(replace(replace(replace(hit, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'))"
    return f"""
docs as (select row_number() over () as rid, doc_id, text from {C} where text is not null),
split as (select *, string_split(text, '') as chars from docs where regexp_matches(text, '[{changed}]')),
folded as (select rid, doc_id, text as source, list_transform(chars, lambda c: coalesce(fold[c], c)) as parts from split, (select {fold} as fold)),
forms as (
  select rid, doc_id, text as source, 'direct' as shadow, text, null::bigint[] as origin from docs
  union all select rid, doc_id, text, '{places.STRIPPED}', regexp_replace(text, '{strip}+', '', 'g'), list_filter(range(1, length(text) + 1), lambda i: not regexp_matches(text[i], '^{strip}$')) from docs where regexp_matches(text, '{strip}')
  union all select rid, doc_id, source, '{places.FOLDED}', array_to_string(parts, ''), flatten(list_transform(range(1, len(parts) + 1), lambda i: list_transform(range(0, length(parts[i])), lambda z: i))) from folded),
found as (select rid, doc_id, source, shadow, origin, r.name as name, r.severity as severity, r.m.h as hits, {starts_("r.m.g", "r.m.h")} as begins from forms, lateral (select unnest([{each}]) as r) where len(r.m.h) > 0),
ones as (select * exclude (hits, begins), unnest(hits) as hit, unnest(begins) as s from found),
hits as (select *, case when origin is null then s else origin[s + 1] - 1 end as a, case when origin is null then s + length(hit) else origin[s + length(hit)] end as b, {shown} as shown from ones),
direct as (select * from hits where shadow = 'direct'),
kept as (
  select rid, doc_id, source, name, severity, a, b, null::varchar as shadow from direct
  union all select rid, doc_id, source, name, min(severity), a, b, string_agg(distinct shadow, '+' order by shadow) from hits h where shadow != 'direct' and not exists (from direct d where d.rid = h.rid and d.name = h.name and d.a = h.a and d.shown = h.b - h.a) group by rid, doc_id, source, name, a, b)"""


def ranges_sql(docs: str = "docs") -> str:
    """Common tables up to `ranges`(rid, kind, a, b) in code points, from docs(rid, text): fences and elements are
    paired one after the other."""
    def rows(name: str, regex: str, some: str, more: str = "") -> str:
        return f"{name}_m as (select rid, length(text) as n, {matches_(regex)} as m{more} from {docs} where {some}), {name} as (select * exclude (m, s), s as a, s + length(hit) as b from (select * exclude (m), m, unnest(m.h) as hit, unnest({starts_('m.g', 'm.h')}) as s, unnest(range(1, len(m.h) + 1)) as i from {name}_m))"

    return f"""
{rows("fences", places.FENCE.replace("}+", "}"), "regexp_matches(text, '```|~~~')")},
marks as (select rid, i, n, ltrim(hit, chr(10) || chr(9) || ' ')[1] as mark, b as opened, a + (hit[1] = chr(10))::int as closed from fences),
fold as (
  select rid, 1::bigint as i, opened as since, mark, null::bigint as a, null::bigint as b, n from marks where i = 1
  union all select f.rid, m.i, case when f.since is null then m.opened when f.mark = m.mark then null else f.since end, case when f.since is null then m.mark else f.mark end, case when f.mark = m.mark then f.since end, m.closed, f.n from fold f join marks m on m.rid = f.rid and m.i = f.i + 1),
fenced as (select rid, a, b from fold where a is not null union all select rid, since, n from (select *, row_number() over (partition by rid order by i desc) as last from fold) where last = 1 and since is not null),
{rows("inlines", places.INLINE, "contains(text, '`')")},
{rows("tags", places.TAG, "regexp_matches(text, '(?i)</(?:pre|code)>')")},
kinds as (select rid, i, a, b, hit[2] = '/' as ends, regexp_extract(lower(hit), 'pre|code') as name from tags),
pairs as (select o.rid, o.i, min(c.i) as j from kinds o join kinds c on c.rid = o.rid and c.i > o.i and c.ends and c.name = o.name where not o.ends group by all),
chain as (
  select rid, min_by(i, i) as i, min_by(j, i) as j from pairs group by rid
  union all select rid, i, j from (select p.rid, p.i, p.j, row_number() over (partition by p.rid order by p.i) as first from chain c join pairs p on p.rid = c.rid and p.i > c.j) where first = 1),
{rows("quotes", "(?m)^[ \\t]*>[^\\n]*", "contains(text, '>')")},
{rows("addresses", places.ADDRESS, "contains(text, '?')")},
all_ranges as (
  select rid, 'fence' as kind, a, b from fenced
  union all select rid, 'inline', a + 1, b - 1 from inlines x where not exists (from fenced f where f.rid = x.rid and f.a <= x.a + 1 and x.a + 1 < f.b)
  union all select c.rid, 'code', o.b, e.a from chain c join kinds o on o.rid = c.rid and o.i = c.i join kinds e on e.rid = c.rid and e.i = c.j
  union all select rid, 'quote', a, b from quotes
  union all select rid, 'query', a + instr(hit, '?'), b from addresses where contains(hit, '?')),
ranges as (select * from all_ranges where a < b)"""


PLACE_ = f"{units_('source', 'a')}::int as position, ({units_('source', 'b')} - {units_('source', 'a')})::int as match_len, {units_('source', 'length(source)')}::int as text_len"


@query(f"with {hits_sql()} select doc_id, name, severity, {PLACE_}, shadow from kept")
def phrase_places(spark, sf_dir):
    """Every hit of a phrase rule with its place in UTF-16 units, and hits that only a shadow shows."""
    return places.phrase_places(corpus(spark, sf_dir), contexts=False)


def flag_(kinds: tuple[str, ...]) -> str:
    names = ", ".join(map(quoted, kinds))
    return f"exists (from ranges r where r.rid = k.rid and r.kind in ({names}) and r.a <= k.a and k.a < r.b)"


@query(f"with recursive {hits_sql()}, {ranges_sql()} select doc_id, name, severity, {PLACE_}, shadow, {', '.join(f'{flag_(kinds)} as {flag}' for flag, kinds in places.FLAGS.items())} from kept k")
def phrase_contexts(spark, sf_dir):
    """The same hits with the ranges that they stand in: a join of places and ranges by inequality."""
    return places.phrase_places(corpus(spark, sf_dir))


PRIORITY_ = " ".join(f"when {quoted(k)} then {v}" for k, v in rules.BASE_PRIORITY.items())
LOWER_ = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in spans.LADDER.items())
NOISE_ = ", ".join(map(quoted, rules.NOISE))


@query(f"""with recursive {hits_sql()}, {ranges_sql()},
placed as (select doc_id, rid, name, severity as own, {PLACE_}, shadow, ({flag_(places.FLAGS['in_code'])} or {flag_(places.FLAGS['in_quote'])}) and name not in ({NOISE_}) as milder from kept k),
moved as (select * exclude (own), case when milder then case own {LOWER_} else own end else own end as severity from placed),
valued as (select *, floor(least(100.0::double, greatest(0.0::double, (case severity {PRIORITY_} else 10 end) * 1.1::double * case when text_len between 1 and 2000 then 1 + 0.15::double * greatest(0.0::double, 1 - position::double / text_len) else 1.0::double end)) + 0.5::double)::int as priority from moved where severity in ('danger', 'warning')),
loud as (select *, count(*) over (partition by rid, name) as n from valued),
one as (select *, row_number() over (partition by doc_id, name order by priority desc, position, match_len, shadow nulls first) as r from loud where name not in ({NOISE_}) or n >= {rules.TRANSCRIPT_LEAST}),
two as (select *, row_number() over (partition by doc_id order by priority desc, name, position, match_len, shadow nulls first) as rank from one where r <= 2)
select doc_id, name, severity, position, priority, rank::int as rank from two where rank <= 5""")
def top_phrases(spark, sf_dir):
    """The five foremost phrase hits of each document, at most two of a name, by priority after context."""
    return scan.top_phrases(corpus(spark, sf_dir))


#: Characters of a piece and of what it shares with the next in the chunked scan of the corpus.
PIECE, SHARED = 4096, 512
BIDI_CLASS = "".join(CLASSES[f"bidi_{k}"] for k in ("embedding", "override", "isolate"))


@query(f"""with {hits_sql()},
controls as (select rid, doc_id, text, {matches_(f"[{BIDI_CLASS}]")} as m from docs where regexp_matches(text, '[{BIDI_CLASS}]')),
control as (select rid, doc_id, text as source, unnest(m.h) as hit, unnest({starts_("m.g", "m.h")}) as a from controls),
marks as (select *, a + 1 as b, count(*) over (partition by rid, a // {PIECE}) as n from control)
select doc_id, 'phrase' as detector, name, severity, {PLACE_} from direct
union all select doc_id, 'bidi-control', null, case when n >= 3 or regexp_matches(hit, '[{CLASSES['bidi_override']}]') then 'danger' else 'warning' end, {PLACE_} from marks""".replace(f", {units_('source', 'length(source)')}::int as text_len", ""))
def chunked_hits(spark, sf_dir):
    """Phrase hits and direction controls of texts that are read in pieces; the same places as over whole texts."""
    return stream.chunked(corpus(spark, sf_dir), PIECE, SHARED)


RANGE_ = f"doc_id, kind, {units_('text', 'a')}::int as start, {units_('text', 'b')}::int as \"end\" from ranges join docs using (rid)"


@query(f"with recursive docs as (select row_number() over () as rid, doc_id, text from {C} where text is not null), {ranges_sql()} select {RANGE_}")
def context_ranges(spark, sf_dir):
    """Every range of code, quotes and address queries."""
    return places.context_ranges(corpus(spark, sf_dir))


def elements_sql(docs: str) -> str:
    """Common tables up to `elements`(rid, id, k, name, tag, depth, text_len), from docs(rid, id, html): start tags and their end
    tags by counting what stands between them."""
    names = lambda xs: ", ".join(map(quoted, xs))
    by = " or ".join(f"(s.name = '{n}' and o.name in ({names(x)}))" for n, x in elements.ENDED.items())
    blank = quoted(elements.BLANK)
    size = f"length(x) + len(regexp_extract_all(x, '[\\x{{10000}}-\\x{{10FFFF}}]')) "
    return f"""
docs as ({docs}),
cut as (select rid, id, {matches_(elements.TOKEN, "html")} as m from docs),
stream as (select rid, id, unnest(range(1, len(m.g) + 1)) as k, unnest(list_transform(m.g, lambda g: regexp_replace(g, {blank}, '', 'g'))) as x, unnest(list_append(m.h, null)) as tag from cut),
sized as (select rid, id, k, tag, sum({size}) over (partition by rid order by k) as text, lower(regexp_extract(tag, {quoted(elements.NAME)}, 1)) as name from stream),
tags as (select *, case when name = '' or name in ({names(elements.VOID)}) then 0 when tag like '</%' then -1 else 1 end as delta from sized where tag is not null),
last as (select rid, max(k) as l from sized group by rid),
matched as (select s.rid, s.k, min(e.k) as e from tags s join tags e on e.rid = s.rid and e.name = s.name and e.k > s.k and s.delta = 1 and e.delta = -1
  where (select coalesce(sum(delta), 0) from tags b where b.rid = s.rid and b.name = s.name and b.k > s.k and b.k <= e.k) = -1 group by all),
paired as (select t.*, m.e from tags t left join matched m on m.rid = t.rid and m.k = t.k where delta = 1),
marks as (select rid, k, 1 as d from matched union all select rid, e, -1 from matched),
deep as (select p.*, (select count(*) from matched m where m.rid = p.rid and m.k <= p.k and m.e > p.k) as open from paired p),
outers as (select s.rid, s.k, min(m.k) as o from deep s join marks m on m.rid = s.rid and m.k > s.k and m.d = -1 where s.e is null and s.open > 0
  and (select sum(d) from marks b where b.rid = s.rid and b.k > s.k and b.k <= m.k) = -1 group by all),
nexts as (select s.rid, s.k, min(o.k) as n from deep s join tags o on o.rid = s.rid and o.k > s.k and (o.delta = 1 or o.name = 'hr') and ({by}) group by all),
ended as (select d.*, case when name = 'p' then least(e, n, case when e is null then least(o, l) end) else coalesce(e, least(o, n, l)) end as z from deep d join last l using (rid) left join outers using (rid, k) left join nexts using (rid, k)),
elements as (select s.rid, s.id, s.k, s.name, s.tag, (s.open + (s.e is null)::int)::int as depth, (z.text - s.text)::bigint as text_len from ended s join sized z on z.rid = s.rid and z.k = s.z)"""


PAGES_ = elements_sql("select row_number() over () as rid, page_id as id, html from pages where html is not null")


@query(f"with {PAGES_} select id as page_id, name as element, count(*) as n_elements, max(depth) as max_depth, sum(text_len)::bigint as text_len from elements group by all")
def page_elements(spark, sf_dir):
    """Elements of every page by name: how many, how deep, and how much text they hold."""
    found = elements.elements(table(spark, sf_dir, "pages"))
    return found.groupBy(F.col("id").alias("page_id"), F.col("name").alias("element")).agg(F.count("*").alias("n_elements"), F.max("depth").alias("max_depth"), F.sum("text_len").alias("text_len"))


STYLE_ = f"concat(regexp_extract(tag, {quoted(elements.STYLE)}, 1), regexp_extract(tag, {quoted(elements.STYLE)}, 2), regexp_extract(tag, {quoted(elements.STYLE)}, 3))"
COLOUR_ = [f"lower(trim(regexp_extract(style, {quoted(pattern(p, 'i', 're2'))}, 1), ' '))" for p in (elements.FRONT, elements.BACK)]
HOW_ = ", ".join(f"case when regexp_matches(style, {quoted(pattern(p, 'i', 're2'))}) then {quoted(t)} end" for p, t in rules.ELEMENT_STYLES)
HOW_ += f", case when regexp_matches(regexp_replace(tag, {quoted(elements.QUOTED)}, '', 'g'), {quoted(elements.HIDDEN)}) then 'hidden attribute' end, case when {COLOUR_[0]} != '' and {COLOUR_[0]} = {COLOUR_[1]} then 'Same fg/bg color (' || {COLOUR_[0]} || ')' end"


@query(f"with {elements_sql(f'select row_number() over () as rid, doc_id as id, text as html from {C} where file_type = {quoted("html")} and text is not null union all select -row_number() over () as rid, -1 - page_id, html from pages where html is not null')}, how as (select id, name, text_len, unnest([{HOW_}]) as technique from (select *, {STYLE_} as style from elements where text_len > 0)) select id, name as element, technique, text_len from how where technique is not null")
def hidden_elements(spark, sf_dir):
    """Hidden elements with text, once for each technique, of the corpus' HTML and of all pages (as -1 - page_id)."""
    docs = corpus(spark, sf_dir).where("file_type = 'html'").select("doc_id", "text")
    return elements.hidden(docs.unionByName(table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))), "doc_id", "text")


CODE_ = f"case when starts_with(r, '&#x') then ('0x' || regexp_extract(r, {quoted(encoded.REF)}, 1))::bigint else regexp_extract(r, {quoted(encoded.REF)}, 2)::bigint end"
DECODED_ = "(?i)" + "|".join(f"(?:{pattern(p, '', 're2')})" for p in rules.DECODED_PHRASES)


@query(f"""with docs as (select row_number() over () as rid, doc_id, text, {matches_(encoded.REF)} as m from {C} where contains(text, '&#')),
spelled as (select *, list_transform(m.h, lambda r: case when length(r) > 12 or {CODE_} > 1114111 then r when {CODE_} between 55296 and 57343 then chr(65533) else chr(({CODE_})::int) end) as letters from docs),
hits as (select * from spelled where regexp_matches(substr(array_to_string(list_transform(range(1, len(m.g) + 1), lambda i: m.g[i] || coalesce(letters[i], '')), ''), 1, {encoded.SEARCHED}), {quoted(DECODED_)})),
refs as (select rid, doc_id, text, unnest(m.h) as hit, unnest({starts_('m.g', 'm.h')}) as s from hits),
marked as (select *, s + length(hit) as e, case when lag(s + length(hit)) over (partition by rid order by s) = s then 0 else 1 end as fresh from refs),
numbered as (select *, sum(fresh) over (partition by rid order by s) as run from marked),
runs as (select rid, doc_id, run, any_value(text) as text, min(s) as a, max(e) as b, count(*) as n from numbered group by all),
best as (select *, row_number() over (partition by rid order by b - a desc, a) as r, count(*) over (partition by rid) as n_islands, sum(n) over (partition by rid) as n_refs from runs)
select doc_id, {units_('text', 'a')}::int as position, (b - a)::int as match_len, n_islands, n_refs::bigint as n_refs from best where r = 1""")
def entity_payloads(spark, sf_dir):
    """Numeric references that spell an instruction, at their longest run."""
    return encoded.entity_payloads(corpus(spark, sf_dir))


def listed_() -> str:
    rows = [(h, "true", "image-only", 2) for h in rules.IMAGE_HOSTS] + [(h, "false", "image-only", 2) for h in rules.CONTENT_HOSTS] + [(h, "true", "trusted-allowlist", 1) for h in rules.TRUSTED_HOSTS]
    return "(values " + ", ".join(f"('{h}', {b}, '{t}', {r})" for h, b, t, r in rows) + ") as l(suffix, below, tier, rank)"


@query(f"""with urls as (select row_number() over () as one, doc_id, url, lower(regexp_extract(url, {quoted(encoded.HOST)}, 1)) as host from (select doc_id, unnest(regexp_extract_all(text, {quoted(r'!\[[^\]]*\]\(\s*([^)\s]+)')}, 1)) as url from {C})),
known as (select u.*, l.*, row_number() over (partition by one order by rank desc, length(suffix) desc, tier desc, suffix desc) as r from urls u left join {listed_()} on l.suffix = host or (l.below and ends_with(host, '.' || l.suffix)) where host != '')
select doc_id, url, host, case when rank = 2 then tier when regexp_matches(host, {quoted(encoded.DOTTED)}) then case when regexp_matches(host, {quoted(encoded.PRIVATE)}) then 'ip-literal-private' else 'ip-literal-public' end else coalesce(tier, 'unknown') end as tier, suffix as matched from known where r = 1""")
def image_host_tiers(spark, sf_dir):
    """Inline images with the tier of their host."""
    return encoded.image_hosts(corpus(spark, sf_dir))
