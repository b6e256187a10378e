"""Native places, contexts, elements and pieces against the positional path in Python and against SQL on random texts."""

import random
from collections import Counter

import duckdb
import pytest

from quillward.operators import elements, places, spans
from quillward.plans import catalog_places, scan
from quillward.session import ready
from quillward.streaming import stream

DOCS = "doc_id long, text string, file_type string"
BITS = ["ignore previous instructions", " ", "\n", "```", "~~~", "`", "\n```\n", "\n~~~ x\n", "<pre>", "</pre>", "<code class=a>", "</CODE>", "\n> ", "> q", "https://a.test/?k=", "?", "jailbreak", "jail​break", "ja\xadil\U000e0041break", "ｊailbreak", "\U0001f600", "<system>", "<Ｓystem>", "​", "ﬁ", "{{ ﬁ system \U0001f600}}", "\xbd", "[INST]", "act as a", "Human: ", "\t```\n", "   ~~~~\nx", "①", "‪", "‮"]


@pytest.fixture(scope="module")
def soup(spark):
    pick = random.Random(3)
    rows = [(i % 700, "".join(pick.choice(BITS) for _ in range(pick.randint(1, 30))), "text") for i in range(800)]  # ids repeat
    rows += [(900, None, "text"), (901, "", "text"), (None, "jailbreak", "text")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(4)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_hits_and_contexts_equal_the_positional_path(spark, soup):
    ready(spark)
    columns = ["doc_id", "name", "position", "match_len", "shadow", "text_len", "in_code", "in_quote", "in_url_query"]
    found = spans.findings(spark, soup[1], ["suspiciousPatterns"]).where("detector in ('phrase', 'shadow')")
    want = bag(found.select(columns).collect())
    assert sum(want.values()) > 3000
    assert bag(places.phrase_places(soup[1]).select(columns).collect()) == want


def test_ranges_equal_the_positional_path(soup):
    want = []
    for doc, text, _ in soup[0]:
        units = spans.Units(text or "")
        for kind, ranges in (("code", spans.code_ranges(text or "")), ("quote", [m.span() for m in spans.QUOTE.finditer(text or "")]), ("query", spans.query_ranges(text or ""))):
            want += [(doc, kind, units(a), units(b)) for a, b in ranges if b > a]
    got = [(r.doc_id, "code" if r.kind in ("fence", "inline") else r.kind, r.start, r.end) for r in places.context_ranges(soup[1]).collect()]
    assert bag(got) == bag(want)


def test_places_without_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert places.phrase_places(none).count() == 0 and places.context_ranges(none).count() == 0 and stream.chunked(none).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(64, 40), (1000, 100)])
def test_pieces_equal_the_whole(spark, soup, size, overlap):
    """Hits of up to overlap characters are found in pieces of any size; direction controls have other chunks here."""
    own = ["doc_id", "name", "severity", "position", "match_len"]
    whole = places.phrase_places(soup[1], contexts=False).where("shadow is null").select(own)
    assert bag(stream.chunked(soup[1], size, overlap).where("detector = 'phrase'").select(own).collect()) == bag(whole.collect())


def test_pieces_of_one_long_text(spark):
    """A text of 8 MB is read by many tasks, with the same hits as the whole."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text]
    long = (" \U0001f600 jailbreak [INST] ‪ ".join(texts) * 4)[: 8 << 20]
    docs = spark.createDataFrame([(1, long, "text")], DOCS)
    own = ["name", "severity", "position", "match_len"]
    parts = stream.pieces(docs)
    assert parts.rdd.getNumPartitions() > 4 and parts.count() == -(-len(long) // spans.CHUNK)
    found = stream.chunked(docs)
    assert bag(found.where("detector = 'phrase'").select(own).collect()) == bag(places.phrase_places(docs, contexts=False).where("shadow is null").select(own).collect())
    assert found.where("detector = 'bidi-control'").count() == long.count("‪")


def brute_top(rows, per=2, total=5):
    out = []
    for doc in {r.doc_id for r in rows}:
        mine = [r for r in rows if r.doc_id == doc and r.severity in ("danger", "warning")]
        names = Counter(r.name for r in mine)
        mine = [r for r in mine if not (r.name in scan.rules.NOISE and names[r.name] < scan.rules.TRANSCRIPT_LEAST)]
        mine.sort(key=lambda r: (-r.priority, r.display, r.idx))
        seen, n = Counter(), 0
        for r in mine:
            seen[r.display] += 1
            if seen[r.display] <= per and n < total:
                n += 1
                out.append((doc, r.display, r.priority, r.idx, n))
    return bag(out)


def test_top_list_by_brute_force_and_plan(spark, soup):
    docs = soup[1].dropDuplicates(["doc_id"])
    found = scan.scan(ready(spark), docs)
    top = scan.top_findings(found)
    assert bag(top.select("doc_id", "display", "priority", "idx", "rank").collect()) == brute_top(found.collect())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3 and "Partial" in plan  # ranks are bounded before rows are shuffled


TAGS = ["<div>", "</div>", '<div style="display:none">', "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<b hidden>", "</b>", "<br>", "text", " ", "a\U0001f600&nbsp;b", "<!-- <b> -->", "<script>x<p></script>", "<td>", "<tr>", "</tr>", "<table>", "</table>", "<i style='color:red;background:red'>", "</i>", "<hr>", "<!--", "<p", "<style>"]


def test_elements_equal_sql_on_any_tags(spark):
    pick = random.Random(5)
    rows = [(i, "".join(pick.choice(TAGS[:25] if i % 9 else TAGS) for _ in range(pick.randint(0, 30)))) for i in range(250)] + [(251, None), (252, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    columns = ["id", "k", "name", "depth", "text_len"]
    got = bag(elements.elements(pages).select(columns).collect())
    con = duckdb.connect()
    con.register("soup", pages.toPandas())
    sql = catalog_places.elements_sql("select row_number() over () as rid, page_id as id, html from soup where html is not null")
    assert got == bag(con.sql(f"with {sql} select id, (k - 1)::int, name, depth, text_len from elements").fetchall())


def test_elements_of_nested_tags_hold_their_text(spark):
    """Well nested elements: by a stack."""
    pick = random.Random(6)
    out, want = [], []
    for page in range(40):
        html, stack, sizes, k = "", [], 0, 0
        for _ in range(60):
            step = pick.random()
            if step < 0.4:
                name = pick.choice(["div", "em", "section", "b"])
                html, k = f"{html}<{name}>", k + 1
                stack.append((name, k - 1, sizes, len(stack) + 1))
            elif step < 0.7 and stack:
                name, at, before, depth = stack.pop()
                html, k = f"{html}</{name}>", k + 1
                want.append((page, at, name, depth, sizes - before))
            else:
                html, sizes = html + " word", sizes + 4
        while stack:
            name, at, before, depth = stack.pop()
            html += f"</{name}>"
            want.append((page, at, name, depth, sizes - before))
        out.append((page, html))
    got = elements.elements(spark.createDataFrame(out, "page_id long, html string")).select("id", "k", "name", "depth", "text_len").collect()
    assert bag(got) == bag(want)


def test_hidden_elements_count_below_every_ancestor(spark):
    html = '<div style="display:none">a<p hidden>bc</p></div><i style="opacity:0"></i><u hidden>d<b>e</b>'
    rows = elements.hidden(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert sorted((r.element, r.technique, r.text_len) for r in rows) == [("div", "display: none", 3), ("p", "hidden attribute", 2), ("u", "hidden attribute", 2)]
