import pytest

from quillward.functions import rules
from quillward.operators import detectors as D
from quillward.operators import spans
from quillward.plans import catalog, catalog_files, catalog_places, scan  # noqa: F401
from quillward.session import ready

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(same, name):
    same(lambda s, d: catalog.QUERIES[name](ready(s), d), catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["findings", "top_findings"])
def test_findings_of_every_payload(spark, name):
    """Findings by detector and severity as the rules say; natural texts have none."""
    docs = {r.doc_id: r.payload_id for r in catalog.corpus(ready(spark), DATA).select("doc_id", "payload_id").collect()}
    found = catalog.QUERIES[name](spark, DATA).collect()
    assert {docs[r.doc_id] for r in found} <= set(catalog.EXPECTED)
    if name == "findings":
        for doc, payload in docs.items():
            want = sorted((d, label, s) for _, d, label, s, n in catalog.EXPECTED.get(payload, ()) for _ in range(n))
            assert sorted((r.detector, r.label, r.severity) for r in found if r.doc_id == doc) == want
    else:
        for doc, payload in docs.items():
            mine = [r for r in found if r.doc_id == doc]
            assert len(mine) <= 5 and all(r.severity in ("danger", "warning") for r in mine)
            assert bool(mine) == any(s in ("danger", "warning") for _, _, _, s, _ in catalog.EXPECTED.get(payload, ()))


def rows(text, file_type="text"):
    return [(b, x) for b, found in spans.findings_of(text, file_type).items() for x in found]


def test_positions_are_utf16():
    found = rows("\U0001f600 a\u200bb")
    assert [(b, x["at"]) for b, x in found] == [("invisibleUnicode", 3)]
    assert spans.Units("\U0001f600 a\u200bb")(3) == 4
    assert spans.rows_of(1, "\U0001f600 a\u200bb", "text")[0][1 + list(spans.FIELDS).index("position")] == 4


def test_shadow_hits_only_where_no_direct_hit_explains_them():
    found = [x for b, x in rows("ig\u200bnore previous instructions") if b == "suspiciousPatterns"]
    assert [(x["detector"], x["shadow"]) for x in found] == [("shadow", "invisibleStripped")]
    assert [x["detector"] for b, x in rows("ignore previous instructions\u200b") if b == "suspiciousPatterns"] == ["phrase"]
    both = [x for b, x in rows("\uff49g\u200bnore previous instructions, \uff4aailbreak") if b == "suspiciousPatterns"]
    assert [(x["name"], x["shadow"]) for x in both] == [("Jailbreak keyword", "nfkcNormalized")]
    two = [x for b, x in rows("[\uff49nst] jail\u00adbreak [INST] x") if b == "suspiciousPatterns" and x["detector"] == "shadow"]
    assert [(x["name"], x["shadow"]) for x in two] == [("Jailbreak keyword", "invisibleStripped")]


def test_code_demotes_and_turn_markers_do_not():
    found = {x["name"]: x["severity"] for _, x in rows("```\njailbreak\nHuman: x\n```\n")}
    assert found == {"Jailbreak keyword": "warning", "Conversation turn marker": "warning"}


def test_invisible_characters_in_queries_are_danger():
    found = [x for _, x in rows("`https://a.test/?key=v\u200bx`")]
    assert [(x["severity"], x["technique"], x["meta"]) for x in found] == [("danger", "url-query-invisible-unicode", {"host": "a.test", "queryKey": "key#3", "codepoint": "U+200B"})]


def test_bidi_overuse_is_danger():
    assert {x["severity"] for _, x in rows("a\u202ab\u202cc")} == {"warning"}
    assert {x["severity"] for _, x in rows("a\u202ab\u202cc\u2066")} == {"danger"}


def test_contexts_do_not_cut_characters():
    text = "x" * 30 + "e\u0301" * 20 + "\u200b" + "\U0001f600" * 20
    shown = spans.around(spans.Units(text).units, 70, 1)
    assert "\ufffd" not in shown and shown.startswith("...") and "\u2997\u200b\u2998" in shown


def test_selectors_and_stacks():
    kinds = lambda t: [(x["severity"], x["detector"]) for _, x in rows(t)]
    assert kinds("\u2600\ufe0f") == [("info", "variation-selectors")] and kinds("\u4e00\U000e0100") == [("info", "variation-selectors")]
    assert kinds("\ufe0f") == [("danger", "variation-selectors")] and kinds("a\U000e0100") == [("danger", "variation-selectors")]
    assert kinds("a" + "\u0301" * 7) == [] and kinds("a" + "\u0301" * 15) == [("danger", "combining-stack")]
    assert kinds("\u0645" + "\u0301" * 11) == [] and kinds("\u0645" + "\u0301" * 12) == [("warning", "combining-stack")]


def test_repeated_and_null_ids_keep_their_findings(spark):
    docs = spark.createDataFrame([(1, "jailbreak"), (1, "jailbreak"), (None, "jailbreak"), (4, None), (5, "")], "doc_id long, text string")
    found = scan.scan(ready(spark), docs).collect()
    assert sorted((r.doc_id or 0) for r in found) == [0, 1, 1]
    assert {(r.priority, r.reason, r.label) for r in found} == {(89, "danger-pattern", "Jailbreak keyword")}


def test_categories_verbosity_and_compact_form(spark):
    docs = spark.createDataFrame([(1, "jailbreak \x07 a\u200b")], "doc_id long, text string")
    found = scan.scan(ready(spark), docs, ["controlChars"], "detailed").collect()
    assert [(r.detector, r.name) for r in found] == [("control", "BEL")] and "\u2997" in found[0].context_wide
    row = scan.compact(scan.scan(spark, docs)).first()
    assert (row.total, row.max_severity, row.categories) == (3, "danger", {"controlChars": 1, "invisibleUnicode": 1, "suspiciousPatterns": 1})
    kinds = scan.sniffed(spark.createDataFrame([(1, "a <b>"), (2, "a < b")], "doc_id long, text string")).collect()
    assert [r.file_type for r in kinds] == ["html", "text"]


def test_summary_counts_long_texts_in_chunks(spark):
    from quillward.streaming.stream import chunks

    docs = spark.createDataFrame([(1, "s", "en", "text", "a\u202ab" + "x" * (6 << 20) + "\u202a\u202c"), (2, "s", "en", None, "plain")], "doc_id long, source string, lang string, file_type string, text string")
    out = {r.doc_id: r for r in scan.summary(ready(spark), docs).collect()}
    assert (out[1].streamed, out[1].chunk_count, out[1].bidi_total, out[1].bidi_danger) == (True, 7, 3, 0)
    assert (out[2].streamed, out[2].status) == (False, "safe")
    assert [(r.doc_id, r.chunk) for r in chunks(docs).select("doc_id", "chunk").collect()] == [(1, k) for k in range(7)] + [(2, 0)]


def test_live_windows_close(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillward.streaming.stream import status_windows

    rows = [(1, "jailbreak", "2026-01-01 00:01:00"), (2, "plain", "2026-01-01 00:02:00"), (3, "plain", "2026-01-01 09:00:00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").select("doc_id", F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit("text").alias("file_type"), "text", F.col("at").cast("timestamp").alias("at"))
    for k in range(3):
        docs.where(F.col("doc_id") == k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = status_windows(ready(spark), live, "at").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.status, r.n_docs) for r in spark.table("windows").collect()) == [("danger", 1), ("safe", 1)]


def test_top_findings_caps(spark):
    docs = spark.createDataFrame([(1, "jailbreak " * 9 + "‮" + "​" * 4)], "doc_id long, text string")
    top = scan.top_findings(scan.scan(ready(spark), docs)).collect()
    assert len(top) == 5 and max(sum(t["display"] == d for t in top) for d in {t["display"] for t in top}) == 2


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert scan.scan(ready(spark), docs).count() == 0
    assert docs.select(D.phrases_of("text", "danger").alias("n")).where("n <> 0").count() == 0


def test_rule_table_sizes():
    assert len(rules.PHRASE_RULES) == 43 and len(rules.HOMOGLYPHS) == len(rules.LATIN) == 37
