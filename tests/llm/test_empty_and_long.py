"""Empty tables, and long real texts, through the operators that had no test of these."""

import pytest

from quillward.llm import bpe_automaton, common, license_scan, media, quality, queries, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_give_no_rows(spark):
    common.ready(spark)
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    outs = [license_scan.license_scan(spark, none), secret_scan.secret_scan(none), bpe_automaton.encode_decode(spark, none, queries.vocabulary_path()), media.store_texts(spark, none), quality.classify(spark, none, labels)]
    assert [o.count() for o in outs] == [0] * 5


@pytest.fixture
def long(spark):
    """A text of a megabyte, as all small documents one after the other."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in rows if r.text]
    return texts, (" ".join(texts) * 4)[: 1 << 20]


def test_long_text_keeps_all_licenses_and_secrets(spark, long):
    """Four copies in a row hold four times what one holds."""
    texts, _ = long
    one = " ".join(texts)
    docs = spark.createDataFrame([(1, one, "en", "s", 0), (4, " ".join([one] * 4), "en", "s", 0)], DOCS)
    found = {r.doc_id: r for r in license_scan.license_scan(spark, docs).collect()}
    assert found[4].n_words == 4 * found[1].n_words and found[4].n_base == 4 * found[1].n_base > 0
    assert set(found[4].base_labels.split(",")) == set(found[1].base_labels.split(","))
    secrets = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert [secrets[4][c] for c in ("n_assign", "n_access", "n_hex")] == [4 * secrets[1][c] for c in ("n_assign", "n_access", "n_hex")]


def test_long_text_goes_through_encoders_whole(spark, long):
    import hashlib

    text = long[1]
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)
    bpe = bpe_automaton.encode_decode(spark, docs, queries.vocabulary_path()).first()
    assert bpe.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and len(bpe.ids) == bpe.n_tokens
    stored = media.store_texts(spark, docs).first()
    assert stored.n_bytes == len(text.encode()) and stored.payload_bytes % 64 == 0 and stored.payload_bytes > stored.n_bytes - 1
