"""The pipeline on nulls, empty tables, repeated rows, very long texts and columns with clashing names."""

from pyspark.sql import functions as F

from quillward.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "a small train leaves the old station with nine wagons of coal every morning"


def written(spark, folder, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("_id", "kept_id", "id", "_row", "_t", "_hits", "component_id", "token", "kind"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{k} und" for k in range(60))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "1234 !!", "en", "s", 7), (6, f"so {ITEM} it was", "en", "s", 1)]
    rows += [(None, text, "en", "s", 1), (7, "my token=abcdef12345 here", "de", "s", 25), (8, "lang " * 60_000, "de", "s", 300_000), (9, "plain words in here", "en", "s", 19)]
    sf = written(spark, tmp_path, rows)
    docs, seen = common.table(common.ready(spark), sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "bpe":
            assert docs.columns == before.columns
            docs = common.Scratch(spark, "odd").keep(docs, name)
            seen[name] = sorted((r.doc_id or 0) for r in docs.select("doc_id").collect())
    assert seen["language_id"] == [0, 1, 2, 2, 6, 7, 8, 9]
    assert seen["ngram_join"] == [0, 1, 6, 7, 8, 9]
    assert seen["decontaminate"] == seen["secret_scan"] == [0, 1, 7, 8, 9]
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 7, 8, 9]


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0
