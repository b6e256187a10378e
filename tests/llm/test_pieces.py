"""Encoding by prefix tables against the sentencepiece library."""

import hashlib
import random

import pytest

from quillward.llm import piece_prefix, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return piece_prefix.load(queries.vocabulary_path(queries.PIECES))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECES))


def texts(table, n, seed):
    pick = random.Random(seed)
    odd = [" ", "  ", "▁", "\n", "\t", "a", "e", "the", "ing", "é", "中文", "\U0001f600", "\x00", "\r\n", "xxx", ".", "'s", "<s>", "<0x0A>", "</s>", "▁▁", "12", "́", "﻿", "\U0010ffff", " " * 15, " " * 17, " " * 31, "Un"]
    pieces = pick.sample(sorted(table.ids), 1500)
    for _ in range(n):
        yield "".join(pick.choice(odd if pick.random() < 0.5 else pieces) for _ in range(pick.randint(0, 12)))


def test_ids_and_texts_equal_the_library(table, library):
    for text in texts(table, 6000, 1):
        ids = list(table.encode(text))
        assert ids == library.encode(text), text
        assert table.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(table, library):
    pick = random.Random(2)
    for _ in range(4000):
        ids = [pick.choice([0, 1, 2, 259, 260, 28705, pick.randrange(3, 259), pick.randrange(32000)]) for _ in range(pick.randint(0, 8))]
        assert table.decode(ids) == library.decode(ids), ids


def test_compatible_pairs_are_those_that_merge_back(table, library):
    """Two tokens may stand side by side exactly when their text, without a mark before it, merges to these two."""
    pick = random.Random(3)
    ids = sorted(table.ids.values())
    for _ in range(4000):
        a, b = pick.choice(ids), pick.choice(ids)
        parts = list(table.pieces[a] + table.pieces[b])
        while True:
            best = max(((table.scores[i], -k) for k in range(len(parts) - 1) if (i := table.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]
        assert table.compatible(a, b) == (parts == [table.pieces[a], table.pieces[b]])


@pytest.mark.parametrize("text", ["x" * 70_000, " " * 70_001, "ab" * 40_000, "中" * 30_000, "é\n" * 20_000], ids=["x", "blanks", "ab", "han", "lines"])
def test_very_long_texts(table, library, text):
    assert list(table.encode(text)) == library.encode(text)


def test_small_caches_change_nothing(table, library, monkeypatch):
    monkeypatch.setattr(piece_prefix, "CACHE_BYTES", 2000)
    monkeypatch.setattr(piece_prefix, "PAIRS", 50)
    for text in texts(table, 500, 4):
        assert list(table.encode(text)) == library.encode(text)
    table.forget()


def test_query_on_the_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_pieces"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "é\U0001f600"), (5, "a b")]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, ids_sha256 string, id int")
    out = piece_prefix.encode_decode(spark, docs, queries.vocabulary_path(queries.PIECES))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted((r.doc_id or 0, r.ids) for r in out.collect()) == sorted((i or 0, library.encode(t or "")) for i, t in rows)
    assert piece_prefix.encode_decode(spark, docs.where("false"), queries.vocabulary_path(queries.PIECES)).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge type"):
        piece_prefix.PrefixTable(b"")
