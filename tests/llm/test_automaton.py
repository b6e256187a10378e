"""The merge automaton: work per word, word split by written-out classes, paths with dead ends."""

import json
import random

import pytest

from quillward.llm import bpe_automaton, queries


@pytest.fixture(scope="module")
def own():
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        return bpe_automaton.MergeAutomaton(json.load(f))


def test_words_ask_for_few_arcs(own):
    own.forget()
    own.encode(" unbelievablenessification tokenization Kraftfahrzeughaftpflichtversicherung")
    assert len(own.table) <= 40  # 81 when every token at every place that a path reaches was asked for


def test_written_classes_split_as_the_properties_do(own):
    r = random.Random(5)
    plane = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]
    texts = ["".join(x for c in plane[a : a + 400] for x in (c, "a1 ."[ord(c) % 4])) for a in range(0, len(plane), 400)]
    texts += ["".join(r.choice("aé1½  \t\n\x1c\x85　'sll漢.") for _ in range(30)) for _ in range(3000)]
    assert any(own.later.search(t) for t in texts)
    for t in texts:
        assert own.plain.findall(t) == (own.split_later if own.later.search(t) else own.split).findall(t)


def test_joined_labels_equal_library(own):
    from tokenizers import Tokenizer

    lib, r = Tokenizer.from_file(queries.vocabulary_path()), random.Random(11)
    labels = [x.decode("utf-8", "ignore") for x in own.labels.values()]
    texts = ["".join(r.choice(labels) for _ in range(r.randint(1, 12))) for _ in range(4000)] + ["".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(own.encode(t)) == e.ids


def test_a_missing_byte_is_an_error():
    letters = {b: c for c, b in bpe_automaton.byte_letters().items()}
    vocab = {letters[b]: k for k, b in enumerate(b"ab")} | {"ab": 2}
    small = bpe_automaton.MergeAutomaton({"model": {"vocab": vocab, "merges": ["a b"]}})
    assert list(small.encode("abba")) == [2, 1, 0]
    with pytest.raises(ValueError, match="lacks single bytes"):
        small.encode("abc")
