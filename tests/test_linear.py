"""Searches in linear time: the same hits as the plain patterns, and hostile texts in bounded time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillward.functions import linear, rules
from quillward.functions.rules import pattern
from quillward.operators import detectors as D
from quillward.operators import exfil, markup, places, sanitize, spans
from quillward.session import ready

BITS = ["UPDATE", "update ", "SET", " SET ", " ", "  ", "\n", "\n\n", "\r\n", "DROP TABLE ", "INSERT INTO ", "x", "{{", "{", "}", "}}", "system", "prompt", "#", "##", " System:", "Agent :", "\t", " ", "y z"]


@pytest.mark.parametrize("k", sorted(rules.LINEAR))
def test_same_hits_as_the_plain_pattern(k):
    pick = random.Random(k)
    _, rule, flags, _ = rules.PHRASE_RULES[k]
    if k == 42:  # a line also begins behind the other line ends of the rules' dialect
        rule, flags = r"(?:\A|(?<=[\n\r\x{2028}\x{2029}]))" + rule.removeprefix("^"), "i"
    plain, own, hits = re.compile(pattern(rule, flags, "py")), linear.Rule(k), 0
    for _ in range(30_000):
        text = "".join(pick.choice(BITS) for _ in range(pick.randint(1, 16)))
        want = [m.span() for m in plain.finditer(text)]
        assert [m.span() for m in own.finditer(text)] == want, repr(text)
        assert own.sub("@", text) == plain.sub("@", text)
        hits += len(want)
    assert hits > 200


def test_native_hits_and_rewrites_equal(spark):
    pick = random.Random(9)
    texts = ["".join(pick.choice(BITS) for _ in range(pick.randint(1, 16))) for _ in range(3000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    known = sorted(rules.LINEAR)
    rows = docs.select("text", *[D.rule_hits("text", k).alias(f"n{k}") for k in known], *[D.without_rule(F.col("text"), k, "@").alias(f"s{k}") for k in known]).collect()
    for r in rows:
        for k in known:
            own = linear.Rule(k)
            assert (r[f"n{k}"], r[f"s{k}"]) == (len(list(own.finditer(r.text))), own.sub("@", r.text)), repr(r.text)


#: What each rule begins with, and more that opens and never closes.
PREFIXES = ["{{ ", "{{", "UPDATE x ", "UPDATE ", "UPDATE  x SET ", "DROP ", "eval ", "\n#", "\n \n", "# System ", "ignore ", "ignore all ", "you are ", "act as ", "new system ", "what is ", "END OF ", "<|im_start|> ", "<", "![", "![a](", "![a][", "[", "\n[", "\n[a", "<img ", "<img src=", "<use ", "<use href=", "<script ", "<foreignObject ", "<![CDATA[", "<!-- x", " onload=", " href='", "`", "\n```\n", "\n~~~", "<pre>", "<pre ", "<code>", "> ", "https://a.b?", "&#", "&#1", "xn--", "http://xn--", "A" * 19 + " ", "a1" * 30]
SIZE = 1 << 17


@pytest.mark.parametrize("prefix", PREFIXES)
@pytest.mark.parametrize("mixed", [False, True])
def test_hostile_text_in_python(prefix, mixed):
    unit = prefix + "some words​ " if mixed else prefix
    text = (unit * (SIZE // len(unit) + 1))[:SIZE]
    began = time.time()
    list(spans.matches(text))
    spans.code_ranges(text)
    exfil.images(text)
    markup.vector(text)
    for _ in markup.COMMENT.finditer(linear.upto(text, "-->")):
        pass
    for rule in spans.PHRASES:
        rule[1].sub("@", text)
    assert time.time() - began < 10, prefix


def test_hostile_text_in_catalyst(spark):
    ready(spark)
    texts = [(k, (p * (SIZE // len(p) + 1))[:SIZE]) for k, p in enumerate(PREFIXES)]
    slow = []
    for k, text in texts:
        docs = spark.createDataFrame([(k, text)], "doc_id long, text string")
        began = time.time()
        docs.select(*D.phrase_hits("text"), F.size(D.image_links("text")), D.without_phrases(F.col("text"))).write.format("noop").mode("overwrite").save()
        took = time.time() - began
        slow += [(PREFIXES[k], round(took, 1))] * (took > 6)
    assert not slow


@pytest.mark.parametrize("prefix", ["\n```\n", "<pre>", "`a` ", "{{ system }} ", "jailbreak ", "\n> q"])
def test_places_of_a_text_full_of_hits(spark, prefix):
    """Many hits and ranges in one text stay linear too."""
    text = (prefix * ((SIZE >> 2) // len(prefix) + 1))[: SIZE >> 2] + " jailbreak"
    began = time.time()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert places.phrase_places(docs).count() > 0
    assert time.time() - began < 40, prefix


def test_sanitizer_uses_the_same_hits():
    text = "UPDATE a SET b UPDATE c\n{{ x }} {{ system }}\n\n # System: y"
    out, counts, _ = sanitize.sanitize(text)
    assert out == "[REMOVED]b UPDATE c\n{{ x }} [REMOVED]\n[REMOVED] y" and counts["suspiciousPatterns"] == 3
