"""Divergence of sources against sums over all terms in plain Python."""

import random
import re
from collections import Counter, defaultdict

from quillward.llm import source_audit

DOCS = "doc_id long, text string, lang string, source string, value string, term int"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, most=10):
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = WORD.findall((text or "").translate(LOW))
        n.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        terms = [w for (g, w), d in docs.items() if g == lang and d >= least]
        v = len(terms)
        share = lambda count, total: 1 + 10**9 * (count + 2) // (total + 2 * v)  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        totals = {s: sum(n[lang, s, w] for w in terms) for s in sources}
        p = {s: {w: share(n[lang, s, w], totals[s]) for w in terms} for s in sources}
        whole = sum(totals.values())
        q = {w: share(sum(n[lang, s, w] for s in sources), whole) for w in terms}
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in terms), t.encode(), t) for t in sources if t != s]
            own = [(-f(p[s][w], q[w]), w.encode(), w) for w in terms if n[lang, s, w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", t, -x, k) for k, (x, _, t) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -x, k) for k, (x, _, w) in enumerate(sorted(own)[:most], 1)]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(5)
    return sorted(tuple(r) for r in source_audit.audit(spark, docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_sums_over_all_terms(spark):
    pick = random.Random(1)
    words = [f"w{chr(97 + k)}" for k in range(20)] + ["été", "日本", "ÉTÉ", "x1y"]
    rows = [(i, " ".join(pick.choice(words[: pick.choice((5, 24))]) for _ in range(pick.randint(0, 30))), pick.choice(["en", "fr", None]), pick.choice(["hot"] * 6 + ["a", "b", "é", None])) for i in range(150)]
    for least in (1, 4, 10):
        assert run(spark, rows, least=least) == brute(rows, least)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "One one ONE", "en", "b"), (4, "one", "de", "alone"), (5, "lone " * 50_000, "en", "c"), (6, "zwei", "de", None)]
    assert run(spark, rows, least=1) == brute(rows, 1)
    nothing = run(spark, rows, least=10)
    assert nothing == brute(rows, 10) and {r[4] for r in nothing} == {0}
    assert run(spark, [], least=1) == []


def test_full_tables_are_given_on(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "ENTRIES", 7)
    monkeypatch.setattr(source_audit, "BATCH", 3)
    rows = [(i, f"a b w{'xyz'[i % 3]} q{'rst'[i % 2]}", "en", f"s{i % 4}") for i in range(60)]
    assert run(spark, rows, least=2) == brute(rows, 2)


def test_ties_go_by_bytes(spark):
    rows = [(i, "same words", "en", s) for i, s in enumerate(["b", "B", "é", "z"] * 5)]
    found = run(spark, rows, least=1)
    assert [r[3] for r in sorted(found, key=lambda r: r[5]) if r[1] == "z" and r[2] == "pair"] == ["B", "b", "é"]
    assert found == brute(rows, 1)
