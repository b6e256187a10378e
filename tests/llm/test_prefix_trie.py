"""The trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from quillward.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, key int"


def brute(rows, group=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c > 0 else -1)  # the remainder has the sign of the id
        built[c] = own.get(base, [])[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        leaf = all(len(built[c]) == len(path) for c in members)
        if path:
            kids[path[:-1]] += 1
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += leaf
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark, table, **options).collect()), key=str)


def some(n, seed, most=12):
    pick = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if pick.random() < 0.15:
            continue
        for t in range(pick.randint(1, most)):
            rows.append((c, t if t else pick.choice([None, 0]), pick.choice(["user", "assistant", None]) if t > 1 else "user", pick.choice(["a", "é", "", None]) if t else "hi"))
    pick.shuffle(rows)
    return rows


def test_equals_a_dictionary_of_prefixes(spark):
    rows = some(60, 1)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, heads=1) == brute(rows, heads=1)


def test_small_windows_and_hot_keys_change_nothing(spark, monkeypatch):
    for name, value in {"RUN": 4, "HOT": 5, "BUCKET": 7, "IDS": 2}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rows = some(25, 2, 20) + [(1000 + k, t, "user", f"t{t}") for k in range(8) for t in range(15)]
    assert run(spark, rows) == brute(rows)


def test_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 64)
    rows = [(3, t, "user", str(t % 7)) for t in range(300)] + [(c, t, "user", "same") for c in range(10, 40) for t in range(3)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 2, "a", "b"), (7, 2, "a", "b"), (7, 2, "a:b", ""), (11, 5, "user", "x" * 70_000), (12, 1, "user", "only")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "lost")]) == []


def test_conversations_without_turns_end_in_the_root(spark):
    """Conversation 1 has no base and fewer turns than it would borrow."""
    h = zlib.crc32(b"1") % 9
    rows = [(1, t, "user", "x") for t in range(min(h, 2))]
    assert h >= 1 and run(spark, rows) == brute(rows) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
