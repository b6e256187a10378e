"""N-gram Jaccard join by T-occurrence search (DivideSkip), with components.

A document's set holds its distinct n-word shingles (64-bit hashes). Two sets link
when ``100 * |A & B| >= percent * |A | B|``. The search is exact:

1. Equal sets become one class (128-bit signature), so copies cost one row.
2. All documents use one order of shingles: by hash, shingles that whole tasks saw
   often last. A partner must share ``T`` shingles, so DivideSkip's split of a query's
   lists into ``T - l`` long and ``n - T + l`` short ones makes every partner occur
   at least ``l`` times in the short lists, which are the first of that order. The first
   shingle of the order that two partners share is among the first ``n - T + 1`` of both,
   their cores.
3. Short lists are dealt by shingle. A document with fewer than ``l`` shingles that any
   other posts has no partner and goes; the lists are dealt again without it. A list with
   more than ``long_list`` members is set aside. A query with ``k`` such lists heap-merges
   the others (MergeSkip with bisect jumps) and keeps partners that occur ``l - k`` times,
   once at least.
4. A parity bitmap of each set bounds the symmetric difference from below and drops
   pairs that cannot link; what stays is probed by binary search in the long lists.
5. Partners that the merge cannot see share only lists set aside, so both have ``l`` of
   them and both have one in their cores: only such members of such lists are kept. They are
   checked against the list's pivot, round by round; members that are in one component
   need nothing more. What is still apart meets in blocks of bitmaps, by size: sets more
   than one band of sizes apart cannot link.
6. Components come from large-star / small-star rounds on written tables.

Nulls and texts without a word have an empty set, link with nothing and are their own
component. Repeated rows keep one output row each. Rows with a null id are
returned; a null id is never a component id while its class has another.
Hashes stand for shingles: a wrong link needs several 64-bit collisions in one pair.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Ids above this count are joined by shuffle, not broadcast (8 MB of ids).
BROADCAST_IDS = 1_000_000


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return (percent * n + 99) // 100


def both_need(n: int, m: int, percent: int) -> int:
    """Smallest overlap o with 100*o >= percent*(n+m-o)."""
    return -((-percent * (n + m)) // (100 + percent))


def least_hits(n: int) -> int:
    """How often a partner must occur in the short lists of a set of n."""
    return 1 + n // 10


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = common.raw_bytes(column)
    for i, j in common.chunks(offsets):
        a = offsets[i]
        words, row, _ = common.word_hashes(data[a : offsets[j]], offsets[i : j + 1] - a, _WORD, _FOLD)
        first = np.searchsorted(row, np.arange(j - i + 1))
        with np.errstate(over="ignore"):
            grams = np.zeros(len(words), np.uint64)
            for k in range(min(width, len(words))):
                moved = words[k:] if k else words
                grams[: len(words) - k] += moved * np.uint64(2 * 0x6C62272E07BB0142 * k + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        grams = common.mix64(grams)
        for r in range(j - i):
            b, e = first[r], first[r + 1]
            if e - b >= width:
                yield np.unique(grams[b : e - width + 1])
            elif e > b:  # fewer words: the whole sequence as one
                with np.errstate(over="ignore"):
                    x = np.uint64(e - b)
                    for w in words[b:e]:
                        x = common.mix64(np.array([x * np.uint64(0xD6E8FEB86659FD93) + w]))[0]
                yield np.array([x], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def parity_bitmap(grams: np.ndarray) -> bytes:
    """Bit k: whether an odd number of shingles falls on k; at least n bits."""
    bits = 1 << max(6, int(len(grams) - 1).bit_length())
    at = (grams >> np.uint64(7)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return apart <= n + m - 2 * both_need(n, m, percent)


def signature(grams: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = common.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
        b = common.mix64(grams + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def short_lists(grams: np.ndarray, often: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """A query's n - T + l short lists: the first shingles of the common order."""
    n = len(grams)
    take = min(n, n - needed(n, percent) + least_hits(n))
    if len(often):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        heavy = often[at] == grams
    else:
        heavy = np.zeros(n, bool)
    rare = grams[~heavy]
    if len(rare) >= take:
        return rare[:take]
    late, order = grams[heavy], rank[at[heavy]]
    return np.concatenate([rare, late[np.lexsort((late, order))][: take - len(rare)]])


def merge_skip(lists: list[list[int]], least: int) -> list[int]:
    """Values that occur in at least ``least`` of the sorted lists: a heap over list heads;
    when too few lists share the smallest head, ``least - 1`` lists jump by bisection."""
    heads = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heads)
    found = []
    while len(heads) >= least:
        value, popped = heads[0][0], []
        while heads and heads[0][0] == value:
            popped.append(heapq.heappop(heads))
        if len(popped) >= least:
            found.append(value)
            jump = None
        else:
            while heads and len(popped) < least - 1:
                popped.append(heapq.heappop(heads))
            if not heads:
                break
            jump = heads[0][0]
        for _, k, at in popped:
            to = at + 1 if jump is None else bisect_left(lists[k], jump, at)
            if to < len(lists[k]):
                heapq.heappush(heads, (lists[k][to], k, to))
    return found


def overlap_reaches(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Binary probes of the shorter set in the longer, in runs, until need is met or out of reach."""
    if len(a) > len(b):
        a, b = b, a
    got, left = 0, len(a)
    for i in range(0, len(a), 256):
        run = a[i : i + 256]
        at = np.searchsorted(b, run)
        got += int((b[np.minimum(at, len(b) - 1)] == run).sum())
        left -= len(run)
        if got >= need or got + left < need:
            break
    return got >= need


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(width: int, id_col: str, text_col: str, often_from: int):
    """Rows of documents (kind 0) and shingles that this task saw often (kind 1)."""

    def rows(batches):
        kept, counts = [], 0
        tally: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def settle(final: bool):
            nonlocal kept, counts, tally
            fresh, kept, counts = np.concatenate([*kept, tally[0][:0]]), [], 0
            fresh.sort()
            ends = np.flatnonzero(np.append(fresh[1:] != fresh[:-1], True)) if len(fresh) else np.zeros(0, np.int64)
            value, times = fresh[ends], np.diff(ends, prepend=-1)
            del fresh, ends
            had, total = tally
            if len(had) and len(value):  # what was known takes its new hits; the rest is new
                at = np.minimum(np.searchsorted(value, had), len(value) - 1)
                same = value[at] == had
                total = total + np.where(same, times[at], 0)
                times[at[same]] = 0
            floor = often_from if final else 2
            new = times >= floor
            value, times = np.concatenate([had[total >= floor], value[new]]), np.concatenate([total[total >= floor], times[new]])
            order = np.argsort(value)
            tally = value[order], times[order]

        for batch in batches:
            out = {k: [] for k in ("n", "s1", "s2", "bits")}
            for grams in shingle_sets(batch.column(text_col), width):
                a, b = signature(grams)
                out["n"].append(len(grams))
                out["s1"].append(a)
                out["s2"].append(b)
                out["bits"].append(parity_bitmap(grams) if len(grams) else b"")
                kept.append(grams)
                counts += len(grams)
            if counts > 1_000_000:
                settle(False)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(id_col).cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["s1"], pa.int64()), pa.array(out["s2"], pa.int64()), pa.array(out["bits"], pa.binary())], ["kind", "id", "n", "s1", "s2", "bits"])
        settle(True)
        u, c = tally
        if len(u):
            k = len(u)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), none, pa.array(c, pa.int64()), _signed(u), none, pa.nulls(k, pa.binary())], ["kind", "id", "n", "s1", "s2", "bits"])

    return rows


def _postings(width: int, text_col: str, often: np.ndarray, rank: np.ndarray, percent: int):
    def rows(batches):
        seen: set[int] = set()  # classes this task has already posted
        for batch in batches:
            tokens, keys, sizes, core = [], [], [], []
            for grams in shingle_sets(batch.column(text_col), width):
                if not len(grams):
                    continue
                key = signature(grams)[0]
                if key in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                mine = short_lists(grams, often, rank, percent)
                tokens.append(mine)
                keys.append(np.full(len(mine), key, np.int64))
                sizes.append(np.full(len(mine), len(grams), np.int64))
                core.append(np.arange(len(mine)) <= len(grams) - needed(len(grams), percent))
            if tokens:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(core))], ["token", "s1", "n", "core"])

    return rows


def _shared(batches):
    """Postings, sorted by shingle, whose shingle another class posts as well."""
    last = None  # the open posting, and whether it was let out
    for batch in batches:
        t, s, n, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("token", "s1", "n", "core"))
        if not len(t):
            continue
        if last is not None:
            t, s, n, c = (np.concatenate([[x], y]) for x, y in zip(last[:4], (t, s, n, c), strict=True))
        fresh = np.ones(len(t), bool)  # repeats of a class under a token count once
        fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s, n, c = t[fresh], s[fresh], n[fresh], c[fresh]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        out = same[1:] | same[:-1]
        if last is not None:
            out[0] &= not last[4]
        before = last is not None and len(t) == 1 and last[4]
        last = (t[-1], s[-1], n[-1], c[-1], before or bool(out[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(s[out]), pa.array(n[out]), pa.array(c[out])], ["token", "s1", "n", "core"])


def _lists(long_list: int, percent: int):
    """From postings sorted by shingle: for each member of a short list its later members
    (kind 0), or the members of a long list one by one (kind 1)."""

    def rows(batches):
        token, ids, long = None, [], False
        out: list[tuple] = []

        def close():
            if not long and len(ids) > 1:
                for i, (x, n, _) in enumerate(ids):
                    rest = [y for y, m, _ in ids[i + 1 :] if 100 * min(n, m) >= percent * max(n, m)]
                    if rest:
                        out.append((0, token, x, n, None, rest))

        def batch_of():
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "token", "s1", "n", "core", "others"])

        for batch in batches:
            for t, s, n, c in zip(*(batch.column(x).to_pylist() for x in ("token", "s1", "n", "core")), strict=True):
                if t != token:
                    close()
                    token, ids, long = t, [], False
                if ids and ids[-1][0] == s:
                    continue
                if long:
                    out.append((1, t, s, n, c, None))
                    ids = [(s, n, c)]
                    continue
                ids.append((s, n, c))
                if len(ids) > long_list:
                    out.extend((1, t, x, m, d, None) for x, m, d in ids)
                    long, ids = True, [(s, n, c)]
            if len(out) > 4096:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    return rows


def least_in_lists(n: int, percent: int) -> int:
    """How many posted shingles a set of n shares with any partner: what the smallest partner needs."""
    return least_hits(needed(n, percent))


def _merge(percent: int):
    """k: lists of the query that were set aside, where a partner may have occurred as well."""
    def rows(batches):
        for batch in batches:
            a, b = [], []
            for x, n, k, lists in zip(*(batch.column(c).to_pylist() for c in ("s1", "n", "k", "lists")), strict=True):
                hits = merge_skip(lists, max(1, least_in_lists(n, percent) - k))
                a += [x] * len(hits)
                b += hits
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows


def _bitmap_filter(percent: int):
    def rows(batches):
        for batch in batches:
            ok = [may_link(x, n, y, m, percent) for x, n, y, m in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows


def _arrays(width: int, text_col: str):
    def rows(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(text_col), width))
            sig = [signature(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array([x for x, _ in sig], pa.int64()), pa.array([x for _, x in sig], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "s1", "s2", "grams"])

    return rows


def _verify(percent: int):
    def rows(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(overlap_reaches(p, q, both_need(len(p), len(q), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows


def _stacked(bitmaps, sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: rows whose bitmap has at least that size, and the folded bitmaps."""
    own = [np.frombuffer(x, np.uint8) for x in bitmaps]
    out = {}
    for size in sizes:
        at = np.array([i for i, x in enumerate(own) if len(x) >= size], np.int64)
        out[size] = at, np.stack([folded(own[i], size) for i in at]) if len(at) else np.zeros((0, size), np.uint8)
    return out


def _blocks(percent: int):
    """One pair of blocks of a long list: bitmaps of both sides against each other."""

    def pairs(pdf):
        import pandas as pd

        if not len(pdf) or pdf.comp.min() == pdf.comp.max():
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        sizes = sorted({len(x) for x in pdf.bits})
        stacks = _stacked(right.bits, sizes)
        ids, ns, comps = right.id.to_numpy(), right.n.to_numpy(), right.comp.to_numpy()
        lengths = np.array([len(x) for x in right.bits])
        found = set()
        for x, n, comp, bits in zip(left.id, left.n, left.comp, left.bits, strict=True):
            mine = np.frombuffer(bits, np.uint8)
            fit = (comps != comp) & (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n))
            most = ns + n - 2 * -((-percent * (ns + n)) // (100 + percent))
            for size in sizes:
                at, stack = stacks[size]
                ok = fit[at] & (np.minimum(lengths[at], len(mine)) == size)
                if ok.any():
                    at = at[ok]
                    near = np.bitwise_count(stack[ok] ^ folded(mine, size)).sum(1) <= most[at]
                    found.update((min(x, y), max(x, y)) for y in ids[at[near]].tolist())
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return pairs


def components(spark: SparkSession, edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b); large-star / small-star rounds.

    Ids without an edge are absent. Every round is a written table. Minima are partial before
    they are dealt out; the join that takes them back to a hub's edges is a plain sort-merge
    join on the hub, which adaptive execution splits where a hub is hot.
    """
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen = None
    for k in range(1, 60):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, f"{name}-{k}")
        mark = after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
        same, seen = mark == seen, mark
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def ngram_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, long_list: int = 8, often_from: int = 6, often_kept: int = 131072, pivot_rounds: int = 2, block: int = 256) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    often_from, often_kept: a task reports shingles that it saw so often; so many of them,
    the most frequent, go last in the common order. Any order gives the same links, these
    two only spare work. long_list: members above which a list is not paired out.
    """
    common.ready(spark)
    scratch = common.Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = scratch.keep(docs.mapInArrow(common.trimmed(_scan(width, "id", "text", often_from)), "kind int, id long, n long, s1 long, s2 long, bits binary"), "scan")
    rows = seen.where("kind = 0").select("id", "n", "s1", "s2")
    heavy = seen.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s1").limit(often_kept).collect()
    heavy = sorted((int(np.int64(r["s1"]).view(np.uint64)), r["n"]) for r in heavy)
    often, rank = np.array([x for x, _ in heavy], np.uint64), np.array([x for _, x in heavy], np.int64)
    classes = scratch.keep(seen.where("kind = 0 and n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")).where("rep is not null"), "classes")

    form = "token long, s1 long, n long, core boolean"
    posted = docs.select("text").mapInArrow(common.trimmed(_postings(width, "text", often, rank, percent)), form).repartition("token").sortWithinPartitions("token", "s1")
    shared = scratch.keep(posted.mapInArrow(common.trimmed(_shared), form), "shared")
    least = 1 + F.floor(F.floor((F.col("n") * percent + 99) / 100) / 10)  # least_in_lists
    for k in range(2):  # without the documents that share too little, then without what only they shared
        hits = shared.groupBy("s1", "n").count()
        fit = scratch.keep(hits.where(F.col("count") >= least).select("s1").distinct(), f"fit-{k}")
        if fit.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            fit = F.broadcast(fit)
        again = shared.join(fit, "s1", "left_semi").select("token", "s1", "n", "core").repartition("token").sortWithinPartitions("token", "s1")
        if k == 0:
            shared = scratch.keep(again.mapInArrow(common.trimmed(_shared), form), "shared-again")
            scratch.drop("shared")
    lists = scratch.keep(again.mapInArrow(common.trimmed(_lists(long_list, percent)), "kind int, token long, s1 long, n long, core boolean, others array<long>"), "lists")
    merged = lists.groupBy("s1", "n").agg(F.count_if(F.col("kind") == 1).alias("k"), F.collect_list("others").alias("lists")).where(F.size("lists") > 0)
    merged = merged.mapInArrow(common.trimmed(_merge(percent)), "a long, b long")
    key = classes.select("s1", F.col("rep").alias("id"), "n", "bits")
    side = lambda c: key.select(F.col("s1").alias(f"s_{c}"), F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    aside = lists.where("kind = 1")
    full = aside.groupBy("s1", "n").count().where(F.col("count") >= least).select("s1")  # nothing but long lists may join them
    members = aside.where("core").select("token", "s1").join(full, "s1", "left_semi").join(key, "s1").select("token", "id", "n", "bits")
    members = scratch.keep(members, "members")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of class representatives that link, as a written table."""
        pairs = scratch.keep(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        wanted = docs.join(ids, "id", "left_semi").mapInArrow(common.trimmed(_arrays(width, "text")), "id long, s1 long, s2 long, grams binary")
        own = classes.select(F.col("rep").alias("id"), "s1", "s2")
        sets = scratch.keep(wanted.join(own, ["id", "s1", "s2"]).dropDuplicates(["id"]).select("id", "grams"), f"{name}-sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        return scratch.keep(both.mapInArrow(common.trimmed(_verify(percent)), "a long, b long"), f"{name}-links")

    near = merged.select(F.col("a").alias("s_a"), F.col("b").alias("s_b")).join(side("a"), "s_a").join(side("b"), "s_b")
    edges = linked(near.mapInArrow(common.trimmed(_bitmap_filter(percent)), "a long, b long").distinct(), "near")
    comps = components(spark, edges, scratch, "comp-near")

    with_long = not members.isEmpty()
    done = members.select("token", F.lit(None).cast("long").alias("comp")).limit(0)
    for k in range(pivot_rounds if with_long else 0):
        open_ = _apart(members, comps, done)
        pivots = open_.groupBy("token").agg(F.min_by(F.struct("id", "n", "bits", "comp"), "id").alias("p")).select("token", F.col("p.id").alias("a"), F.col("p.n").alias("n_a"), F.col("p.bits").alias("bits_a"), F.col("p.comp").alias("comp_a"))
        pivots = scratch.keep(pivots, f"pivots-{k}")
        if pivots.isEmpty():
            break  # every member is in the component of some pivot; the blocks compare those components
        tries = open_.join(pivots, "token").where("comp <> comp_a").where(F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent)
        tries = tries.select("a", "n_a", "bits_a", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")).dropDuplicates(["a", "b"])
        edges = edges.union(linked(tries.mapInArrow(common.trimmed(_bitmap_filter(percent)), "a long, b long"), f"pivot-{k}"))
        comps = components(spark, edges, scratch, f"comp-{k}")
        moved = pivots.select("token", F.col("a").alias("id")).join(comps, "id", "left").select("token", F.coalesce("comp", "id").alias("comp"))
        done = scratch.keep(done.join(comps.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("token", F.coalesce("to", "comp").alias("comp")).union(moved).distinct(), f"done-{k}")
    if with_long:
        # A wider step than percent allows between partners, so float order never parts two of them by more than one band.
        band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.col("n")).cast("int")
        rest = _apart(members, comps, done.limit(0)).withColumn("band", band)
        mixed = rest.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("mark")).where("lo <> hi")
        mixed = mixed.groupBy("size", "mark", "lo", "hi").agg(F.min("token").alias("token")).select("token")  # lists with the same members are one
        rest = scratch.keep(rest.join(mixed, "token", "left_semi"), "rest")
        parts = rest.groupBy("token", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        above = parts.select("token", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_up"))
        below = parts.select("token", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_down"))
        own = rest.join(parts.join(above, ["token", "band"], "left").join(below, ["token", "band"], "left"), ["token", "band"])
        own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        cell = lambda i, up, j, side: F.struct(i.cast("int").alias("i"), F.lit(up).alias("up"), j.cast("int").alias("j"), F.lit(side).alias("side"))
        until = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array()").cast("array<int>"))
        meets = F.concat(
            F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda j: cell(F.col("part"), 0, j, 0)),
            F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: cell(i, 0, F.col("part"), 1)),
            F.transform(until(F.coalesce("parts_up", F.lit(0))), lambda j: cell(F.col("part"), 1, j, 0)),
            F.transform(until(F.coalesce("parts_down", F.lit(0))), lambda i: cell(i, 1, F.col("part"), 1)),
        )
        cells = own.select("token", "band", "id", "n", "comp", "bits", F.explode(meets).alias("m")).select("token", F.when((F.col("m.up") == 1) & (F.col("m.side") == 1), F.col("band") - 1).otherwise(F.col("band")).alias("low"), "m.up", "m.i", "m.j", "m.side", "id", "n", "comp", "bits")
        met = cells.groupBy("token", "low", "up", "i", "j").applyInPandas(_blocks(percent), "a long, b long").distinct()
        found = linked(met, "block")
        if not found.isEmpty():
            comps = components(spark, edges.union(found), scratch, "comp-last")
    comps = scratch.keep(comps, "components")
    owner = classes.select("s1", "s2", "rep").join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    full = rows.where("n > 0").join(owner, ["s1", "s2"], "left").select("id", "n", "comp")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("comp"))
    return full.union(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))


def _apart(members: DataFrame, comps: DataFrame, done: DataFrame) -> DataFrame:
    """Members of long lists with their component, without the components a list's pivots had."""
    now = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    return now.join(done, ["token", "comp"], "left_anti")


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with one row per component: its smallest id.

    Ids to drop are broadcast up to BROADCAST_IDS, else joined by shuffle. Of rows that
    repeat an id the one with the smallest text stays, of those the one with the smallest
    hash of its columns; rows with a null id stay.
    """
    scratch = common.Scratch(spark, "keep-first")
    own = common.fresh(docs, "kept_id")
    found = scratch.keep(ngram_join(spark, docs, id_col, text_col, **options).select(F.col(id_col).alias(own), "component_id"), "components")
    gone = found.where(F.col(own) != F.col("component_id")).select(own).distinct()
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs[id_col] == gone[own], "left_anti")
    twice = scratch.keep(found.where(F.col(own) == F.col("component_id")).groupBy(own).count().where("count > 1").select(own), "twice")
    if twice.isEmpty():
        return kept
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = kept.join(twice, kept[id_col] == twice[own], "left_semi").groupBy(F.col(f"`{id_col}`").alias(own))
    again = again.agg(F.min_by(F.struct(*names), F.struct(F.col(f"`{text_col}`"), F.xxhash64(*plain))).alias("row")).select("row.*")
    return kept.join(twice, kept[id_col] == twice[own], "left_anti").unionByName(again)
