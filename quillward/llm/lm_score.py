"""Masked pseudo-likelihood with a bidirectional window network.

Every token is predicted from the two tokens on either side, as if it were masked; a
document's log-likelihood is the sum of ``log p(token | both sides)`` and its score that sum
per token. The network reads the identities of the four neighbours (an embedding for each
side and place; the ``inputs`` most frequent tokens have rows of their own, others share
hashed ones), has one tanh layer and a softmax in two steps. The ``CLASSES * MEMBERS`` most
frequent tokens are predicted one by one: their class, then the member of the class, both
from the hidden layer. Less frequent tokens are predicted as bands of ranks, each twice as
wide as the one before, so that bands grow in number with the vocabulary, and the last band
holds what lies beyond ``known`` ranks; inside a band ``p(token | band)`` is the token's exact
share of the corpus.

All documents take part in all steps. (1) Tokens are counted over the corpus, in a written
table that is never collected; the ``known`` most frequent go to the workers. (2) Every task
trains the network on all windows of its own documents, each once, in batches that take
windows ``stride`` apart, as neighbours tell much the same; the networks are averaged by the
number of their windows, in two steps of bounded groups. It follows that the network, not the
counts, depends on how the input is split. (3) Documents are scored; counts of tokens beyond the
known ones come from the table by a join on the token, once for each text of a task.

Log-probabilities are rounded to 1e-4 and summed as integers, so equal texts score alike.
Tokens are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z, and runs
of other visible characters. Null is the empty text: no tokens, score 0, perplexity null.
Whole texts are scored; repeated rows count as often as they stand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

CLASSES, MEMBERS = 32, 32
#: Log-probabilities are counted in units of 1 / UNIT.
UNIT = 10_000
HASHED, SLOT, SALTS = 1024, 1024, 64
#: Windows of a training step.
BATCH = 8192

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLAIN = np.arange(256, dtype=np.uint8)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_WORD
_MARK[65:91] = False


def marks_of(data: np.ndarray, offsets: np.ndarray):
    """common.word_hashes of the marks; where they are few, from their own bytes alone."""
    at = np.flatnonzero(_MARK[data])
    if not len(at) or 4 * len(at) > len(data):
        return common.word_hashes(data, offsets, _MARK, _PLAIN)
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != at[:-1] + 1
    place = np.searchsorted(at, offsets[:-1])
    begins[place[at[np.minimum(place, len(at) - 1)] == offsets[:-1]]] = True
    first = np.flatnonzero(begins)
    start = at[first]
    into = at - np.repeat(start, np.diff(first, append=len(at)))
    with np.errstate(over="ignore"):
        value = np.add.reduceat(common._BYTE_KEYS[data[at]] * common._power(common._BASE, int(into.max()) + 1)[into], first)
    return common.mix64(value), np.searchsorted(offsets, start, side="right") - 1, start


def words_of(column: pa.Array):
    """Per chunk of rows: token keys (odd for words, even for marks) and row offsets into them."""
    data, offsets = common.raw_bytes(column)
    for i, j in common.chunks(offsets):
        a = offsets[i]
        part, off = data[a : offsets[j]], offsets[i : j + 1] - a
        key, row, start = common.word_hashes(part, off, _WORD, _FOLD)
        mark, mark_row, mark_at = marks_of(part, off)
        order = np.argsort(np.concatenate([start, mark_at]), kind="stable")
        keys = np.concatenate([key | np.uint64(1), mark & ~np.uint64(1)])[order]
        rows = np.concatenate([row, mark_row])[order]
        yield keys, np.searchsorted(rows, np.arange(j - i + 1))


class Vocabulary:
    """Known tokens by key: class, member, log p(token | band) and input row."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, inputs: int):
        """keys, counts: most frequent first; total: of all tokens."""
        rank = np.arange(len(keys))
        single = CLASSES * MEMBERS
        band = np.floor(np.log2(np.maximum(rank, single) / single + 1e-9)).clip(0).astype(np.int64)
        cls = np.where(rank < single, rank // MEMBERS, CLASSES + band)
        self.tail = CLASSES + (int(band.max()) + 1 if len(keys) > single else 0)
        mass = np.bincount(cls, weights=counts, minlength=self.tail + 1).astype(np.float64)
        mass[self.tail] = max(0, total - int(counts.sum()))
        own = np.where(rank < single, 0.0, np.log(counts / np.maximum(mass[cls], 1)))
        self.tail_log = math.log(max(1.0, mass[self.tail]))
        self.prior = np.log((mass + 0.5) / (mass.sum() + 0.5 * len(mass)))
        self.members = np.full((CLASSES, MEMBERS), -1e9)
        some = rank < single
        self.members[cls[some], rank[some] % MEMBERS] = np.log(counts[some] / mass[cls[some]])
        self.keys, self.cls, self.member, self.own = keys, cls.astype(np.int32), (rank % MEMBERS).astype(np.int32), own
        self.inputs = inputs
        # Most keys have a place of their own by their lower bits; the others are searched.
        self.bits = np.uint64((1 << (4 * len(keys) + 64).bit_length()) - 1)
        places = (keys >> np.uint64(1) & self.bits).astype(np.int64)
        self.first = np.full(int(self.bits) + 1, -1, np.int32)
        self.first[places[::-1]] = rank[::-1]
        rest = np.flatnonzero(self.first[places] != rank)
        self.rest = rest[np.argsort(keys[rest])]
        self.edge = inputs + HASHED

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each token, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        rank = self.first[(keys >> np.uint64(1) & self.bits).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero((rank >= 0) & (self.keys[rank] != keys))
        rank[miss] = -1
        if len(self.rest) and len(miss):
            others = self.keys[self.rest]
            at = np.minimum(np.searchsorted(others, keys[miss]), len(others) - 1)
            rank[miss] = np.where(others[at] == keys[miss], self.rest[at], -1)
        return rank

    def look_up(self, keys: np.ndarray):
        """Class, member, log p(token | band) without the tail's counts, input row, and whether a token is known."""
        rank = self.ranks(keys)
        hashed = self.inputs + (keys >> np.uint64(20) & np.uint64(HASHED - 1)).astype(np.int64)
        known = rank >= 0
        if not len(self.keys):
            return np.full(len(keys), self.tail, np.int32), np.zeros(len(keys), np.int32), np.full(len(keys), -self.tail_log), hashed, known
        return np.where(known, self.cls[rank], self.tail), np.where(known, self.member[rank], 0), np.where(known, self.own[rank], -self.tail_log), np.where(known & (rank < self.inputs), rank, hashed), known


def neighbours(rows: np.ndarray, cut: np.ndarray, edge: int) -> np.ndarray:
    """Input rows of the two tokens on either side of each, edge beyond a document's ends."""
    n = len(rows)
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    flat = np.full(n + 4 * (len(cut) - 1), edge, np.int64)
    at = np.arange(n) + 4 * doc + 2
    flat[at] = rows
    return np.stack([flat[at - 2], flat[at - 1], flat[at + 1], flat[at + 2]])


class WindowNetwork:
    def __init__(self, vocabulary: Vocabulary, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape)
        self.members, self.rooms = vocabulary.members, {}
        self.params = [normal(4, vocabulary.edge + 1, hidden).astype(np.float32), np.zeros(hidden, np.float32), normal(hidden, len(vocabulary.prior)), vocabulary.prior.copy(), normal(CLASSES, hidden, MEMBERS), np.zeros((CLASSES, MEMBERS))]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, p in enumerate(self.params):
            self.params[i] = flat[at : at + p.size].reshape(p.shape).astype(p.dtype)
            at += p.size

    def room(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        """An array that the next batch uses again: a worker's memory faults in anew with every large array."""
        n = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < n:
            self.rooms[name] = np.empty(n, kind)
        return self.rooms[name][:n].reshape(shape)

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        embed, bias = self.params[:2]
        total, more = (self.room(x, ctx.shape[1], len(bias)) for x in ("hidden", "more"))
        np.take(embed[0], ctx[0], axis=0, out=total, mode="clip")  # rows are in range; other modes copy
        for k in (1, 2, 3):
            total += np.take(embed[k], ctx[k], axis=0, out=more, mode="clip")
        total += bias
        return np.tanh(total, out=total)

    @staticmethod
    def log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log softmax(z)[at] of each column of floats; z is used up."""
        own = z[at, np.arange(len(at))].astype(np.float64)
        return own - np.log(np.exp(z, out=z).sum(0)).astype(np.float64)

    def log_p(self, ctx: np.ndarray, cls: np.ndarray, member: np.ndarray) -> np.ndarray:
        """log p(class | neighbours), and of the member where the class is of single tokens.

        Products come in doubles, so rounding to floats is the same in any batch. Tokens go by class, so that the members
        of all classes are one table; only its products are made class by class.
        """
        out = np.empty(len(cls))
        _, _, top, prior, inner, bias = self.params
        rounded = lambda z, to: np.minimum(z, 80, out=to, casting="unsafe")
        for i in range(0, len(cls), 16384):
            order = np.argsort(cls[i : i + 16384].astype(np.int16), kind="stable")
            c, order = cls[i : i + 16384].take(order), order + i
            h = self.room("doubles", len(c), len(top), kind=np.float64)
            h[...] = self.hidden(ctx.take(order, axis=1))
            z = np.matmul(top.T, h.T, out=self.room("products", len(prior), len(c), kind=np.float64))
            z += prior[:, None]
            logp = self.log_softmax(rounded(z, self.room("classes", len(prior), len(c))), c)
            ends = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
            z = self.room("members", MEMBERS, ends[-1])
            for k in range(CLASSES):
                if ends[k] < ends[k + 1]:
                    rounded(inner[k].T @ h[ends[k] : ends[k + 1]].T + (bias[k] + self.members[k])[:, None], z[:, ends[k] : ends[k + 1]])
            logp[: ends[-1]] += self.log_softmax(z, member.take(order[: ends[-1]]))
            out[order] = logp
        return out

    def step(self, ctx: np.ndarray, cls: np.ndarray, member: np.ndarray, sums: list[np.ndarray], rate: float) -> None:
        """One AdaGrad step on a batch; sums: of squared gradients."""
        embed, _, top, prior, inner, bias = self.params
        n, order = len(cls), np.argsort(cls.astype(np.int16), kind="stable")
        ctx, cls, member = ctx.take(order, axis=1), cls.take(order), member.take(order)
        h = np.ascontiguousarray(self.hidden(ctx).T)

        def error(z, at):
            z -= z.max(0)
            np.exp(z, out=z)
            z *= (1 / n) / z.sum(0)
            z[at, np.arange(len(at))] -= np.float32(1 / n)
            return z

        def move(param, total, g):
            g, scale = np.asarray(g, param.dtype), self.room(f"move {param.shape}", *param.shape, kind=param.dtype)
            total += np.multiply(g, g, out=scale)
            np.add(total, 1e-8, out=scale)
            np.sqrt(scale, out=scale)
            np.divide(g, scale, out=scale)
            scale *= rate
            param -= scale

        w = top.astype(np.float32)
        e = np.matmul(w.T, h, out=self.room("classes", len(prior), n))
        e += prior.astype(np.float32)[:, None]
        e = error(e, cls)
        dh, gradients = w @ e, [(2, h @ e.T), (3, e.sum(1))]
        w, b = inner.astype(np.float32), (bias + self.members).astype(np.float32)
        ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        some = [(k, slice(ends[k], ends[k + 1])) for k in range(CLASSES) if ends[k] < ends[k + 1]]
        z = self.room("members", MEMBERS, ends[-1])  # of the members of all classes, whose tokens stand side by side
        for k, rows in some:
            np.add(w[k].T @ h[:, rows], b[k][:, None], out=z[:, rows])
        e = error(z, member[: ends[-1]])
        g, gb = np.zeros_like(inner), np.zeros_like(bias)
        for k, rows in some:
            dh[:, rows] += w[k] @ e[:, rows]
            g[k], gb[k] = h[:, rows] @ e[:, rows].T, e[:, rows].sum(1)
        dh *= 1 - h * h
        for i, g in [*gradients, (4, g), (5, gb), (1, dh.sum(1))]:
            move(self.params[i], sums[i], g)
        d, g = self.room("dh", *dh.shape, kind=np.float64), self.room("columns", len(h), *embed.shape[:2])
        d[...] = dh
        for k, x in enumerate(d):
            for place in range(4):
                g[k, place] = np.bincount(ctx[place], x, embed.shape[1])
        rows = self.room("rows", *embed.shape)
        for place in range(4):
            for at in range(0, embed.shape[1], 1024):
                rows[place, at : at + 1024] = g[:, place, at : at + 1024].T
        move(embed, sums[0], rows)


def _count_words(batches):
    """(key, n): tokens of a task, summed within it in bounded tables."""
    kept: list[np.ndarray] = []
    tally = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    held = 0

    def settle(parts, old):
        u, n = np.unique(np.concatenate(parts), return_counts=True)
        keys, inverse = np.unique(np.concatenate([old[0], u]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([old[1], n]), minlength=len(keys)).astype(np.int64)

    def batch_of(t):
        return pa.RecordBatch.from_arrays([pa.array(t[0].view(np.int64)), pa.array(t[1])], ["key", "n"])

    for batch in batches:
        for keys, _ in words_of(batch.column("text")):
            kept.append(keys)
            held += len(keys)
            if held > 1_000_000:
                tally, kept, held = settle(kept, tally), [], 0
                if len(tally[0]) > 1_000_000:
                    yield batch_of(tally)
                    tally = tuple(x[:0] for x in tally)
    tally = settle(kept, tally) if kept else tally
    if len(tally[0]):
        yield batch_of(tally)


def _trained(shared, hidden: int, seed: int, stride: int, rate: float):
    """(slot, salt, task, windows, part): a task's network, trained on its own documents, in parts of SLOT values."""
    def rows(batches):
        vocabulary = shared.value
        network = WindowNetwork(vocabulary, hidden, seed)
        sums = [np.zeros_like(p) for p in network.params]
        kept, held, windows = [], 0, 0

        def step():
            network.step(*(np.concatenate(x, axis=-1) for x in zip(*kept, strict=True)), sums, rate)

        for batch in batches:
            for keys, cut in words_of(batch.column("text")):
                cls, member, _, own, _ = vocabulary.look_up(keys)
                ctx = neighbours(own, cut, vocabulary.edge)
                order, begin = np.concatenate([np.arange(k, len(keys), stride) for k in range(stride)]), 0
                while begin < len(order):
                    at = order[begin : begin + BATCH - held]
                    kept.append((ctx[:, at], cls[at], member[at]))
                    begin, held, windows = begin + len(at), held + len(at), windows + len(at)
                    if held == BATCH:
                        step()
                        kept, held = [], 0
        if held:
            step()
        if windows:
            flat, task = network.flat(), TaskContext.get().partitionId()
            flat = np.concatenate([flat, np.zeros(-len(flat) % SLOT)]).reshape(-1, SLOT).astype(np.float32)
            n = len(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array([task % SALTS] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array([windows] * n, pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())], ["slot", "salt", "task", "windows", "part"])

    return rows


def _averaged(table: pa.Table) -> pa.Table:
    """The parts of one group as their mean by windows, in the order of tasks."""
    table = table.sort_by("task")
    n = table["windows"].to_numpy()
    parts = [np.frombuffer(x, np.float32) for x in table["part"].to_pylist()]
    mean = sum(w * p.astype(np.float64) for w, p in zip(n / n.sum(), parts, strict=True))
    return pa.table([table["slot"][:1], table["salt"][:1], table["task"][:1], pa.array([int(n.sum())]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["slot", "salt", "task", "windows", "part"])


PARTS = "slot int, salt int, task int, windows long, part binary"


def train(spark: SparkSession, own: DataFrame, scratch: common.Scratch, known: int, inputs: int, hidden: int, stride: int, rate: float, seed: int):
    """The counts of all tokens as a written table, the known tokens, and the network."""
    counts = scratch.keep(own.select("text").mapInArrow(common.trimmed(_count_words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = counts.orderBy(F.desc("n"), "key").limit(known).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
    keys = ranked["key"].to_numpy().astype(np.int64).view(np.uint64)
    vocabulary = Vocabulary(keys, ranked["n"].to_numpy().astype(np.int64), total, inputs)
    shared = spark.sparkContext.broadcast(vocabulary)  # known ranks at most
    parts = scratch.keep(own.select("text").mapInArrow(common.trimmed(_trained(shared, hidden, seed, stride, rate)), PARTS), "parts")
    mean = parts.groupBy("slot", "salt").applyInArrow(_averaged, PARTS).groupBy("slot").applyInArrow(_averaged, PARTS)
    found = mean.select("slot", "part").toArrow().sort_by("slot")  # one network
    network = WindowNetwork(vocabulary, hidden, seed)
    if found.num_rows:
        network.load(np.concatenate([np.frombuffer(x, np.float32) for x in found["part"].to_pylist()]).astype(np.float64))
    return counts, vocabulary, network


def _scored(shared):
    """A row of each document; the first of a text in a task also has its tokens beyond the known ones."""
    def rows(batches):
        vocabulary, network = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            n, part, tail, times, first = [], [], [], [], []
            marks = zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)
            for keys, cut in words_of(batch.column("text")):
                cls, member, own, into, known = vocabulary.look_up(keys)
                logp = np.rint((network.log_p(neighbours(into, cut, vocabulary.edge), cls, member) + own) * UNIT).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(logp)])
                part += (sums[cut[1:]] - sums[cut[:-1]]).tolist()
                n += np.diff(cut).tolist()
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    mark = next(marks)
                    fresh = mark not in seen
                    if fresh:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(mark)
                    rare, count = np.unique(keys[a:b][~known[a:b]], return_counts=True) if fresh else (keys[:0], keys[:0])
                    first.append(fresh and len(rare) > 0)
                    tail.append(rare.view(np.int64))
                    times.append(count)
            listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]), kind))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("s1"), batch.column("s2"), pa.array(n, pa.int64()), pa.array(part, pa.int64()), pa.array(first, pa.bool_()), listed(tail, pa.int64()), listed(times, pa.int32())], ["id", "s1", "s2", "n", "part", "first", "tail", "times"])

    return rows


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = 131_072, inputs: int = 4096, hidden: int = 16, stride: int = 16, rate: float = 0.1, seed: int = 7) -> DataFrame:
    """(id, n_tokens, score, log_likelihood, perplexity) for every row of docs."""
    common.ready(spark)
    scratch = common.Scratch(spark, "lm")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    counts, vocabulary, network = train(spark, own, scratch, known, inputs, hidden, stride, rate, seed)
    shared = spark.sparkContext.broadcast((vocabulary, network))
    marked = own.select("id", F.xxhash64("text").alias("s1"), F.xxhash64(F.lit("second"), "text").alias("s2"), "text")
    rows = scratch.keep(marked.mapInArrow(common.trimmed(_scored(shared)), "id long, s1 long, s2 long, n long, part long, first boolean, tail array<long>, times array<int>"), "rows")
    first = rows.where("first")
    hits = first.select("s1", "s2", F.inline(F.arrays_zip(F.col("tail").alias("key"), F.col("times").alias("times"))))
    worth = (F.col("times") * F.rint(F.log(F.col("n").cast("double")) * UNIT).cast("long")).alias("worth")
    hits = hits.join(counts.where("n > 1"), "key").select("s1", "s2", worth, F.lit(0).alias("copies"))  # the logarithm of 1 is 0
    tails = hits.union(first.select("s1", "s2", F.lit(0).cast("long"), F.lit(1))).groupBy("s1", "s2").agg(F.sum("worth").alias("worth"), F.sum("copies").alias("copies"))
    tails = tails.select("s1", "s2", (F.col("worth") / F.col("copies")).cast("long").alias("more"))  # every task that met a text added the same
    total = ((F.col("part") + F.coalesce("more", F.lit(0))) / UNIT).alias("total")
    out = rows.select("id", "s1", "s2", "n", "part").join(tails, ["s1", "s2"], "left").select("id", "n", total)
    some = F.col("n") > 0
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.when(some, F.round(F.col("total") / F.col("n"), 6)).otherwise(0.0).alias("score"), F.col("total").alias("log_likelihood"), F.when(some, F.round(F.exp(-F.col("total") / F.col("n")), 4)).alias("perplexity"))
