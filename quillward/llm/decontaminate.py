"""Benchmark decontamination by template canonicalisation.

Words of a text become template tokens: a number, in digits or as a word, is ``<num>``, a
unit right after a number is ``<unit>``, a capitalised word is ``<name>``; other words are
lower-cased (A-Z). A capital that opens a sentence may be a name or not, so texts are read
both ways. Windows of ``width`` tokens (a shorter item is one window) are hash-joined
between benchmark items and documents. A window with fewer than ``literal`` plain words (all
its words, if it has fewer) says too little as a template: it is joined by the words
themselves, and only where the text between them is the same but for case and white space.

Hits on one alignment of an item are slot-checked: the item's slot values must map one-to-one
onto the document's, so the same question with other numbers or names is caught and
unrelated text in the same shape is not. Slots that disagree with what most slots of their
value say (all of them, in a tie) void the windows that hold them; alignments of one item are
taken in order of length, and later ones must agree with earlier ones. A document leaks an
item when the windows left cover at least ``cover`` of the item's tokens.

Items are the stated query set: they go out in blocks of at most ``block_items`` rows
(a bound on what is broadcast) and every block meets all documents. Null or empty texts
and items without a word match nothing; an item of one word is found wherever that word
stands. Repeated items match under each id once; repeated document rows give repeated
output rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillward.llm import common

#: Units of measure that follow a number (lower case).
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec secs ms min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mph kph kmh usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres degree degrees celsius fahrenheit watt watts volt volts".split()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
#: Bytes after which a capital opens a sentence.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r\"'([{|*#>-"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 11, 12]] = True
NUM, UNIT, NAME = (np.uint64(x) for x in (0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503))
#: Number words: the first stand for 0, 1, 2 and so on, then the tens from 20; the rest only for themselves.
COUNTS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
LARGE = "hundred thousand million billion dozen".split()
#: Sets windows joined word by word apart from templates.
EXACT = np.uint64(0x2545F4914F6CDD1D)
#: Hits gathered at once; more are gathered document by document.
HITS = 2_000_000


def _hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return common.word_hashes(raw, np.array([0, len(raw)]), _WORD, _FOLD)[0]


_UNIT_SET = np.sort(_hashes(UNITS))
_NUMBER_WORDS = _hashes(COUNTS + TENS + LARGE)
_NUMBER_VALUES = np.concatenate([_hashes([str(k) for k in range(20)] + [str(10 * k) for k in range(2, 10)]), _hashes(LARGE)])
_ORDER = np.argsort(_NUMBER_WORDS)
_NUMBER_WORDS, _NUMBER_VALUES = _NUMBER_WORDS[_ORDER], _NUMBER_VALUES[_ORDER]


class Tokens:
    """Template tokens of the rows of a chunk in both readings, the values they stand for, rows, first byte and end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        value, row, start = common.word_hashes(data, offsets, _WORD, _FOLD)
        self.data, self.plain, self.names, self.value, self.row, self.start, self.end = data, value, value, value, row, start, start
        if not len(value):
            return
        inside = _WORD[_FOLD[data]]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:][offsets[1:] > 0] - 1
        ends[edge] |= inside[edge]
        end = np.flatnonzero(ends) + 1
        first, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
        before = data[np.maximum(start - 1, 0)]
        inner = np.zeros(len(start), bool)
        inner[1:] = row[1:] == row[:-1]
        digits = (first >= 48) & (first <= 57)
        # digits, mark, digits: one number
        joined = np.zeros(len(start), bool)
        joined[1:] = digits[1:] & digits[:-1] & inner[1:] & ((before[1:] == 46) | (before[1:] == 44)) & (end[:-1] + 1 == start[1:])
        at = np.minimum(np.searchsorted(_NUMBER_WORDS, value), len(_NUMBER_WORDS) - 1)
        spelled = _NUMBER_WORDS[at] == value
        value = np.where(spelled, _NUMBER_VALUES[at], value)
        number = digits | spelled
        far = data[np.maximum(start - 2, 0)]
        sentence = ~inner | _STOP[before] | (_BLANK[before] & (_STOP[far] | _BLANK[far]))
        capital = _UPPER[first] & _LOWER[second] & ~number
        at = np.minimum(np.searchsorted(_UNIT_SET, value), len(_UNIT_SET) - 1)
        unit = np.zeros(len(start), bool)
        unit[1:] = number[:-1] & inner[1:] & (_UNIT_SET[at] == value)[1:]
        base = np.where(number, NUM, np.where(unit, UNIT, value))
        if joined.any():  # the first part stands for the whole number
            head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(joined))))
            with np.errstate(over="ignore"):
                part = common.mix64(value + (np.arange(len(head)) - head).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                np.add.at(value, head[joined], part[joined])
            keep = ~joined
            end = end[np.append(np.flatnonzero(keep)[1:], len(keep)) - 1]
            value, base, capital, sentence, row, start = (x[keep] for x in (value, base, capital, sentence, row, start))
        free = (base != NUM) & (base != UNIT) & capital
        self.plain, self.names = np.where(free & ~sentence, NAME, base), np.where(free, NAME, base)
        self.value, self.row, self.start, self.end = value, row, start, end

    def windows(self, width: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of all windows inside one row: templates in each reading, else word by word."""
        n = len(self.value) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        one_row = self.row[:n] == self.row[width - 1 :]
        least = min(literal, width)
        other = np.concatenate([[0], np.cumsum(self.plain != self.names)])
        named = self._words(self.names, width, n) >= least
        found = [
            (self._rolled(self.names, width, n), one_row & named),
            (self._rolled(self.plain, width, n), one_row & (other[width:] != other[:n]) & (self._words(self.plain, width, n) >= least)),
            (common.mix64(self._rolled(self.value, width, n) ^ EXACT), one_row & ~named),
        ]
        at = [np.flatnonzero(fit) for _, fit in found]
        return np.concatenate([h[x] for (h, _), x in zip(found, at, strict=True)]), np.concatenate(at)

    @staticmethod
    def _words(token: np.ndarray, width: int, n: int) -> np.ndarray:
        slots = np.concatenate([[0], np.cumsum((token == NUM) | (token == UNIT) | (token == NAME))])
        return width - (slots[width : width + n] - slots[:n])

    @staticmethod
    def _rolled(token: np.ndarray, width: int, n: int) -> np.ndarray:
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                h = h * np.uint64(0xD6E8FEB86659FD93) + token[k : k + n]
        return common.mix64(h)

    def worded(self, at: int, width: int, literal: int) -> bool:
        return max(int(self._words(x[at : at + width], width, 1)[0]) for x in (self.names, self.plain)) >= min(literal, width)

    def raw(self, at: int, width: int) -> bytes:
        """The bytes of a window without white space, in lower case."""
        part = _FOLD[self.data[self.start[at] : self.end[at + width - 1]]]
        return part[~((part == 32) | ((part >= 9) & (part <= 13)))].tobytes()


class ItemIndex:
    """Windows of a block of items, sorted by hash, for each window width."""

    def __init__(self, ids: list, texts: list, width: int, literal: int, cover: float):
        self.cover, self.literal, self.width = cover, literal, width
        self.ids, self.items = ids, []
        found = defaultdict(list)
        for k, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            own = Tokens(raw, np.array([0, len(raw)]))
            self.items.append(own)
            w = min(width, len(own.value))
            if w:
                h, at = own.windows(w, literal)
                found[w].append((h, np.full(len(h), k), at))
        self.sizes = np.array([len(x.value) for x in self.items], np.int64)
        self.tables = {}
        for w, parts in found.items():
            h, item, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(h, kind="stable")
            self.tables[w] = h[order], item[order], at[order]

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float]]:
        """(row, item number, covered share) of a batch, in that order."""
        data, offsets = common.raw_bytes(column)
        out = []
        for i, j in common.chunks(offsets):
            a = offsets[i]
            own = Tokens(data[a : offsets[j]], offsets[i : j + 1] - a)
            met = []  # (w, first and last entry of the table, place in the documents)
            for w, (known, _, _) in self.tables.items():
                h, at = own.windows(w, self.literal)
                lo = np.searchsorted(known, h)
                some = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
                met.append((w, lo[some], np.searchsorted(known, h[some], side="right"), at[some]))
            if sum(int((hi - lo).sum()) for _, lo, hi, _ in met) <= HITS:
                found = self._found(own, met)
            else:
                found = [x for r in range(j - i) for x in self._found(own, [(w, lo[p], hi[p], at[p]) for w, lo, hi, at in met for p in [own.row[at] == r]])]
            out += [(i + r, k, share) for r, k, share in found]
        return out

    def _found(self, own: Tokens, met: list) -> list[tuple[int, int, float]]:
        parts = []
        for w, lo, hi, at in met:
            n = hi - lo
            if not len(n):
                continue
            entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            place = np.repeat(at, n)
            _, item, where = (x[entry] for x in self.tables[w])
            parts.append((own.row[place], item, place - where, where, np.full(len(entry), w)))
        if not parts:
            return []
        row, item, shift, where, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((where, shift, item, row))
        row, item, shift, where, size = (x[order] for x in (row, item, shift, where, size))
        pair = np.ones(len(row), bool)  # a new document or item
        pair[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        line = pair.copy()  # a new alignment
        line[1:] |= shift[1:] != shift[:-1]
        adds = size.copy()  # tokens that a window adds to its alignment
        adds[1:] = np.where(line[1:], size[1:], np.minimum(size[1:], where[1:] - where[:-1]))
        begins = np.flatnonzero(pair)
        enough = np.add.reduceat(adds, begins) >= self.cover * self.sizes[item[begins]]
        ends, out = np.append(begins[1:], len(row)), []
        for b, e in zip(begins[enough].tolist(), ends[enough].tolist(), strict=True):
            share = self._share(own, int(item[b]), shift[b:e], where[b:e], size[b:e])
            if share >= self.cover:
                out.append((int(row[b]), int(item[b]), share))
        return out

    def _share(self, own: Tokens, k: int, shift: np.ndarray, where: np.ndarray, size: np.ndarray) -> float:
        """Share of an item's tokens under windows that pass the slot check."""
        item, lines = self.items[k], defaultdict(set)
        for s, q, w in zip(shift.tolist(), where.tolist(), size.tolist(), strict=True):
            if item.worded(q, w, self.literal) or item.raw(q, w) == own.raw(q + s, w):
                lines[s].add((q, w))
        covered: set[int] = set()
        there: dict[tuple, int] = {}
        back: dict[tuple, int] = {}
        for s, spans in sorted(lines.items(), key=lambda x: (-len(x[1]), x[0])):
            slots = []  # (place, kind, item's value, document's value)
            for p in sorted({p for q, w in spans for p in range(q, q + w)}):
                kind = int(item.names[p])
                if kind in (NUM, UNIT, NAME):
                    slots.append((p, kind, int(item.value[p]), int(own.value[p + s])))
            forth, home = defaultdict(list), defaultdict(list)
            for (kind, x, y), n in Counter((kind, x, y) for _, kind, x, y in slots).items():
                forth[kind, x].append((n, y))
                home[kind, y].append((n, x))
            agreed = {key: there[key] if key in there else most(found) for key, found in forth.items()}
            agreed_back = {key: back[key] if key in back else most(found) for key, found in home.items()}
            bad = {p for p, kind, x, y in slots if agreed[kind, x] != y or agreed_back[kind, y] != x}
            kept = {p for q, w in spans if bad.isdisjoint(range(q, q + w)) for p in range(q, q + w)}
            for p, kind, x, y in slots:
                if p in kept:
                    there[kind, x], back[kind, y] = y, x
            covered |= kept
        return len(covered) / len(item.value)


def most(found: list[tuple[int, int]]) -> int | None:
    """The value with the most votes, None in a tie."""
    found.sort(reverse=True)
    return found[0][1] if len(found) == 1 or found[0][0] > found[1][0] else None


def item_blocks(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, width: int, literal: int, cover: float, block_items: int):
    """Broadcast indexes of the items, a bounded block at a time."""
    own = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").dropDuplicates(["item", "text"])
    parts = max(1, -(-own.count() // block_items))
    for k in range(parts):
        rows = (own.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else own).collect()
        rows.sort(key=lambda r: (str(r["item"]), r["text"]))
        yield spark.sparkContext.broadcast(ItemIndex([r["item"] for r in rows], [r["text"] for r in rows], width, literal, cover))


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, literal: int = 4, cover: float = 0.5, block_items: int = 50_000) -> DataFrame:
    """(id, item, share): every pair of a document and a benchmark item that it leaks; items keep their type."""
    common.ready(spark)
    kind = benchmark.schema[item_col].dataType
    arrow = to_arrow_type(kind)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in item_blocks(spark, benchmark, item_col, item_text_col, width, literal, cover, block_items):
        def pairs(batches, shared=shared):
            index = shared.value
            for batch in batches:
                found = index.leaks(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([index.ids[k] for _, k, _ in found], arrow), pa.array([round(s, 6) for _, _, s in found], pa.float64())], ["id", "item", "share"])

        part = own.mapInArrow(common.trimmed(pairs), f"id long, item {kind.simpleString()}, share double")
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "share")


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, literal: int = 4, cover: float = 0.5, block_items: int = 50_000) -> DataFrame:
    """docs, all columns, without the rows that leak any item; no join back is needed."""
    common.ready(spark)
    for shared in item_blocks(spark, benchmark, item_col, item_text_col, width, literal, cover, block_items):
        def keep(batches, shared=shared):
            index = shared.value
            for batch in batches:
                text = batch.column(text_col)
                gone = {r for r, _, _ in index.leaks(text)}
                yield batch if not gone else batch.filter(pa.array([r not in gone for r in range(batch.num_rows)]))

        docs = docs.mapInArrow(common.trimmed(keep), docs.schema)
    return docs
