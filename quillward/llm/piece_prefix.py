"""SentencePiece encoding and decoding by a table of prefixes, for models of merge type.

Merging takes the neighbours whose joined piece has the best score (the leftmost on ties) until
nothing joins. Any part of such a result is itself the result for its own characters, so every
prefix of a word has exactly one token that comes last in it. ``word`` fills a table with that
token for each prefix: an Aho-Corasick automaton over the pieces that merging can make names all
pieces that end at a place, and of these the one holds that is compatible with the last token of
the prefix before it. Two tokens are compatible when merging the characters of both gives back just
these two; ``compatible`` finds that out by undoing merges from the seam outwards, and the answers
are kept. The ids are then read off the table backwards, from the whole word to its start.

Characters in no piece merge with nothing and become byte pieces. Texts are cut into words where no
piece of the model goes on over the cut (``cuts`` finds such places from the pieces). Time is linear in the text. Null is the empty text, which has no
ids. Texts of any length are encoded whole; repeated rows, null ids and further columns of the input
do not matter: one output row per input row, with the columns below only.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common
from quillward.llm.bpe_automaton import ship

#: The letter that stands for a blank in pieces (fixed value of the format).
BLANK = "▁"
#: Kinds of pieces (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What an unknown id decodes to where the model names nothing else (fixed value of the format).
UNKNOWN_TEXT = " ⁇ "
#: Bounds per Python worker: bytes of each of two word caches (an entry counts ENTRY bytes beside its
#: word), characters of a cached word, and kept answers on pairs.
CACHE_BYTES, ENTRY, CACHED, PAIRS = 32 << 20, 192, 64, 400_000


def wire(data: bytes):
    """(field, value) of a protobuf message: numbers, or bytes of strings, messages and fixed sizes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PrefixTable:
    def __init__(self, model: bytes):
        """model: the bytes of a model file of merge type with byte pieces and without normalisation of characters."""
        pieces, trainer, rules = [], {}, {}
        for field, value in wire(model):
            if field == 1:
                one = dict(wire(value))
                pieces.append((one[1].decode(), struct.unpack("<f", one.get(2, bytes(4)))[0], one.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire(value))
            elif field == 3:
                rules = dict(wire(value))
        self.pieces = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if trainer.get(3) != 2 or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or len(self.bytes_at) != 256:
            raise ValueError("only models of merge type with byte pieces and without user-defined or unused pieces")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24):
            raise ValueError("only models without a character map that keep blanks and put the mark before words")
        self.lead = bool(rules.get(3, 1))
        self.unknown = trainer.get(44, UNKNOWN_TEXT.encode()).decode()
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.compile()
        self.words = re.compile(self.cuts(), re.S)
        self.labels = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() for p, _, k in pieces]
        self.digits = [str(i) for i in range(len(pieces))]
        self.plain = not any(k == CONTROL or k == UNKNOWN for k in self.kinds[3:])
        self.forget()

    def compile(self) -> None:
        """The last merge of every piece that merging can make, and the automaton over these pieces."""
        self.parts: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                made = self.merged(p)
                if made is None:
                    continue
                self.parts[i] = made
                if min(self.height(t) for t in made) < self.scores[i]:
                    raise ValueError(f"the piece {p!r} has a better score than its parts")
            automaton.add_word(p, (i, len(p)))
        if any(c not in self.ids for i in self.parts for c in self.pieces[i]):
            raise ValueError("a character of a piece is no piece")
        tied = Counter(self.scores[i] for i in self.parts)
        letters: dict[float, set] = {}
        for i in self.parts:
            if tied[self.scores[i]] > 1:
                letters.setdefault(self.scores[i], set()).update(self.pieces[i])
        if any(len(x) > 1 for x in letters.values()):
            raise ValueError("pieces of one score must be runs of one character")
        automaton.make_automaton()
        self.ends = automaton.iter
        self.rows: list[dict[int, bool] | None] = [None] * len(self.pieces)
        self.pairs = 0

    def cuts(self) -> str:
        """The pattern of words: parts of a text over whose ends no piece goes on.

        Characters that stand side by side in a piece belong together. Words are runs of one of the two largest such
        groups, or of what is in neither, with the blanks before them.
        """
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            return ".+"
        head: dict[str, str] = {}

        def find(c: str) -> str:
            while head.setdefault(c, c) != c:
                c = head[c]
            return c

        for p in self.ids:
            own = p.lstrip(BLANK)
            for a, b in zip(own, own[1:]):  # noqa: B905
                head[find(a)] = find(b)
        groups: dict[str, list[str]] = {}
        for c in head:
            groups.setdefault(find(c), []).append(c)
        large = sorted(groups.values(), key=len)[-2:]
        sets = ["".join(map(re.escape, sorted(g))) for g in large]
        runs = [f"[{x}]+" for x in reversed(sets)] + [f"[^{BLANK}{''.join(sets)}]+"]
        return f"{BLANK}*(?:{'|'.join(runs)})|{BLANK}+"

    def height(self, i: int) -> float:
        """The score of the merge that makes a token; single characters are there from the start."""
        return self.scores[i] if len(self.pieces[i]) > 1 else float("inf")

    def merged(self, text: str) -> tuple[int, int] | None:
        """The two tokens of the last merge, if merging makes one piece of the text."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return None
            last = parts[at : at + 2]
            parts[at : at + 2] = ["".join(last)]
        return (self.ids[last[0]], self.ids[last[1]]) if last and all(x in self.ids for x in last) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens gives back these two.

        A piece over the seam comes about if it scores better than the merge that used up its left part
        and no worse than the one that used up its right part, as of equal scores the leftmost goes first.
        """
        pieces, scores, parts = self.pieces, self.scores, self.parts
        over_left = over_right = float("-inf")
        while True:
            i = self.ids.get(pieces[left] + pieces[right])
            if i is not None and scores[i] > over_left and scores[i] >= over_right:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and scores[left] < scores[right]):  # the one made last is undone first
                over_left, left = scores[left], a[1]
            else:
                over_right, right = scores[right], b[0]

    def word(self, text: str) -> bytes:
        """The ids of one word, four bytes each."""
        n = len(text)
        rows = self.rows  # by token: whether another may follow it, and under -1 the token itself
        last: list[dict | None] = [None] * (n + 1)
        size, done = [1] * (n + 1), -1
        for end, (token, length) in self.ends(text):
            if end == done:
                continue
            before = last[end + 1 - length]
            if before is not None:  # else the word begins here, or a character in no piece stands before
                fits = before.get(token)
                if fits is None:
                    fits = before[token] = self.compatible(before[-1], token)
                    self.pairs += 1
                if not fits:
                    continue
            row = rows[token]
            if row is None:
                row = rows[token] = {-1: token}
            last[end + 1], size[end + 1], done = row, length, end
        out, at = [], n
        while at:
            row = last[at]
            if row is not None:
                out.append(row[-1])
            else:
                out.extend(self.bytes_at[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            at -= size[at]
        out.reverse()
        return array("I", out).tobytes()

    def remember(self, w: str) -> bytes:
        got = self.older.get(w) or self.word(w)
        if self.pairs >= PAIRS:
            self.rows, self.pairs = [None] * len(self.pieces), 0
        if len(w) <= CACHED:
            if self.held >= CACHE_BYTES:
                self.older, self.cache, self.held = self.cache, {}, 0
            self.cache[w] = got
            self.held += ENTRY + 2 * len(w) + len(got)
        return got

    def encode(self, text: str) -> array:
        ids = array("I")
        if text:
            marked = (BLANK if self.lead else "") + text.replace(" ", BLANK)
            get, remember = self.cache.get, self.remember
            ids.frombytes(b"".join([get(w) or remember(w) for w in self.words.findall(marked)]))
        return ids

    def forget(self) -> None:
        """Empty the cache, which only spares work: a worker lives through many stages."""
        self.cache, self.older, self.held = {}, {}, 0

    def decode(self, ids) -> str:
        """The text of any ids: without control pieces and the mark before the first word; bytes that are no character
        become one replacement character each."""
        kinds, labels = self.kinds, self.labels
        if len(ids) and min(ids) > 2 and self.plain:
            first = labels[ids[0]]
            if self.lead and kinds[ids[0]] == NORMAL and first.startswith(b" ") and len(first) > 1:
                try:
                    return b"".join([labels[i] for i in ids])[1:].decode()
                except UnicodeDecodeError:  # byte pieces that spell no character
                    pass
        out: list[str] = []
        spelled = bytearray()
        lead = self.lead
        for i in ids:
            if kinds[i] == BYTE:
                spelled += labels[i]
                continue
            if spelled:
                out.append(characters(bytes(spelled)))
                spelled.clear()
                lead = False
            if kinds[i] == CONTROL:
                continue
            text = self.unknown if kinds[i] == UNKNOWN else labels[i].decode()
            if lead and text:
                lead = False
                if kinds[i] == NORMAL and text[0] == " ":
                    text = text[1:]
            out.append(text)
        out.append(characters(bytes(spelled)))
        return "".join(out)


def characters(data: bytes) -> str:
    """UTF-8 as text; every byte that belongs to no character becomes a replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub(r"[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


_loaded: dict[str, PrefixTable] = {}


def load(path: str) -> PrefixTable:
    """The table of a model file; compiled once per Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = PrefixTable(f.read())
    return _loaded[path]


def encode_decode(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids array<int> unless keep_ids is false).

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the UTF-8 of the text decoded from the ids.
    """
    common.ready(spark)
    name = ship(spark, model)

    def rows(batches):
        table = load(SparkFiles.get(name))
        digits = table.digits
        for batch in batches:
            n, ids, sha, back = [], [], [], []
            for text in common.texts_of(batch.column("text")):
                got = table.encode(text)
                n.append(len(got))
                sha.append(hashlib.sha256(",".join([digits[i] for i in got]).encode()).hexdigest())
                back.append(hashlib.sha256(table.decode(got).encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    ids.append(got.tolist())
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        table.forget()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = own.mapInArrow(common.trimmed(rows), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)
