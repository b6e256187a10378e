"""Byte-level BPE as a tokenization automaton.

The automaton accepts exactly the token strings that merging in rank order yields.
It starts with one state that reads any byte. Every merge ``(a, b) -> ab`` applies one
gadget: the arc ``b`` leaves the state reached by ``a``; wherever ``a`` could be read
``ab`` can now be read; and the state after ``ab`` gets the arcs that the state after
``b`` had at that moment. A state is therefore named by the token read last, and a
gadget is a row copy, a column copy and one erased cell of the arc table. A full table
has |V|^2 cells (2.5e9 here), so ``compile`` stores the gadgets in order and the table
is filled where words ask: ``arc`` unwinds the two copies back to single bytes, once
per cell. The table is deterministic: for each prefix of a word one path survives.

Encoding splits a text into words and follows the arcs depth first: the label trie names
the longest token at the place reached, and where the state lacks that arc, the shorter
ones are asked. A prefix that was reached once is not reached again, so no place is walked
twice. Decoding emits the arcs' labels. Null is the empty text, which has no tokens. Texts
of any length are encoded whole, with time linear in their bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

#: Code points that are letters or numbers only in Unicode versions after the one that the
#: tokenizers library classifies by (fixed values; they count as other characters).
LATER = (
    r"\x{558}\x{58B}\x{58C}\x{88F}\x{C5C}\x{CDC}\x{208F}\x{209D}-\x{209F}\x{A7CE}\x{A7CF}\x{A7D2}\x{A7D4}\x{A7DD}\x{A7E2}\x{A7F1}"
    r"\x{AB6C}\x{AB6D}\x{107BB}-\x{107BF}\x{10940}-\x{10959}\x{10EC5}-\x{10EC7}\x{10ED9}-\x{10EEE}\x{11B0A}\x{11DB0}-\x{11DDB}"
    r"\x{11DE0}-\x{11DE9}\x{11DF1}\x{1246F}\x{12475}-\x{1247F}\x{12550}-\x{12686}\x{16EA0}-\x{16EB8}\x{16EBB}-\x{16ED3}"
    r"\x{16FF2}-\x{16FF6}\x{187F8}-\x{187FF}\x{18CD6}-\x{18CDA}\x{18D09}-\x{18D20}\x{18D80}-\x{18DF2}\x{18E00}-\x{19191}"
    r"\x{191A0}-\x{191D2}\x{1B123}-\x{1B128}\x{1B168}\x{1D6A6}\x{1DF1F}-\x{1DF24}\x{1DF2B}-\x{1DF81}\x{1DF90}-\x{1DF96}"
    r"\x{1DFCD}-\x{1DFFF}\x{1E6C0}-\x{1E6DE}\x{1E6E0}-\x{1E6E2}\x{1E6E4}\x{1E6E5}\x{1E6E7}-\x{1E6ED}\x{1E6F0}-\x{1E6F4}"
    r"\x{1E6FE}\x{1E6FF}\x{2B73A}-\x{2B73F}\x{2B81E}\x{2CEA2}-\x{2CEAD}\x{323B0}-\x{33479}\x{3D000}-\x{3FC3F}"
)
LATER = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", LATER)
#: Word split of the public byte-level vocabulary (fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds per Python worker: bytes of each of two word caches (an entry counts ENTRY bytes
#: beside its word), bytes of a cached word, and cells of the arc table kept.
CACHE_BYTES, ENTRY, CACHED_BYTES, CELLS = 16 << 20, 192, 64, 340_000
LEAF: dict = {}


def splitter() -> re.Pattern:
    """WORDS for texts of the basic plane, with the classes of its code points written out: the same words in half the time."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    kinds = {k: "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"(?V1){c}+", plane)) for k, c in (("L", f"[\\p{{L}}--[{LATER}]]"), ("N", f"[\\p{{N}}--[{LATER}]]"), ("s", r"\s"))}
    own = WORDS.replace("\\S", f"[^{kinds['s']}]").replace("[^\\s\\p{L}\\p{N}]", f"[^{''.join(kinds.values())}]")
    for k, c in (("\\p{L}", kinds["L"]), ("\\p{N}", kinds["N"]), ("\\s", kinds["s"])):
        own = own.replace(k, f"[{c}]")
    return re.compile(own)


class Words(dict):
    """Tokens of words; what is missing is asked of the automaton."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, w: str) -> bytes:
        return self.ask(w)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, model: dict):
        """model: a parsed tokenizers file with a byte-level BPE model."""
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.split = regex.compile(WORDS)
        odd = f"[\\p{{L}}\\p{{N}}--[{LATER}]]"  # only for texts that hold such characters
        letters_ = odd.replace("\\p{N}", "")
        self.later = regex.compile(f"[{LATER}]")
        self.split_later = regex.compile("(?V1)" + WORDS.replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{odd}]").replace(" ?\\p{L}+", f" ?{letters_}+").replace(" ?\\p{N}+", f" ?{odd.replace(chr(92) + 'p{L}', '')}+"))
        self.plain, self.beyond = splitter(), re.compile("[\U00010000-\U0010ffff]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache = Words(self.remember)
        self.older: dict[str, bytes] = {}
        self.held = 0

    def compile(self, merges: list[tuple[int, int, int]]) -> None:
        """One gadget per merge, in order: (time, row copied from, column copied from)."""
        self.erased: dict[int, int] = {}  # last << 17 | token -> time
        self.gadget: dict[int, tuple[int, int, int]] = {}
        for time, (a, b, ab) in enumerate(merges, 1):
            self.erased.setdefault(a << 17 | b, time)
            self.gadget.setdefault(ab, (time, a, b))
        self.table: dict[int, int] = {}  # last << 17 | token -> the longest arc of the state that token's label begins with, or -1
        # Labels that merges can make: the bytes, and every merge's result.
        made = [i for i, x in self.labels.items() if i in self.gadget or (len(x) == 1 and i not in self.special.values())]
        self.shorter: dict[int, int] = {}  # token -> the longest one that its label begins with, or -1
        self.trie = self.branch(sorted((self.labels[i], i) for i in made), 0, -1)
        self.size = {i: len(self.labels[i]) for i in made}
        self.longest = max(self.size.values())

    def branch(self, labels: list[tuple[bytes, int]], depth: int, above: int) -> dict[int, tuple[dict, int]]:
        """Trie over sorted labels longer than depth: byte -> (branch below, the token that ended last on the way there or -1)."""
        out, at = {}, 0
        while at < len(labels):
            byte, to = labels[at][0][depth], at
            while to < len(labels) and labels[to][0][depth] == byte:
                to += 1
            ends = len(labels[at][0]) == depth + 1
            below, token = labels[at + ends : to], labels[at][1] if ends else above
            if ends:
                self.shorter[token] = above
            out[byte] = (self.branch(below, depth + 1, token) if below else LEAF, token)
            at = to
        return out

    def arc(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc ``token`` once all gadgets are applied."""
        before = len(self.erased) + 1
        while True:
            if self.erased.get(last << 17 | token, before) < before:
                return False
            row, col = self.gadget.get(last), self.gadget.get(token)
            if row is None and col is None:
                return True
            if col is None or (row is not None and row[0] >= col[0]):
                # the row of ``last`` was copied before its own merge erased a cell
                before, last = min(before, row[0]), row[2]
            else:
                # the column of ``token`` was copied after its merge erased a cell
                before, token = min(before, col[0] + 1), col[1]

    def reach(self, last: int, token: int) -> int:
        """The longest arc of the state after ``last`` among ``token`` and what its label begins with, or -1; kept in the table."""
        asked = []
        while token >= 0:
            key = last << 17 | token
            known = self.table.get(key)
            if known is not None:
                token = known
                break
            asked.append(key)
            if self.arc(last, token):
                break
            token = self.shorter[token]
        if len(self.table) >= CELLS:
            self.table.clear()
        self.table.update(dict.fromkeys(asked, token))
        return token

    def word(self, data: bytes) -> bytes:
        """The tokens of one word, four bytes each: the only path of the automaton that spells it."""
        n, longest, size, table = len(data), self.longest, self.size, self.table
        met = bytearray(n + 1)  # prefixes that a path spelled
        path, at, last = array("I"), 0, -1
        while at < n:
            node, token = self.trie, -1
            for byte in data[at : at + longest]:
                step = node.get(byte)
                if step is None:
                    break
                node, token = step
            while True:
                if last >= 0 and token >= 0:
                    arc = table.get(last << 17 | token)
                    token = self.reach(last, token) if arc is None else arc
                if token < 0:  # no arc leads on: back to the state before, and its next shorter arc
                    if not path:
                        raise ValueError("no path spells the word: the vocabulary lacks single bytes")
                    at -= size[last]
                    token = self.shorter[path.pop()]
                    last = path[-1] if path else -1
                elif met[to := at + size[token]]:
                    token = self.shorter[token]
                else:
                    break
            met[to] = 1
            path.append(token)
            at, last = to, token
        return path.tobytes()

    def remember(self, w: str) -> bytes:
        """The tokens of a word that the newer cache lacks."""
        data = w.encode("utf-8", "surrogatepass")
        got = self.older.get(w) or self.word(data)
        if len(data) <= CACHED_BYTES:
            if self.held >= CACHE_BYTES:
                self.older, self.held = dict(self.cache), 0
                self.cache.clear()
            self.cache[w] = got
            self.held += ENTRY + len(data) + len(got)
        return got

    def encode(self, text: str) -> array:
        out: list[bytes] = []
        parts = self.cut.split(text) if any(x in text for x in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            split = self.plain
            if not part.isascii() and self.beyond.search(part):
                split = self.split_later if self.later.search(part) else self.split
            out.extend(map(self.cache.__getitem__, split.findall(part)))
        ids = array("I")
        ids.frombytes(b"".join(out))
        return ids

    def forget(self) -> None:
        """Empty the caches, which only spare work: a worker lives through many stages."""
        self.cache.clear()
        self.older, self.held = {}, 0
        self.table.clear()

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, MergeAutomaton] = {}


def load(path: str) -> MergeAutomaton:
    """The automaton of a file; compiled once per Python worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            _loaded[path] = MergeAutomaton(json.load(f))
    return _loaded[path]


def ship(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to every executor; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_decode(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids array<int> unless keep_ids is false, ids_sha256, decoded_sha256).

    ids_sha256 is over little-endian unsigned 32-bit ids, decoded_sha256 over the UTF-8 of
    the decoded text. Repeated rows and null ids are kept; one output row per input row.
    """
    common.ready(spark)
    name = ship(spark, vocabulary)

    def rows(batches):
        auto = load(SparkFiles.get(name))
        for batch in batches:
            n, ids, sha, back = [], [], [], []
            for text in common.texts_of(batch.column("text")):
                got = auto.encode(text)
                n.append(len(got))
                raw = got.tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(auto.decode(got).encode()).hexdigest())
                if keep_ids:
                    ids.append(got.tolist())
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        auto.forget()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = own.mapInArrow(common.trimmed(rows), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)
