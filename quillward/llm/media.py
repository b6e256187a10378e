"""Media columns for ISO base media files (MP4 family).

``probe`` walks nested boxes, decodes the sample tables of every track and gives codec,
duration and the byte ranges of key frames; payload bytes are never decoded. Samples of
fragments follow those of the sample tables. Where no sync table marks samples every one is a
key frame, and those that stand side by side in a chunk are one range. ``store`` writes a payload losslessly as 8-bit PCM samples in one track, and ``read_back`` follows
the tables to the stored bytes.

Null texts are empty: their payload is one block of zero bytes. Damaged or foreign bytes
give a row with ``error`` set and null columns, never a failure: tables are read in the form
they have, so a count that the file cannot hold takes no memory. Equal bytes give equal
rows; repeated rows keep one row each. Sizes over 4 GiB use 64-bit boxes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

#: Boxes whose content is more boxes, and bytes before the first (fixed values of the format).
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0}
UNIT = 64
RATE = 8000
SAMPLE = 4096
PER_CHUNK = 4
KEY_EVERY = 8
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store(payload: bytes) -> bytes:
    """An MP4 file whose one track holds payload as unsigned 8-bit mono samples."""
    sizes = [min(SAMPLE, len(payload) - i) for i in range(0, len(payload), SAMPLE)]
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp42")
    mdat = box(b"mdat", payload)
    at = len(head) + len(mdat) - len(payload)
    chunks = [at + sum(sizes[:i]) for i in range(0, len(sizes), PER_CHUNK)] if len(sizes) < 64 else [at + i * SAMPLE for i in range(0, len(sizes), PER_CHUNK)]
    whole, rest = divmod(len(sizes), PER_CHUNK)
    runs = ([(1, PER_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    times: list[list[int]] = []
    for s in sizes:
        if times and times[-1][1] == s:
            times[-1][0] += 1
        else:
            times.append([1, s])
    keys = range(1, len(sizes) + 1, KEY_EVERY)
    total = len(payload)
    wide = total > 0xFFFFFFFF
    long = ">QQIQ" if wide else ">IIII"
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    big = chunks and chunks[-1] > 0xFFFFFFFF
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">I", len(times)), *[struct.pack(">II", *t) for t in times]),
        full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
        full(b"co64" if big else b"stco", struct.pack(">I", len(chunks)), struct.pack(f">{len(chunks)}{'Q' if big else 'I'}", *chunks)),
    )
    source = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(long, 0, 0, RATE, total), struct.pack(">HH", 0x55C4, 0), version=int(wide)),
        full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
        box(b"minf", full(b"smhd", bytes(4)), source, table),
    )
    track = full(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, total), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=int(wide), flags=3)
    movie = full(b"mvhd", struct.pack(long, 0, 0, RATE, total), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=int(wide))
    return head + mdat + box(b"moov", movie, box(b"trak", track, media))


def boxes(data: memoryview, at: int, end: int):
    """(kind, first byte of content, end) of the boxes of a range."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("box header cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} reaches past its parent")
        yield kind, at + head, at + size
        at += size


def tree(data: memoryview, at: int, end: int, path: tuple = (), depth: int = 0):
    """All boxes with their path, outer first."""
    for kind, a, e in boxes(data, at, end):
        yield (*path, kind), a, e
        if kind in NESTED and depth < 32:
            yield from tree(data, a + NESTED[kind], e, (*path, kind), depth + 1)


def _table(data: memoryview, at: int, end: int, kinds: str, columns: int, skip: int = 4) -> np.ndarray:
    """The entries of a counted table, a row each."""
    count = struct.unpack_from(">I", data, at + skip)[0]
    first, size = at + skip + 4, np.dtype(kinds).itemsize * columns
    if first + count * size > end:
        raise ValueError("table longer than its box")
    return np.frombuffer(data[first : first + count * size], kinds).reshape(count, columns).astype(np.int64)


class Track:
    """Handler, codec, times, and samples as chunks: where they begin, their samples and where these end."""

    def __init__(self):
        self.handler, self.codec, self.timescale, self.duration, self.id = "", "", 0, 0, 0
        self.same, self.count, self.sizes = 0, 0, None  # one size of all samples, or a size each
        self.offsets, self.runs, self.sync = np.zeros(0, np.int64), np.zeros((0, 3), np.int64), None
        self.fragments: list[tuple[int, int, int, bool]] = []  # offset, size, samples, key frame

    def settle(self, length: int) -> None:
        """Chunks from the tables; all must lie inside the file."""
        if self.sizes is not None:
            self.count = len(self.sizes)
            self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        elif self.count * max(1, self.same) > max(length, 0):
            raise ValueError("more samples than the file holds")
        first = self.runs[:, 0] - 1
        if len(first) and (first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= max(1, len(self.offsets)) or (self.runs[:, 1] < 0).any()):
            raise ValueError("chunk runs out of order")
        per = np.repeat(self.runs[:, 1], np.diff(np.append(first, len(self.offsets)))) if len(first) else np.zeros(0, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(per)])  # samples before each chunk
        if len(per) != len(self.offsets) or self.begins[-1] != self.count:
            raise ValueError("sample tables do not fit the file")
        self.bytes = self.before(self.begins[1:]) - self.before(self.begins[:-1])
        if ((self.offsets < 0) | (self.offsets + self.bytes > length)).any() or any(o < 0 or o + n > length for o, n, _, _ in self.fragments):
            raise ValueError("samples beyond the file")
        if self.sync is not None and len(self.sync) and not (0 <= self.sync.min() and self.sync.max() < self.count):
            raise ValueError("key frame beyond the samples")

    def before(self, k: np.ndarray) -> np.ndarray:
        """Bytes of all samples before the k-th."""
        return self.ends[k] if self.sizes is not None else np.asarray(k) * self.same

    def samples(self) -> int:
        return self.count + sum(n for _, _, n, _ in self.fragments)

    def keys(self) -> list[tuple[int, int]]:
        """(offset, size) of key frames."""
        if self.sync is None:
            own = [(o, n) for o, n in zip(self.offsets.tolist(), self.bytes.tolist(), strict=True) if n]
        else:
            chunk = np.searchsorted(self.begins, self.sync, side="right") - 1
            at = self.offsets[chunk] + self.before(self.sync) - self.before(self.begins[chunk])
            own = list(zip(at.tolist(), (self.before(self.sync + 1) - self.before(self.sync)).tolist(), strict=True))
        return own + [(o, n) for o, n, _, key in self.fragments if key]

    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets.tolist(), self.bytes.tolist(), strict=True)) + [(o, n) for o, n, _, _ in self.fragments]


def _sizes(view: memoryview, a: int, e: int, kind: bytes, t: Track) -> None:
    if kind == b"stsz":
        t.same, t.count = struct.unpack_from(">II", view, a + 4)
        if not t.same:
            t.sizes = _table(view, a, e, ">u4", 1, 8)[:, 0]
        return
    bits = view[a + 7]
    if bits not in (4, 8, 16):
        raise ValueError("unknown sample size field")
    if bits == 4:
        count = struct.unpack_from(">I", view, a + 8)[0]
        if a + 12 + (count + 1) // 2 > e:
            raise ValueError("table longer than its box")
        pairs = np.frombuffer(view[a + 12 : a + 12 + (count + 1) // 2], np.uint8)
        t.sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:count].astype(np.int64)
    else:
        t.sizes = _table(view, a, e, f">u{bits // 8}", 1, 8)[:, 0]


#: Optional fields of fragment headers by flag, in order (fixed values of the format).
HEADER_FIELDS = [(1, "base", ">Q"), (2, "description", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")]
RUN_FIELDS = [(0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")]
NOT_SYNC = 0x10000


def _fragment(view: memoryview, start: int, a: int, e: int, by_id: dict, defaults: dict) -> None:
    """Samples of one track fragment of the moof box that starts at start."""
    head, at = {}, start
    for kind, x, y in boxes(view, a, e):
        flags = struct.unpack_from(">I", view, x)[0] & 0xFFFFFF
        if kind == b"tfhd":
            track = struct.unpack_from(">I", view, x + 4)[0]
            head, place = dict(defaults.get(track, {})), x + 8
            for bit, name, form in HEADER_FIELDS:
                if flags & bit:
                    head[name] = struct.unpack_from(form, view, place)[0]
                    place += struct.calcsize(form)
            head["track"], at = track, head.get("base", start)
        elif kind == b"trun" and head.get("track") in by_id:
            t, place = by_id[head["track"]], x + 8
            count = struct.unpack_from(">I", view, x + 4)[0]
            if flags & 1:
                at = head.get("base", start) + struct.unpack_from(">i", view, place)[0]
                place += 4
            first = None
            if flags & 4:
                first = struct.unpack_from(">I", view, place)[0]
                place += 4
            fields = [name for bit, name in RUN_FIELDS if flags & bit]
            if place + 4 * len(fields) * count > y:
                raise ValueError("fragment table longer than its box")
            size, own = head.get("size", 0), head.get("flags", 0)
            if "size" not in fields and "flags" not in fields and (not fields or count):
                if count * max(1, size) > len(view):
                    raise ValueError("more samples than the file holds")
                lead = 1 if first is not None and count else 0
                if lead:
                    t.fragments.append((at, size, 1, not first & NOT_SYNC))
                if count > lead:
                    t.fragments.append((at + lead * size, (count - lead) * size, count - lead, not own & NOT_SYNC))
                at += count * size
                continue
            cells = np.frombuffer(view[place : place + 4 * len(fields) * count], ">u4").reshape(count, -1).astype(np.int64).tolist()
            for k, cell in enumerate(cells):
                row = dict(zip(fields, cell, strict=True))
                n = row.get("size", size)
                mark = first if first is not None and not k else row.get("flags", own)
                t.fragments.append((at, n, 1, not mark & NOT_SYNC))
                at += n


def tracks(data: bytes) -> list[Track]:
    view, out, fragments, defaults = memoryview(data), [], [], {}
    moof = 0
    for path, a, e in tree(view, 0, len(view)):
        kind = path[-1]
        if kind == b"trak":
            out.append(Track())
        elif kind == b"moof":
            moof = a - 8
        elif kind == b"traf":
            fragments.append((moof, a, e))
        elif kind == b"trex":
            track, _, _, size, flags = struct.unpack_from(">5I", view, a + 4)
            defaults[track] = {"size": size, "flags": flags}
        if b"trak" not in path or not out:
            continue
        t = out[-1]
        if kind == b"tkhd":
            t.id = struct.unpack_from(">I", view, a + (20 if view[a] == 1 else 12))[0]
        elif kind == b"mdhd":
            wide = view[a] == 1
            t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
        elif kind == b"hdlr" and b"mdia" in path:
            t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t.codec = next((k.decode("latin-1") for k, _, _ in boxes(view, a + 8, e)), "")
        elif kind == b"stss":
            t.sync = _table(view, a, e, ">u4", 1)[:, 0] - 1
        elif kind == b"stsc":
            t.runs = _table(view, a, e, ">u4", 3)
        elif kind in (b"stsz", b"stz2"):
            _sizes(view, a, e, kind, t)
        elif kind in (b"stco", b"co64"):
            t.offsets = _table(view, a, e, ">u4" if kind == b"stco" else ">i8", 1)[:, 0]
    by_id = {t.id: t for t in out}
    for start, a, e in fragments:
        _fragment(view, start, a, e, by_id, defaults)
    for t in out:
        t.settle(len(data))
    return out


def read_back(data: bytes) -> bytes:
    """The stored samples of the first track, in order."""
    return b"".join(data[o : o + s] for o, s in tracks(data)[0].ranges())


PROBE = "codec string, handler string, timescale long, duration long, samples long, keyframes array<struct<offset:long,size:long>>, error string"


def probe_one(data: bytes | None) -> dict:
    none = {"codec": None, "handler": None, "timescale": None, "duration": None, "samples": None, "keyframes": None}
    if not data:
        return none | {"error": "empty"}
    try:
        found = tracks(data)
        if not found:
            return none | {"error": "no track"}
        t = next((t for t in found if t.handler == "vide"), found[0])
        keys = [{"offset": o, "size": s} for o, s in t.keys()]
        return {"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "samples": t.samples(), "keyframes": keys, "error": None}
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return none | {"error": str(e)[:200]}


def probe(spark: SparkSession, files: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """(id, codec, handler, timescale, duration, samples, keyframes, error) per row of binary content."""
    common.ready(spark)
    schema = files.select(id_col).schema

    def rows(batches):
        for batch in batches:
            got = [probe_one(x) for x in batch.column(1).to_pylist()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.string()]
            names = ["codec", "handler", "timescale", "duration", "samples", "keyframes", "error"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[n] for g in got], k) for n, k in zip(names, kinds, strict=True)]], [id_col, *names])

    return files.select(id_col, F.col(content_col).cast("binary")).mapInArrow(rows, f"{id_col} {schema[0].dataType.simpleString()}, {PROBE}")


def store_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Payload columns come from the bytes read back through the sample tables; with
    keep_media the file itself follows as ``media``.
    """
    common.ready(spark)

    def rows(batches):
        for batch in batches:
            out = []
            for text in common.texts_of(batch.column("text")):
                raw = text.encode("utf-8", "surrogatepass")
                media = store(padded(raw))
                back, info = read_back(media), probe_one(media)
                keys = ",".join(f"{k['offset']}+{k['size']}" for k in info["keyframes"])
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"codec={info['codec'].strip()};duration={info['duration']}/{info['timescale']};samples={info['samples']};keys={keys}", *([media] if keep_media else [])))
            cols = list(zip(*out, strict=True)) or [()] * (7 + keep_media)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], ["id", *names[: 7 + keep_media]])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(common.trimmed(rows), "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media).withColumnRenamed("id", id_col)
