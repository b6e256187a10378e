"""Language identification with string kernels.

Texts are lower-cased, everything but letters becomes one space, and a text is the set
of its character n-grams (blended spectrum, presence only, lengths 1 to ``longest``),
hashed to ``1 << bits`` buckets. ``k(x, y) = |x & y| / sqrt(|x| |y|)``. Colliding n-grams
count as one; a very long text fills many buckets, which lowers its kernel with every
landmark alike, so the order of languages holds and only the score sinks. A Nystroem map
over landmark documents of every language feeds one-versus-rest kernel ridge
regression; scoring is one batch-by-landmarks and one landmarks-by-languages product.

Training reads a bounded sample of labelled rows (``per_language`` expected rows of each of
the ``most_languages`` most frequent languages, by a hash of id and text, repeated rows
once) whose crc32(id as text) mod ``folds`` is not 0. Whole
texts are learned and scored. A text that is null or has no letter is ``und`` with score
0. Without labelled rows every text is ``und``. Repeated rows are scored one by one.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def presence(text: str, longest: int, bits: int) -> np.ndarray:
    """Sorted buckets of the n-grams of a text; empty without a letter."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[code]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    code = np.where(is_letter, code, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others stays, as a space
    code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
    flags = np.zeros(1 << bits, bool)
    grams = code
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            if n > 1:
                if len(code) < n:
                    break
                grams = grams[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
            mixed = (grams + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            flags[((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)] = True
    return np.flatnonzero(flags)


class KernelModel:
    """Landmarks, languages and their ridge weights."""

    def __init__(self, labels: list[str], texts: list[str], longest: int, bits: int, landmarks: int, ridge: float, sharp: float):
        self.longest, self.bits, self.sharp = longest, bits, sharp
        sets = [presence(t, longest, bits) for t in texts]
        labels, sets = [x for x, s in zip(labels, sets, strict=True) if len(s)], [s for s in sets if len(s)]
        self.names = sorted(set(labels))
        each = max(1, landmarks // max(1, len(self.names)))
        chosen = [i for name in self.names for i in [k for k, x in enumerate(labels) if x == name][:each]]
        self.table = np.zeros((1 << bits, len(chosen)), np.float32)
        for col, i in enumerate(chosen):
            self.table[sets[i], col] = 1 / np.sqrt(len(sets[i]))
        if not self.names:
            self.weights = np.zeros((0, 0), np.float32)
            return
        rows = self.kernel(sets).astype(np.float64)
        value, vector = np.linalg.eigh(rows[chosen])
        good = value > 1e-6 * value.max()
        half = vector[:, good] / np.sqrt(value[good])
        mapped = rows @ half
        target = np.where(np.array(labels)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        share = np.array([1 / labels.count(x) for x in labels])[:, None]  # languages weigh the same
        solved = np.linalg.solve(mapped.T @ (share * mapped) + ridge * np.eye(mapped.shape[1]), mapped.T @ (share * target))
        self.weights = (half @ solved).astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Batch x landmarks kernel values of non-empty sets."""
        out = np.zeros((len(sets), self.table.shape[1]), np.float32)
        for i, s in enumerate(sets):
            out[i] = self.table[s].sum(0) / np.sqrt(len(s))
        return out

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        sets = [presence(t, self.longest, self.bits) for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, s in enumerate(sets) if len(s)] if self.names else []
        if at:
            raw = (self.kernel([sets[i] for i in at]) @ self.weights).astype(np.float64) * self.sharp
            raw = np.exp(raw - raw.max(1, keepdims=True))
            raw /= raw.sum(1, keepdims=True)
            for i, best, p in zip(at, raw.argmax(1), raw.max(1), strict=True):
                names[i], scores[i] = self.names[best], round(float(p), 6)
        return names, scores


def fold_of(id_col: str, folds: int) -> F.Column:
    """crc32(id as text) mod folds; null ids fall in fold 0 (held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, most_labels: int, folds: int) -> list:
    """About per_label labelled training rows of each of the most frequent labels, the same rows on every run."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    own = own.where(F.col("label").isNotNull() & (fold_of("id", folds) != 0))
    counts = F.broadcast(own.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(1_000_000))
    drawn = own.where("text is not null").join(counts, "label").where(draw < F.lit(1_000_000) * per_label / F.col("count"))
    rows = drawn.select("id", "text", "label").dropDuplicates().collect()
    return sorted(rows, key=lambda r: (r["label"], str(r["id"]), r["text"]))


def learn(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 250, most_languages: int = 256, landmarks: int = 96, longest: int = 4, bits: int = 15, ridge: float = 1e-4, sharp: float = 6.0, folds: int = 5) -> KernelModel:
    rows = sample(docs, id_col, text_col, lang_col, per_language, most_languages, folds)
    return KernelModel([r["label"] for r in rows], [r["text"] for r in rows], longest, bits, max(landmarks, len({r["label"] for r in rows})), ridge, sharp)


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, **options) -> DataFrame:
    """docs' id with held_out, lang_pred, score; one row per input row. options: of learn()."""
    common.ready(spark)
    model = learn(spark, docs, id_col, text_col, lang_col, folds=folds, **options)
    shared = spark.sparkContext.broadcast(model)  # (1 << bits) x landmarks floats: fixed by the parameters

    def score(batches):
        known = shared.value
        for batch in batches:
            names, values = known.score(common.texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), (fold_of(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(common.trimmed(score), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_languages(spark: SparkSession, docs: DataFrame, languages: list[str] | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """docs, all columns, whose predicted language is one of languages (all learned ones if
    None) with at least that score. Texts without a letter (null ones too) go; where there is
    nothing to learn from there is no decision and all rows stay."""
    common.ready(spark)
    model = learn(spark, docs, id_col, text_col, lang_col, **options)
    if not model.names:
        return docs
    shared = spark.sparkContext.broadcast((model, frozenset(model.names if languages is None else languages) - {UNKNOWN}))

    def keep(batches):
        known, wanted = shared.value
        for batch in batches:
            names, scores = known.score(common.texts_of(batch.column(text_col)))
            yield batch.filter(pa.array([x in wanted and s >= least for x, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(common.trimmed(keep), docs.schema)
