"""Quality classifier by compression.

Two zstandard dictionaries are trained from bounded samples of good and of bad labelled
texts. A text is cut into pieces of ``piece`` bytes (the whole text, so its length does not
matter), every piece is compressed with each dictionary, and two normalised differences of the
summed sizes, ``(bad - good) / (bad + good)`` and ``(good - raw) / (good + raw)``, go through
a logistic curve that was fitted on sampled texts outside the dictionaries and moved to the
label share of the data. Size of pieces and dictionaries is the one of ``OPTIONS`` with the least
log loss on a third part of the sample; rows outside the training folds take no part in it.

Only labelled rows whose crc32(id as text) mod ``folds`` is not 0 are learned from, at
most about ``per_label`` ids of each label (a documented bound, drawn by a hash of the id). An id
with several labels has the one of most rows (1 in a tie), an id with several texts the
smallest. Null and empty texts get the share of good labels as score; with one label or none
every text gets it. Any number of texts of both labels makes a model: where a label has fewer
than three, they serve in every part. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common
from quillward.llm.language_id import fold_of


#: Bytes of a piece and of a dictionary.
OPTIONS = [(512, 32768), (1024, 32768), (512, 65536), (2048, 65536)]


class CompressionModel:
    def __init__(self, good: list[str], bad: list[str], share: float, options: list[tuple[int, int]], level: int):
        """share: of good labels in the data; the samples need not have it."""
        self.level, self.share = level, min(max(share, 1e-4), 1 - 1e-4)
        self.dicts: list[bytes] = []
        self.beta = np.zeros(4)
        if not good or not bad:
            return
        part = lambda texts, k: texts[k::3] or texts
        tried = []
        for piece, size in options:
            self.piece = piece
            self.dicts = [self.dictionary([p for t in part(x, 0) for p in self.pieces(t)], size) for x in (good, bad)]
            self.__dict__.pop("tools", None)
            (fit_good, fit_bad), (try_good, try_bad) = ([[self.inputs(t) for t in part(x, k)] for x in (good, bad)] for k in (1, 2))
            loss = self.loss(self.fit(fit_good, fit_bad), try_good, try_bad)
            tried.append((loss, len(tried), piece, self.dicts, self.fit(fit_good + try_good, fit_bad + try_bad)))
        _, _, self.piece, self.dicts, self.beta = min(tried, key=lambda x: x[:2])
        self.__dict__.pop("tools", None)

    @staticmethod
    def dictionary(parts: list[bytes], size: int) -> bytes:
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            return b"".join(parts)[-size:]

    @staticmethod
    def loss(beta: np.ndarray, good: list[list[float]], bad: list[list[float]]) -> float:
        """Mean log loss, both labels weighing the same."""
        return float(sum(np.logaddexp(0, sign * np.clip(np.array(x) @ beta, -30, 30)).mean() for sign, x in ((-1, good), (1, bad))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def pieces(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        return [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]

    def gaps(self, text: str) -> tuple[float, float]:
        """Two normalised differences of compressed sizes: bad and good dictionary (above 0 where
        the good one fits better), and how far the good one is from a text's own redundancy."""
        if not hasattr(self, "tools"):
            self.tools = []
            for d in self.dicts:
                own = zstandard.ZstdCompressionDict(d)
                own.precompute_compress(level=self.level)
                self.tools.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False))
        sizes, raw = [0, 0], 0
        for part in self.pieces(text):
            raw += len(part)
            for k, tool in enumerate(self.tools):
                sizes[k] += len(tool.compress(part))
        return (sizes[1] - sizes[0]) / max(1, sizes[0] + sizes[1]), (sizes[0] - raw) / max(1, sizes[0] + raw)

    def inputs(self, text: str) -> list[float]:
        fit, dense = self.gaps(text)
        return [fit, dense, dense * dense, 1.0]

    def fit(self, good: list[list[float]], bad: list[list[float]]) -> np.ndarray:
        """Logistic weights by damped Newton steps, both labels weighing the same, with a small ridge."""
        m = np.array(good + bad)
        y = np.array([1.0] * len(good) + [0.0] * len(bad))
        w = np.where(y > 0, 0.5 / len(good), 0.5 / len(bad))
        ridge = np.array([1e-6] * (m.shape[1] - 1) + [0.0])
        beta = np.zeros(m.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
            grad = m.T @ (w * (y - p)) - ridge * beta
            hess = m.T @ (m * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-7)
            beta = beta + np.clip(np.linalg.solve(hess, grad), -5, 5)
        return beta

    def score(self, text: str) -> float:
        if not text or not self.dicts:
            return round(self.share, 6)
        z = float(np.dot(self.beta, self.inputs(text))) + math.log(self.share / (1 - self.share))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, folds: int, options: list[tuple[int, int]], level: int) -> CompressionModel:
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold_of("id", folds) != 0))
    own = own.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if not counts:
        return CompressionModel([], [], 0.5, options, level)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, 1 + 1_000_000 * per_label // n))])
    drawn = own.where(draw < limit[F.col("label")])  # about 2 * per_label ids
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    rows = sorted(texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect(), key=lambda r: r["id"])
    share = counts.get(1, 0) / sum(counts.values())
    return CompressionModel([r["text"] for r in rows if r["label"] == 1], [r["text"] for r in rows if r["label"] == 0], share, options, level)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 500, folds: int = 5, options: list[tuple[int, int]] = OPTIONS, level: int = 3, threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs. options: sizes of pieces and dictionaries to choose from."""
    common.ready(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, per_label, folds, options, level))

    def rows(batches):
        model = shared.value
        for batch in batches:
            score = [model.score(t) for t in common.texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), (fold_of(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(common.trimmed(rows), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
