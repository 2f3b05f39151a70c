"""Quality by compression: how much better the good dictionary than the bad one packs a text.

Two zstandard dictionaries are trained on labelled good and bad text. A text is cut into windows of ``window``
bytes (all of it); each is compressed with either dictionary. The normalised difference
``(bad - good) / (bad + good)`` of the summed sizes, with the plain compression ratio beside it (junk that repeats
itself is small under both), is turned into a probability by logistic calibration on labelled rows.

Bounds, as parameters: at most ``SAMPLE`` labelled rows of a class, and ``common.SAMPLE_BYTES`` of text, are read for
the model; near copies of one label (by fingerprints of their whole texts) count once. Every text is scored whole. Labels, ids, languages and sources are no inputs of a score.

Defined results: null or empty text gets the calibrated score of a zero difference at ratio 1; with no labelled
rows of either class every score is 0.5; repeated rows give equal scores; empty tables give empty results; filtering judges every row by its own text and
keeps all columns as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, held_out, labelled_sample, slices
from .simhash import distinct_texts

SAMPLE, WINDOW, LEVEL, DICT_BYTES = 1500, 2048, 3, 112_640


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    window: int = WINDOW
    level: int = LEVEL


class Scorer:
    """Holds the prepared compressors of a model; one for each task."""

    def __init__(self, model: QualityModel):
        self.model = model
        self.pair = []
        for raw in (model.good, model.bad):
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=model.level)
                self.pair.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(normalised difference, log of the good size over the raw one, their product)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw or len(self.pair) < 2:
            return 0.0, 0.0, 0.0
        w, (g, b) = self.model.window, self.pair
        pieces = [raw[k : k + w] for k in range(0, len(raw), w)]
        good = sum(len(g.compress(p)) - 6 for p in pieces)
        bad = sum(len(b.compress(p)) - 6 for p in pieces)
        d = (bad - good) / (bad + good + 8)
        r = math.log((good + 8) / (len(raw) + 8))
        return d, r, d * r

    def score(self, text: str | None) -> float:
        if len(self.pair) < 2:
            return 0.5
        z = self.model.weights[0] + sum(w * x for w, x in zip(self.model.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) by Newton's method; both classes count alike in the intercept's favour of neither."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary from the windows of the texts; raw text serves where there is too little to train on."""
    pieces = [raw[k : k + 512] for t in texts for raw in (t.encode("utf-8", "surrogatepass"),) for k in range(0, len(raw), 512)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Dictionaries from one half of the sample, calibration on the other, so that it sees texts as new ones look.

    Lines that several texts of the sample share are left out of the dictionaries; scores read whole texts.
    """
    rows = labelled_sample(docs, labels, label, {0: sample, 1: sample}, id_col, text_col)
    rows = distinct_texts([(t, y) for t, y in rows if t])  # near copies in both halves would flatter the calibration
    halves = [[(t, y) for k, (t, y) in enumerate(rows) if k % 2 == h] for h in (0, 1)]
    # lines that several texts share (boilerplate, quoted passages) say nothing of quality and would fill a dictionary
    seen = Counter(line for t, _ in rows for line in set(t.split("\n")))
    own = [(" ".join(line for line in t.split("\n") if seen[line] == 1), y) for t, y in halves[0]]
    good, bad = ([t for t, y in own if y == c and t] for c in (1, 0))
    if not good or not bad:
        return QualityModel(b"", b"", (0.0, 0.0, 0.0, 0.0))
    room = min(sum(len(t) for t in good), sum(len(t) for t in bad))
    size = max(4096, min(DICT_BYTES, room // 8))
    model = QualityModel(_dictionary(good, size), _dictionary(bad, size), (0.0, 0.0, 0.0, 0.0))
    s = Scorer(model)
    held = halves[1] if len({y for _, y in halves[1]}) == 2 else rows
    w = logistic(np.array([s.features(t) for t, _ in held]), np.array([y for _, y in held], float))
    return QualityModel(model.good, model.bad, tuple(map(float, w)))


def scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in batches:
            got = [s.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["id", "score"])

    return fields(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, score double")


def predictions(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scored = scores(docs, model, id_col, text_col)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``: one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in slices(batches):
            yield b.filter(pa.array([s.score(t.as_py()) >= threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
