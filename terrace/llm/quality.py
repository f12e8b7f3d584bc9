"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks of ``BLOCK`` bytes, so that the dictionary and not the
text's own past explains each block, and every block is compressed with either
dictionary. The difference of the two sizes, normalised by the text's own, is all the
evidence; a logistic calibration fitted on labelled texts that the dictionaries have
not seen turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024
LEVEL = 3
DICT_BYTES = 110 << 10
#: Bound of the training sample: labelled documents of each class.
DOCS_PER_CLASS = 2000
#: A dictionary is made from up to so many blocks of all those of its class's sample, a hundred times its own size.
DICT_BLOCKS = 100 * DICT_BYTES // BLOCK
#: Of each class's sample, the part that makes the dictionary; the rest calibrates.
DICT_SHARE = 0.65
THRESHOLD = 0.7


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


@dataclass
class CompressionModel:
    """Dictionaries of both classes and the calibration's weights; a few hundred kilobytes at most."""

    good: bytes = b""
    bad: bytes = b""
    mean: float = 0.0
    scale: float = 1.0
    weights: tuple = ()
    base_rate: float = 0.5

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        bare = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **bare) for d in (self.good, self.bad)]

    def score(self, differences: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(differences), self.base_rate)
        z = self.weights[0] + self.weights[1] * (differences - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def differences(texts: list[bytes | None], compressors) -> np.ndarray:
    """Normalised compressed-size difference of each text: above 0 where the dictionary of good text fits better."""
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        blocks = _blocks(text or b"")
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
        out[i] = (bad - good) / max(len(text or b""), 1)
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    g, w = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(g @ w, -30, 30)))
        step = np.linalg.solve(g.T @ (g * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), g.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id, of: int = 4, remainder: int = 2):
    """Column: the row's label is kept away from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, held=held_out) -> CompressionModel:
    """Fit dictionaries and calibration on a bounded sample of the labelled documents not held out.

    The sample takes the ``docs_per_class`` labels of smallest hash of each class. A
    dictionary is made from all blocks of its part of the sample or, where they are
    more than ``DICT_BLOCKS``, from those of smallest hash. Documents labelled both
    ways are left out, as are rows beyond the sample's size where many share an id.
    Class counts, which set the base rate, are taken over all labels that are not held
    out.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return CompressionModel(base_rate=rate)
    draw = F.xxhash64("doc_id", F.lit("sample"))
    picked = [known.where(F.col("quality") == q).orderBy(draw, "doc_id").limit(docs_per_class).select("doc_id", "quality") for q in (0, 1)]
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) < 1000 * DICT_SHARE, "dict").otherwise("fit")
    sample = picked[0].union(picked[1]).withColumn("part", part)
    # At most 2 * docs_per_class rows, so the broadcast is bounded.
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")

    # Rows may share a doc_id: as many as labels are taken, in the order of the texts' hashes.
    of_text = F.xxhash64("text")
    texts = texts.orderBy(of_text, "doc_id", "quality").limit(2 * docs_per_class)

    def cut(batches):
        for batch in batches:
            parts = [_blocks(text or b"") for text in batch.column(0).to_pylist()]
            own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array([b for p in parts for b in p], pa.binary()), batch.column(1).take(pa.array(own))], ["block", "quality"])

    blocks = texts.where("part = 'dict'").select("text", "quality").mapInArrow(cut, "block binary, quality int")
    drawn = [blocks.where(F.col("quality") == q).orderBy(F.xxhash64("block"), "block").limit(DICT_BLOCKS) for q in (1, 0)]
    rows = [[bytes(r.block) for r in d.collect()] for d in drawn]
    made = []
    for blocks in rows:
        try:
            made.append(zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes())
        except zstandard.ZstdError:  # too few texts to train on: the texts themselves serve as the dictionary
            made.append(b"".join(blocks)[-DICT_BYTES:] or b"\0" * 8)
    model = CompressionModel(*made, base_rate=rate)

    def measure(batches):
        made = model.compressors()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(differences(batch.column(0).to_pylist(), made)), batch.column(1)], ["x", "quality"])

    fit = texts.where("part = 'fit'").select("text", "quality").mapInArrow(measure, "x double, quality int").collect()
    fit.sort(key=lambda r: (r.quality, r.x))
    y = np.array([r.quality for r in fit], float)
    if len(set(y)) < 2:
        return CompressionModel(base_rate=rate)
    x = np.array([r.x for r in fit])
    mean, scale = float(x.mean()), float(x.std()) + 1e-9
    share = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weights = _fit_logistic((x - mean) / scale, y, share * len(y) / share.sum())
    model.mean, model.scale, model.weights = mean, scale, tuple(weights)
    return model


def score(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns ``score`` (0 to 1, higher: good likelier) and ``predicted`` (1 if at least ``threshold``).

    Every whole text is scored by itself, so rows never meet. Defined cases: a null
    text is scored as the empty one; repeated rows score alike; an empty table gives
    an empty result; a column of ``docs`` called ``score`` or ``predicted`` is
    replaced. Labels, language, source and id are not looked at.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*rest).schema.add("score", T.DoubleType(), False).add("predicted", T.IntegerType(), False)

    def run(batches):
        made = model.compressors() if model.weights else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            p = model.score(differences(texts, made) if made else np.zeros(len(texts)))
            columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.select(*rest).mapInArrow(run, schema)
