"""Toxicity scores from a linear classifier over character n-grams scaled by log-count ratios.

A text is lower-cased, its white space runs become one space, and a space is put around it.
Its features are the distinct character n-grams (hashed into 2**bits slots).  On labelled
training rows each feature's log-count ratio r is the smoothed share of toxic documents' features
over that of the others; a logistic regression is fitted on the features scaled by r, and a
text scores sigmoid(bias + sum of weight * r over its distinct features).

The fit is bounded: at most ``most_rows`` labelled rows (those first in the order of a hash of
their id) are read, whatever the table's size.  Features in fewer than ``least_docs`` of them, or
with |r| below ``least_ratio``, weigh nothing.  All documents are scored, whole.

Defined results: null and empty texts have no features and score sigmoid(bias); labels that are
null are no labels, repeated ones count as toxic if any says so; without rows of both classes, or without a telling feature, every
text scores the share of toxic rows (0 without labels); rows that repeat an id are scored
one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.words import slices, small_batches
from riskloom.runtime import pin

BITS = 20
GRAMS = (4, 5, 6)
MOST_ROWS = 12_000
LEAST_DOCS = 4
LEAST_RATIO = 2.0
SMOOTHING = 1.0
PENALTY = 1e-3
FOLDS = 5
#: partitions of the bounded training sample, and blocks of its feature counts
PARTS, BLOCKS = 16, 64
#: bytes of text whose n-grams are hashed at a time
SLICE = 256 << 10

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Model:
    """A weight per slot, the bias, and the score without a fit."""

    weights: np.ndarray
    bias: float
    constant: float | None
    grams: tuple[int, ...]
    bits: int


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether the checksum of the id is 0 modulo ``folds``; such rows are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def distinct_grams(texts: pa.Array, grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> Iterator[np.ndarray]:
    """The slots of each text's distinct character n-grams."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"\s+", " ")
    framed = pc.binary_join_element_wise(pa.scalar(" ", plain.type), plain, pa.scalar(" ", plain.type), pa.scalar("", plain.type))
    points = np.frombuffer("".join(framed.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(pc.utf8_length(framed).to_numpy(zero_copy_only=False))
    hashed, rolled = [], points.copy()
    for n in range(2, max(grams) + 1):
        rolled = rolled[:-1] * _STEP + points[n - 1:]
        if n in grams:
            hashed.append((((rolled ^ (rolled >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int32))
    last = np.zeros(1 << bits, dtype=np.int32)
    first = 0
    for end in ends:
        slots = np.concatenate([h[first: max(first, end - n + 1)] for n, h in zip(grams, hashed, strict=True)])
        order = np.arange(len(slots), dtype=np.int32)
        last[slots] = order
        yield slots[last[slots] == order]
        first = end


def _counts(bits: int, grams: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((2, 1 << bits), dtype=np.int32), [0, 0]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for label, slots in zip(part.column("toxic").to_pylist(), distinct_grams(part.column("text"), grams, bits), strict=True):
                    sums[label][slots] += 1
                    rows[label] += 1
        if any(rows):
            blocks = sums.reshape(2 * BLOCKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(2 * BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()),
                 pa.array([rows[i // BLOCKS] if i % BLOCKS == 0 else 0 for i in range(2 * BLOCKS)], pa.int64())],
                names=["block", "counts", "n_rows"],
            )

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, total, rows = 0, 0, 0
    for batch in batches:
        for b, counts, n in zip(*(batch.column(c).to_pylist() for c in ("block", "counts", "n_rows")), strict=True):
            block, total, rows = b, total + np.frombuffer(counts, dtype=np.int32).astype(np.int64), rows + n
    yield pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([rows], pa.int64())],
        names=["block", "counts", "n_rows"],
    )


def training_sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Labelled texts outside the held-out fold, at most ``most_rows`` labels."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most_rows)
    ids = F.broadcast(chosen.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")))  # at most most_rows rows
    return pin(docs.select("doc_id", "text").join(ids, "doc_id").select("toxic", "text").repartition(PARTS))


def fit(
    docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, grams: tuple[int, ...] = GRAMS, bits: int = BITS,
    least_docs: int = LEAST_DOCS, least_ratio: float = LEAST_RATIO, smoothing: float = SMOOTHING, penalty: float = PENALTY,
) -> Model:
    """The classifier; what the driver gathers is two counts and one weight per slot."""
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, most_rows, grams, bits, least_docs, least_ratio, smoothing, penalty)


def _fit(
    docs: DataFrame, labels: DataFrame, most_rows: int, grams: tuple[int, ...], bits: int, least_docs: int, least_ratio: float,
    smoothing: float, penalty: float,
) -> Model:
    sample = training_sample(docs, labels, most_rows)
    summed = sample.mapInArrow(_counts(bits, grams), "block int, counts binary, n_rows bigint").groupBy("block").applyInArrow(
        _add_blocks, "block int, counts binary, n_rows bigint"
    ).collect()
    size = 1 << bits
    if not summed:
        return Model(np.zeros(size, np.float32), 0.0, 0.0, grams, bits)
    summed.sort(key=lambda r: r["block"])
    clean, toxic = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in summed]).reshape(2, size)
    n_clean, n_toxic = (sum(r["n_rows"] for r in summed if r["block"] // BLOCKS == k) for k in (0, 1))
    if not n_clean or not n_toxic:
        return Model(np.zeros(size, np.float32), 0.0, n_toxic / (n_clean + n_toxic), grams, bits)
    p, q = toxic + smoothing, clean + smoothing
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    kept = np.flatnonzero((toxic + clean >= least_docs) & (np.abs(ratio) >= least_ratio))
    if not len(kept):
        return Model(np.zeros(size, np.float32), 0.0, n_toxic / (n_clean + n_toxic), grams, bits)
    place = np.full(size, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = [place[s][place[s] >= 0] for s in distinct_grams(part.column("text"), grams, bits)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic").cast(pa.float64()), pa.array([f.astype(str).tolist() for f in found], pa.list_(pa.string()))],
                    names=["label", "found"],
                )

    # the features are put together by the JVM, so that no second pool of Python workers is needed for vectors
    named = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(kept))], "found", "present", binary=True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio[kept]), inputCol="present", outputCol="features")
    rows = pin(scaled.transform(named.transform(sample.mapInArrow(telling, "label double, found array<string>"))).select("label", "features"))
    fitted = LogisticRegression(maxIter=40, regParam=penalty, standardization=False).fit(rows)
    weights = np.zeros(size, dtype=np.float32)
    weights[kept] = fitted.coefficients.toArray() * ratio[kept]
    return Model(weights, float(fitted.intercept), None, grams, bits)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if model.constant is not None:
                    scores = np.full(part.num_rows, model.constant)
                else:
                    sums = [float(model.weights[s].sum(dtype=np.float64)) for s in distinct_grams(part.column("text"), model.grams, model.bits)]
                    scores = 1 / (1 + np.exp(-np.clip(np.array(sums) + model.bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(scores)], names=[*part.schema.names, "__score"])

    return run


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the column ``__score``; all columns pass through unchanged."""
    shape = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(_scores(model), shape)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below ``threshold``."""
    return with_score(docs, fit(docs, labels, **options)).filter(F.col("__score") < threshold).drop("__score")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Per document: whether its label was withheld, its score, and the class at ``threshold``."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )
