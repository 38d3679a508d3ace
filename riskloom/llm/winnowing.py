"""Document fingerprints by winnowing.

A text's k-gram hashes are taken over its code points; in every window of ``w`` consecutive
hashes the smallest is chosen, the rightmost of equal ones, and chosen places are kept with their
hash.  Two texts that share a passage of at least ``w + k - 1`` code points share a fingerprint.

``edited_report`` compares every document with an edited form of itself (its second half replaced
by the beginning of the next document) and with the next document.  For that, documents are dealt
into ranges of ids and ordered there; the first document of each range also goes to the range
before, so one shuffle brings all neighbours together.

Defined results: a null text is empty; an empty text has no fingerprints; a text shorter than k
has one, of the whole text, and one with fewer than ``w`` hashes has one window; the likeness of two
texts is the share of common among all their distinct hashes, 1 if both have none; the order
of documents is by id, then by a digest of the text, null ids last, so repeated ids and rows have
a place of their own; the last is followed by the first, a single one by itself; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import mix

K, W = 16, 32
#: code points worked on at a time; one longer text is worked on alone
SLICE_CHARS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each place on, built up by doubling."""
    out, done, power = None, 0, np.uint64(1)
    block, size, base = points, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if k >> (size.bit_length() - 1) & 1:
                if out is None:
                    out, done = block, size
                else:
                    n = min(len(out), len(block) - done)
                    out, done = out[:n] * base + block[done: done + n], done + size
                if done == k:
                    return mix(out[: max(0, len(points) - k + 1)] + power)
            block = block[:-size] * base + block[size:] if len(block) > size else block[:0]
            size, base = size * 2, base * base


def _chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest hash, rightmost if equal, of the window from each place on."""
    value, place, size = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        right = value[step:] <= value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        size += step
    return place


def fingerprints(texts: list[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of each text, in order of place."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    hashes = _gram_hashes(points, k) if len(points) >= k else points[:0]
    windows = _chosen(hashes, w) if len(hashes) >= w else np.zeros(0, dtype=np.int32)
    out, start = [], 0
    for text in texts:
        n = len(text)
        grams = n - k + 1
        if grams >= w:
            at = windows[start: start + grams - w + 1]
            at = at[np.r_[True, at[1:] != at[:-1]]]
            out.append((hashes[at], at - start))
        elif grams > 0:
            own = hashes[start: start + grams]
            at = grams - 1 - int(np.argmin(own[::-1]))
            out.append((own[at: at + 1], np.array([at])))
        elif n:
            whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8]
            out.append((np.frombuffer(whole, dtype=np.uint64), np.array([0])))
        else:
            out.append((points[:0], np.zeros(0, dtype=int)))
        start += n
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of common hashes among all distinct ones."""
    x, y = np.unique(x), np.unique(y)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return common / (len(x) + len(y) - common)


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Fingerprints as place:hash, comma-joined; the hash by its upper 32 bits."""
    return ",".join(f"{p}:{h:08x}" for p, h in zip(found[1].tolist(), (found[0] >> np.uint64(32)).tolist(), strict=True))


def _compared(k: int, w: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows_of(docs: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in docs]
        after = [*texts[1:], following]
        edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
        own, changed = fingerprints([*texts, following], k, w), fingerprints(edited, k, w)
        rows = [
            (doc, len(t), hashlib.sha256(e.encode()).hexdigest(), written(own[i]), written(changed[i]),
             likeness(own[i][0], changed[i][0]), likeness(own[i][0], own[i + 1][0]))
            for i, ((doc, t), e) in enumerate(zip(docs, edited, strict=True))
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, part, closed = [], 0, None, False
        for batch in batches:
            columns = (batch.column(c) for c in ("range", "guest", "doc_id", "text"))
            for own, guest, doc, text in zip(*columns, strict=True):
                own, guest, text = own.as_py(), guest.as_py(), text.as_py() or ""
                if own != part:
                    part, closed = own, False
                if closed:
                    continue  # a guest's twin
                if guest or size > SLICE_CHARS:
                    if waiting:
                        yield rows_of(waiting, text)
                    waiting, size = [], 0
                    closed = guest
                if not guest:
                    waiting.append((doc.as_py(), text))
                    size += len(text)

    return run


def edited_report(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to that and to the next document."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "digest", F.md5("text")
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    splits = [-math.inf, *sorted(set(cuts or [0.0])), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="place", outputCol="range", handleInvalid="keep").transform(
        keyed.withColumn("place", F.col("doc_id").cast("double"))
    ).drop("place").withColumn("range", F.coalesce("range", F.lit(float(len(splits)))))  # null ids have a range of their own
    first = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "digest")).alias("first"))
    heads = [(r["range"], r["first"]["doc_id"], r["first"]["digest"]) for r in sorted(first.collect(), key=lambda r: r["range"])]
    before = [(heads[i - 1][0], doc, digest) for i, (_, doc, digest) in enumerate(heads)]
    hosts = spark.createDataFrame(before, "host double, h_doc bigint, h_digest string")
    guests = ranged.join(
        F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("digest") == F.col("h_digest"))
    ).select(F.col("host").alias("range"), F.lit(True).alias("guest"), "doc_id", "digest", "text")
    everyone = ranged.select("range", F.lit(False).alias("guest"), "doc_id", "digest", "text").unionByName(guests)
    lined_up = everyone.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_last(), "digest")
    return lined_up.select("range", "guest", "doc_id", "text").mapInArrow(
        _compared(k, w),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
