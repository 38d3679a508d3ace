"""Ranked lexical search over bit-sliced signatures, with exact scores.

Documents of similar size share a block.  A block is a matrix of bits with a column per document: each
distinct term sets ``HASHES`` bits of its column, and again for each of the frequencies in ``LEVELS`` that
it reaches.  A row of the matrix is a slice.  For a term, the slices of its bits are joined by "and", which
names every document that has the term (that often), and a few more.  The sum over an item's terms of
weight times the gain of the highest frequency the slices admit is therefore never below a document's score.

A search reads the slices once for the documents of the highest bounds, scores those exactly, and takes
the ``most``-th best score as threshold; then it reads the blocks again and scores exactly every document whose
bound is not below it.  A document that is left out has ``most`` better ones, so the result is that of scoring
everything.  Blocks carry their texts, so nothing but the best of each task is shuffled.

Terms are runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased.  They are found by a 64-bit hash and compared
byte by byte.  The items are a stated set; what a pass takes to the tasks is at most ``MOST_BYTES`` of their terms (or one
item), so many items are answered in several passes.

Defined results: a null or empty text has no terms, is not counted and not found; rows that repeat a doc_id are documents
of their own, as are items that repeat an item_id; a NULL doc_id comes before others of the same score; items without
terms have no result; ids of documents are whole numbers; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import words
from riskloom.runtime import pin

MOST = 50
#: highest bounds scored exactly for a threshold, as a multiple of the results asked for
AHEAD = 4
#: frequencies told apart by signatures
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256)
HASHES, BITS_PER_TERM = 3, 12
#: documents in a block, bytes of text sorted into blocks at once, and bytes hashed at once
BLOCK_ROWS, GROUP_BYTES, SLICE = 256, 8 << 20, 1 << 20
#: blocks handed to a Python worker at once; a block has up to ``GROUP_BYTES`` of text (or one document) and its slices
BLOCKS_AT_ONCE = 8
#: bytes of the items' terms in one pass
MOST_BYTES = 1 << 20

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_STEP = 0xD6E8FEB86659FD93
_NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Terms:
    """The distinct terms of some items: bytes, hashes in rising order, and the terms of each item."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    flat: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, items: Sequence[Sequence[str]]) -> Terms:
        """``items`` have at least one term each."""
        known = sorted({t for terms in items for t in terms})
        raw, offsets = words.buffer(pa.array(known, pa.string()))
        hashes = words.word_hashes(raw, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        if (hashes[order][1:] == hashes[order][:-1]).any():
            raise ValueError("two terms of the items have the same 64-bit hash")
        place = {known[i]: at for at, i in enumerate(order.tolist())}
        flat = np.array([place[t] for terms in items for t in dict.fromkeys(terms)], dtype=np.int64)
        firsts = np.cumsum([0, *(len(set(terms)) for terms in items)])[:-1]
        return cls(raw, offsets[:-1][order], offsets[1:][order], hashes[order], flat, firsts)

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and of the terms they are."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        which = np.flatnonzero((self.hashes[at] == hashes) & (ends - starts == self.ends[at] - self.starts[at]))
        at = at[which]
        sizes = self.ends[at] - self.starts[at]
        if not len(which):
            return which, at
        first = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        equal = raw[np.repeat(starts[which], sizes) + step] == self.raw[np.repeat(self.starts[at], sizes) + step]
        same = np.logical_and.reduceat(equal, first)
        return which[same], at[same]

    def summed(self, gains: np.ndarray) -> np.ndarray:
        """Per item and document the sum of the rows of its terms."""
        out = np.empty((len(self.firsts), gains.shape[1]), dtype=gains.dtype)
        for item, terms in enumerate(np.split(self.flat, self.firsts[1:])):
            gains[terms].sum(axis=0, out=out[item])
        return out


@dataclass(frozen=True)
class Corpus:
    """Weights of the terms, documents with terms, and all their terms."""

    weights: np.ndarray
    documents: int
    length: int

    @classmethod
    def of(cls, found_in: np.ndarray, documents: int, length: int) -> Corpus:
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in found_in]
        return cls(np.array(weights, dtype=np.int64), documents, length)

    def gains(self, frequency: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds by its frequency in documents of so many terms."""
        norm = 50 + (50 * sizes.astype(np.int64) * self.documents) // max(self.length, 1)
        frequency = frequency.astype(np.int64)
        return (1_000_000_000 * frequency) // (1_000 * frequency + 20 * norm)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = words.buffer(texts)
    raw = words.lower_ascii(raw)
    starts, ends, owner = words.word_bounds(raw, offsets, _INSIDE)
    return raw, starts, ends, owner, words.word_hashes(raw, starts, ends)


def _places(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits of terms, by their shortened hashes, at a level: one row per hash function."""
    seeds = words.mix(keys + np.uint64((level + 1) * _STEP % (1 << 64)))
    return np.stack([(words.mix(seeds + np.uint64(i)) % np.uint64(width)).astype(np.int64) for i in range(HASHES)])


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(20)


_BLOCK = "block bigint, width int, ids array<bigint>, sizes array<int>, slices binary, texts array<string>, found_in array<int>"


class _Blocks:
    """Gathers documents, and gives them back as blocks of similar size."""

    def __init__(self, terms: Terms):
        self.terms, self.task, self.made = terms, TaskContext.get().partitionId(), 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.texts, self.sizes, self.owners, self.keys, self.often, self.known, self.bytes = [], [], [], [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        raw, starts, ends, owner, hashes = _tokens(texts)
        sizes = np.bincount(owner, minlength=len(texts))
        which, at = self.terms.find(raw, starts, ends, hashes)
        self.known.append(np.unique((owner[which] + len(self.ids)) * len(self.terms.hashes) + at))
        packed = np.sort((owner.astype(np.uint64) << np.uint64(44)) | _short(hashes))
        new = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, int)
        self.often.append(np.diff(np.r_[new, len(packed)]))
        self.owners.append((packed[new] >> np.uint64(44)).astype(np.int64) + len(self.ids))
        self.keys.append(packed[new] & np.uint64((1 << 44) - 1))
        self.ids += ids.to_pylist()
        self.texts += texts.to_pylist()
        self.sizes.append(sizes)
        self.bytes += len(raw)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """All gathered documents with a term, ordered by what they set, in blocks."""
        if not self.ids:
            return
        sizes, owners, keys, often, known = (np.concatenate(x) for x in (self.sizes, self.owners, self.keys, self.often, self.known))
        levels = np.searchsorted(LEVELS, often, side="right")  # LEVELS reached
        load = np.bincount(owners, weights=levels, minlength=len(sizes)).astype(np.int64)
        order = np.argsort(load, kind="stable")
        order = order[load[order] > 0]
        # a block ends when it is full, or when the next document is half as large again as the first
        first = 0
        rank = np.full(len(sizes), -1, dtype=np.int64)
        while first < len(order):
            last = min(first + BLOCK_ROWS, int(np.searchsorted(load[order], 1.5 * load[order[first]], side="right")))
            members = order[first:last]
            rank[members] = np.arange(len(members))
            mine = rank[owners] >= 0
            columns, names, reached = rank[owners[mine]], keys[mine], levels[mine]
            width = max(64, BITS_PER_TERM * int(load[members[-1]]))
            bits = np.zeros((width, len(members)), dtype=bool)
            for level in range(int(reached.max())):
                have = reached > level
                for places in _places(names[have], level, width):
                    bits[places, columns[have]] = True
            here = known[rank[known // len(self.terms.hashes)] >= 0] % len(self.terms.hashes)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(self.task << 32) + self.made], pa.int64()), "width": pa.array([width], pa.int32()),
                "ids": pa.array([[self.ids[i] for i in members]], pa.list_(pa.int64())),
                "sizes": pa.array([sizes[members].tolist()], pa.list_(pa.int32())),
                "slices": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
                "texts": pa.array([[self.texts[i] for i in members]], pa.list_(pa.string())),
                "found_in": pa.array([np.bincount(here, minlength=len(self.terms.hashes)).tolist()], pa.list_(pa.int32())),
            })
            rank[members] = -1
            self.made += 1
            first = last
        self.clear()


def build_index(docs: DataFrame, terms: Terms) -> DataFrame:
    """Blocks of signatures with their documents, and in how many of a block's documents each of ``terms`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Blocks(terms)
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                gathered.add(part.column("doc_id"), part.column("text"))
                if gathered.bytes >= GROUP_BYTES:
                    yield from gathered.blocks()
        yield from gathered.blocks()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row per term found (and -1: documents, -2: their terms)."""
    total, documents, length = 0, 0, 0
    for batch in batches:
        for sizes, found in zip(batch.column("sizes"), batch.column("found_in"), strict=True):
            own = sizes.values.to_numpy()
            documents, length = documents + len(own), length + int(own.sum(dtype=np.int64))
            total = total + found.values.to_numpy().astype(np.int64)
    if documents:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*total[at].tolist(), documents, length], pa.int64())], names=["term", "n"])


def corpus_of(index: DataFrame, terms: Terms) -> Corpus:
    """Counts over all documents; the driver gets one row per term of the items."""
    counted = index.select("sizes", "found_in").mapInArrow(_added_up, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in counted}
    found_in = np.array([counts.get(i, 0) for i in range(len(terms.hashes))])
    return Corpus.of(found_in, counts.get(-1, 0), counts.get(-2, 0))


def bounds(block: dict, terms: Terms, corpus: Corpus) -> np.ndarray:
    """Per item and document of a block a number that the score does not exceed."""
    sizes, width = np.asarray(block["sizes"], dtype=np.int64), block["width"]
    n = len(sizes)
    slices = np.frombuffer(block["slices"], dtype=np.uint8).reshape(width, -1)
    keys, rows = _short(terms.hashes), np.arange(len(terms.hashes))
    gains, before = np.zeros((len(keys), n), dtype=np.int64), np.zeros(n, dtype=np.int64)
    admitted = None
    for level in range(len(LEVELS)):
        joined = np.bitwise_and.reduce([slices[p] for p in _places(keys[rows], level, width)], axis=0)
        admitted = joined if admitted is None else admitted & joined
        some = admitted.any(axis=1)
        rows, admitted = rows[some], admitted[some]
        if not len(rows):
            break
        most = sizes if level + 1 == len(LEVELS) else np.minimum(sizes, LEVELS[level + 1] - 1)
        gain = corpus.gains(most, sizes)
        gains[rows] += np.unpackbits(admitted, axis=1, count=n) * (gain - before)
        before = gain
    return terms.summed(gains * corpus.weights[:, None])


def scores(texts: pa.Array, sizes: np.ndarray, terms: Terms, corpus: Corpus) -> np.ndarray:
    """Exact scores per item and document."""
    raw, starts, ends, owner, hashes = _tokens(texts)
    which, at = terms.find(raw, starts, ends, hashes)
    n = len(texts)
    often = np.bincount(at * n + owner[which], minlength=len(terms.hashes) * n).reshape(-1, n)
    gains = np.zeros(often.shape, dtype=np.int64)
    at, column = np.nonzero(often)
    gains[at, column] = corpus.gains(often[at, column], sizes[column]) * corpus.weights[at]
    return terms.summed(gains)


class _Best:
    """The best rows of each item, by falling score and then rising id."""

    def __init__(self, most: int):
        self.most, self.rows, self.size = most, [], 0

    def add(self, found: np.ndarray, least: np.ndarray, ids: np.ndarray, more: np.ndarray) -> None:
        item, column = np.nonzero(found >= least[:, None])
        self.rows.append((item, found[item, column], ids[column], more[column]))
        self.size += len(item)
        if self.size > 500_000:
            self.rows, self.size = [self.kept()], 0
            self.size = len(self.rows[0][0])

    def kept(self) -> tuple[np.ndarray, ...]:
        item, score, ids, more = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.most]
        return tuple(x for x in (np.concatenate(y)[order] for y in zip(*self.rows, strict=True)))

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            item, score, ids, more = self.kept()
            part = np.full(len(item), TaskContext.get().partitionId() % 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID),
                 pa.array(more, pa.int64()), pa.array(part, pa.int32())],
                names=["item", "score", "doc_id", "more", "part"],
            )


_FOUND = "item int, score bigint, doc_id bigint, more bigint, part int"


def _ids(values: Sequence[int | None]) -> np.ndarray:
    return np.array([_NO_ID if v is None else v for v in values], dtype=np.int64)


def _highest_bounds(terms: Terms, corpus: Corpus, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = _Best(most), np.ones(len(terms.firsts), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                n = len(block["sizes"])
                best.add(bounds(block, terms, corpus), least, np.arange(n), np.full(n, block["block"]))
        yield from best.batch()

    return run


def _scored(terms: Terms, corpus: Corpus, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = _Best(most), np.ones(len(terms.firsts), dtype=np.int64)
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                for first in range(0, part.num_rows, BLOCK_ROWS):
                    few = part.slice(first, BLOCK_ROWS)
                    ids, sizes = _ids(few.column("doc_id").to_pylist()), few.column("size").to_numpy()
                    best.add(scores(few.column("text"), sizes, terms, corpus), least, ids, np.zeros(len(ids), int))
        yield from best.batch()

    return run


def _not_excluded(terms: Terms, corpus: Corpus, most: int, least: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(most)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = row.select(["block", "width", "sizes", "slices"]).to_pylist()[0]
                open_ = np.flatnonzero((bounds(block, terms, corpus) >= least[:, None]).any(axis=0))
                if not len(open_):
                    continue
                ids, sizes = _ids(row.column("ids")[0].as_py())[open_], np.asarray(block["sizes"])[open_]
                texts = pa.RecordBatch.from_arrays([row.column("texts")[0].values.take(pa.array(open_))], names=["text"])
                first = 0
                for part in words.slices(texts, "text", SLICE):
                    few = slice(first, first + part.num_rows)
                    best.add(scores(part.column("text"), sizes[few], terms, corpus), least, ids[few], np.zeros(part.num_rows, int))
                    first = few.stop
        yield from best.batch()

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The best rows of each item, first among parts of the tasks and then among those."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "more"]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= most)


def _search(docs: DataFrame, terms: Terms, most: int) -> DataFrame:
    spark = docs.sparkSession
    with words.small_batches(spark):
        index = pin(build_index(docs, terms))
    with words.small_batches(spark, BLOCKS_AT_ONCE):
        corpus = corpus_of(index, terms)
        slices = index.select("block", "width", "sizes", "slices")
        high = _merged(slices.mapInArrow(_highest_bounds(terms, corpus, AHEAD * most), _FOUND), AHEAD * most)
        wanted = high.groupBy(F.col("more").alias("block")).agg(F.collect_set("doc_id").alias("columns"))  # at most ``AHEAD * most`` rows an item
        wanted = pin(wanted)
    with words.small_batches(spark):
        few = index.select("block", "ids", "sizes", "texts").join(F.broadcast(wanted), "block").select(
            F.explode("columns").alias("column"), "ids", "sizes", "texts"
        ).select(*(F.get(c, F.col("column").cast("int")).alias(n) for c, n in (("ids", "doc_id"), ("sizes", "size"), ("texts", "text"))))
        sure = _merged(few.mapInArrow(_scored(terms, corpus, most), _FOUND), most).filter(F.col("rank") == most).select("item", "score").collect()
    least = np.ones(len(terms.firsts), dtype=np.int64)
    for row in sure:  # at most one an item
        least[row["item"]] = row["score"]
    whole = index.select("block", "width", "ids", "sizes", "slices", "texts")
    with words.small_batches(spark, BLOCKS_AT_ONCE):
        return pin(_merged(whole.mapInArrow(_not_excluded(terms, corpus, most, least), _FOUND), most))


def search(docs: DataFrame, items: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per row of ``items`` (item_id, text) its ``most`` documents of highest score above 0.

    Columns: item_id, rank (from 1), doc_id, score.
    """
    spark = docs.sparkSession
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = pin(items.select("item_id", found.alias("terms"), F.monotonically_increasing_id().alias("salt")).filter(F.size("terms") > 0))
    size = asked.select(F.sum(F.octet_length(F.concat_ws(" ", "terms")))).first()[0] or 0
    passes = max(1, -(-size // most_bytes))
    answers = []
    for number in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("salt"), F.lit(passes)) == number)
        rows = own.orderBy(F.col("item_id").asc_nulls_first(), "salt").select("item_id", "terms").collect()  # about most_bytes
        if rows:
            best = _search(docs, Terms.of([r["terms"] for r in rows]), most)
            shape = f"item int, item_id {items.schema['item_id'].dataType.simpleString()}"
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], shape)
            answers.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not answers:
        return items.select("item_id", *(F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")))).limit(0)
    whole = answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    return whole


SQL = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
), docs AS (
  SELECT doc_id, doc, terms, len(terms) AS n FROM words WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs
), asked AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))) AS term
  FROM (SELECT *, row_number() OVER () AS item FROM benchmark)
), often AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(t.docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM often CROSS JOIN totals t GROUP BY term
), scored AS (
  SELECT a.item, a.item_id, o.doc, o.doc_id,
    CAST(sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 20 * (50 + (50 * o.n * t.docs) // t.total)))) AS BIGINT) AS score
  FROM asked a JOIN often o ON o.term = a.term JOIN weights w ON w.term = a.term CROSS JOIN totals t GROUP BY a.item, a.item_id, o.doc, o.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {MOST}
"""
