"""Jaccard join of documents on word n-gram sets, with prefix, length, positional and suffix filters.

A document's set is its distinct runs of ``k`` words (A-Z lower-cased, words between white
space); a shorter text is one run.  Two documents link when ``100 * |x & y| >= percent * |x | y|``.

1. Documents with equal sets form a class, known by a 128-bit digest; from here on one document
   stands for its class, so copies cost nothing.
2. All n-grams get one order, rarest first: by an upper bound of their count, ties by hash.  The bound is
   the smallest of their count in a table of 2**26 slots and of the counts of their words in one of 2**23, both
   summed over all documents (their size is fixed).  Each class is indexed under its prefix, the first
   ``n - ceil(percent * n / 100) + 1`` n-grams, without which no partner can have enough in common.  An n-gram
   whose bound is 1 is in no other document and does not enter the index.
3. Candidates share a prefix n-gram and pass filters on the lengths, on the positions of the shared
   n-gram, on how many of their prefix n-grams are in no other prefix (those of the set whose prefix
   ends earlier are not in its partner), and on the sizes of the parts into which a hash cuts both
   sets (the differences add up to a lower bound of what the sets do not share: the suffix filter).
4. Every class is first compared with the most connected class of each of its n-grams.  What this
   links needs no more comparisons with each other, so a large group of near copies costs one
   comparison per member; then all pairs are joined that are not yet in one component.  Each pair is
   verified once, on whole sets.

Defined results: texts that are null or without words have an empty set, no class and no links,
and are their own component; rows that repeat an id are rows of their own, linked if their sets
are; a null id never names a component unless all its ids are null; other columns are ignored
(``drop_near_copies`` returns them unchanged); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import words
from riskloom.llm.spread import components, lookup
from riskloom.runtime import pin

K = 3
PERCENT = 90
SLOT_BITS, WORD_BITS = 26, 23
#: counts of a task are kept up to this; a slot that reaches it counts as frequent
MOST = 255
#: levels of counts, half a binary order apart; the lowest is a count of 1, the highest one of 128 or more
ONCE, TOP = 0, 14
BLOCKS = 256
#: bytes of text worked on at a time
SLICE = 512 << 10
#: parts of a set whose sizes the suffix filter compares
PARTS = 32
#: pairs from an n-gram of more classes pass the suffix filter in the join, others after it
SMALL_GROUP = 32
#: an n-gram of a level up to this one is in a bounded group of rows
COLD_LEVEL = TOP - 1
#: bits of the map that tells which documents' sets are wanted; one bit set by chance costs only work
MAP_BITS = 23


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted within each text, and where each text's begin and end."""
    grams, ends, _ = _marked_sets(part, k)
    return grams, ends


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    raw, offsets = words.buffer(part.column("text"))
    raw = words.lower_ascii(raw)
    starts, ends, owner = words.word_bounds(raw, offsets, words.PLAIN)
    return words.word_hashes(raw, starts, ends), owner


def _marked_sets(part: pa.RecordBatch, k: int, word_levels: np.ndarray | None = None, found=None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """As ``_sets``, with the lowest level among each n-gram's words (that of a shorter text's run is the highest there is)."""
    hashes, owner = _words(part) if found is None else found
    grams, of = words.shingles(hashes, owner, k)
    marks = None
    if word_levels is not None:
        level = _level_of(word_levels, _word_slots(hashes))
        marks = np.full(len(grams), 255, dtype=np.uint8)
        if len(hashes) >= k:
            lowest = np.minimum.reduce([level[j: len(level) - k + 1 + j] for j in range(k)])
            lowest = lowest[owner[: len(lowest)] == owner[k - 1:]]
            marks[: len(lowest)] = lowest  # runs of shorter texts stand at the end
    order = np.argsort(of, kind="stable")  # texts of one run stand at the end
    grams, of = grams[order], of[order]
    ends = np.searchsorted(of, np.arange(part.num_rows + 1))
    if marks is None:
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            grams[a:b].sort()
    else:
        marks = marks[order]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = np.argsort(grams[a:b])
            grams[a:b], marks[a:b] = grams[a:b][own], marks[a:b][own]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.r_[0, np.cumsum(new)][ends], None if marks is None else marks[new]


def _digests(grams: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """128 bits that tell sets apart; None for an empty set."""
    one, two = words.mix(grams), words.mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    return [
        np.array([one[a:b].sum(), two[a:b].sum() + np.uint64(b - a)], dtype=np.uint64).tobytes() if b > a else None
        for a, b in zip(ends[:-1], ends[1:], strict=True)
    ]


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _word_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _count(table: np.ndarray, slots: np.ndarray) -> None:
    at, n = np.unique(slots, return_counts=True)
    table[at] = np.minimum(table[at] + n, MOST)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << SLOT_BITS) + (1 << WORD_BITS), dtype=np.uint8)
        by_gram, by_word = counts[: 1 << SLOT_BITS], counts[1 << SLOT_BITS:]
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                found = _words(part)
                grams, ends, _ = _marked_sets(part, k, found=found)
                _count(by_gram, _slots(grams))
                _count(by_word, _word_slots(found[0]))
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(_digests(grams, ends), pa.binary()),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc_id", "n", "cls", "block", "counts"],
                )
        if counts.any():
            blocks = [_packed(b) for table in (by_gram, by_word) for b in table.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(2 * BLOCKS, pa.int64()), pa.nulls(2 * BLOCKS, pa.int64()), pa.nulls(2 * BLOCKS, pa.binary()),
                 pa.array(range(2 * BLOCKS), pa.int32()), pa.array(blocks, pa.binary())],
                names=["doc_id", "n", "cls", "block", "counts"],
            )

    return run


def _packed(counts: np.ndarray) -> bytes:
    """Which slots were counted, and the counts of those."""
    some = counts > 0
    return zlib.compress(np.packbits(some).tobytes() + counts[some].tobytes(), 1)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    some = np.unpackbits(raw[: size // 8]).view(bool)
    counts = np.zeros(size, dtype=np.int64)
    counts[some] = np.where(raw[size // 8:] == MOST, 1 << 21, raw[size // 8:].astype(np.int64))
    return counts


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block of slots, summed and brought to a logarithmic scale of half a byte."""
    block, total = 0, np.zeros(1)
    for batch in batches:
        for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            block, total = b, total + _unpacked(counts, (1 << (SLOT_BITS if b < BLOCKS else WORD_BITS)) // BLOCKS)
    level = np.minimum(TOP, np.floor(2 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress((level[0::2] | level[1::2] << 4).tobytes(), 1)], pa.binary())], names=["block", "level"])


def _table(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(b), dtype=np.uint8) for b in blocks])


def _level_of(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Levels of slots, two of which share a byte."""
    return (table[slots >> 1] >> ((slots & 1) << 2).astype(np.uint8)) & 15


def _prefixes(k: int, percent: int, packed: list[bytes], cold_level: int):
    """``packed``: the levels of all blocks of n-gram slots, then those of word slots, as the driver keeps them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, word_levels = _table(packed[:BLOCKS]), _table(packed[BLOCKS:])
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                grams, ends, marks = _marked_sets(part, k, word_levels)
                sizes = np.diff(ends)
                of = np.repeat(np.arange(part.num_rows), sizes)
                level = np.minimum(_level_of(levels, _slots(grams)), marks)
                keep = np.where(sizes > 0, sizes - (-(-sizes * percent // 100)) + 1, 0)
                rarest = [a + np.argsort(level[a:b], kind="stable")[:m] for a, b, m in zip(ends[:-1], ends[1:], keep, strict=True)]
                rarest = np.concatenate(rarest)
                pos = np.arange(len(rarest)) - np.repeat(np.cumsum(keep) - keep, keep)
                cold = np.bincount(of[rarest], weights=level[rarest] <= cold_level, minlength=part.num_rows)
                shared = level[rarest] > ONCE
                rarest, pos = rarest[shared], pos[shared]
                first = grams[rarest].view(np.int64)
                held = pa.array(np.r_[0, np.cumsum(np.bincount(of[rarest], minlength=part.num_rows))], pa.int32())
                cut = ((grams >> np.uint64(7)) % np.uint64(PARTS)).astype(np.int64) + of * PARTS
                parts = np.minimum(np.bincount(cut, minlength=part.num_rows * PARTS), 32_767).astype(np.int16)
                some = pa.array(sizes > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(_digests(grams, ends), pa.binary()),
                     pa.ListArray.from_arrays(held, pa.array(first)), pa.ListArray.from_arrays(held, pa.array(pos, pa.int32())),
                     pa.array(keep, pa.int32()), pa.array(cold.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * PARTS, pa.int32()), pa.array(parts))],
                    names=["doc_id", "n", "digest", "prefix", "places", "indexed", "cold", "parts"],
                ).filter(some)

    return run


def _whole_sets(k: int, wanted: np.ndarray):
    """Whole sets of the documents whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted[_bits(batch.column("doc_id"))]))
            for part in words.slices(some, "text", SLICE):
                grams, ends = _sets(part, k)
                rows = [
                    (doc, cls, grams[ends[i]: ends[i + 1]].tobytes())
                    for i, (doc, cls) in enumerate(zip(part.column("doc_id").to_pylist(), _digests(grams, ends), strict=True))
                    if cls is not None
                ]
                if rows:
                    docs, classes, members = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(classes, pa.binary()), pa.array(members, pa.binary())],
                        names=["doc_id", "of", "members"],
                    )

    return run


def _bits(docs: pa.Array) -> np.ndarray:
    """Bits of the ids; null shares that of 0."""
    ids = docs.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return (words.mix(ids) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _map_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    for batch in batches:
        bits[_bits(batch.column("first_doc"))] = True
    at = np.flatnonzero(bits.reshape(1 << (MAP_BITS - 16), -1).any(axis=1))
    packed = np.packbits(bits).reshape(1 << (MAP_BITS - 16), -1)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[i].tobytes() for i in at], pa.binary())], names=["page", "bits"])


def _join_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page, bits = 0, np.zeros(1 << 13, dtype=np.uint8)
    for batch in batches:
        for p, b in zip(batch.column("page").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            page, bits = p, bits | np.frombuffer(b, dtype=np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["page", "bits"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x_members"), batch.column("y_members"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[place] == y).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _need(percent: int) -> Column:
    """What sets of these sizes must share."""
    return F.ceil(percent * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))


def _may_link(percent: int) -> Column:
    """Length and positional filter between x and y, and that by unshared prefix n-grams."""
    n, m, need = F.col("x.n"), F.col("y.n"), _need(percent)
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & (F.least(n - F.col("x.pos"), m - F.col("y.pos")) >= need)
        & (F.greatest(n - F.col("x.alone"), m - F.col("y.alone")) >= need)
    )


def _parts_agree(percent: int) -> Column:
    """Suffix filter between x and y."""
    unshared = reduce(lambda a, b: a + b, [F.abs(F.col("x.parts")[i] - F.col("y.parts")[i]).cast("int") for i in range(PARTS)])
    return unshared <= F.col("x.n") + F.col("y.n") - 2 * _need(percent)


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    def side(key: str, name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(key), F.struct("n", "parts").alias(name))

    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").filter(_parts_agree(percent)).select("a", "b")


def near_groups(docs: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, cls) and classes (cls, component_id, keep_cls, n_docs)."""
    with words.small_batches(docs.sparkSession):
        return _near_groups(docs, k, percent)


def _near_groups(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = pin(texts.mapInArrow(_signed(k), "doc_id bigint, n bigint, cls binary, block int, counts binary"))
    rows = signed.filter("block IS NULL").select("doc_id", "n", "cls")
    blocks = signed.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(
        _levels, "block int, level binary"
    ).collect()  # at most half of 2**26 and 2**23 bytes, whatever the input
    none = [zlib.compress(bytes((1 << bits) // BLOCKS // 2), 1) for bits in (SLOT_BITS, WORD_BITS)]
    packed = [none[0]] * BLOCKS + [none[1]] * BLOCKS
    for row in blocks:
        packed[row["block"]] = bytes(row["level"])
    del blocks

    shaped = texts.mapInArrow(
        _prefixes(k, percent, packed, COLD_LEVEL),
        "doc_id bigint, n int, digest binary, prefix array<bigint>, places array<int>, indexed int, cold int, parts array<smallint>"
    )
    classes = pin(shaped.groupBy("digest").agg(  # equal sets have equal prefixes and parts
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.any_value("n").alias("n"),
        F.any_value("prefix").alias("prefix"), F.any_value("places").alias("places"), F.any_value("indexed").alias("indexed"),
        F.any_value("cold").alias("cold"), F.any_value("parts").alias("parts"),
    ).withColumn("cls", F.monotonically_increasing_id()))  # short names, fixed once written
    links = _links(texts, classes, k, percent)
    labels = components(links).select(F.col("v").alias("cls"), "label")
    named = pin(classes.select("cls", "digest", "first_doc", "n_docs").join(labels, "cls", "left").drop("cls").withColumnRenamed("digest", "cls"))
    last = F.lit(2**63 - 1)
    per_label = pin(named.filter("label IS NOT NULL").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("first_doc").alias("component_id"),
        F.min(F.struct(F.coalesce("first_doc", last).alias("doc"), F.col("cls").alias("cls")))["cls"].alias("keep_cls"),
    ))
    grouped = lookup(named.filter("label IS NOT NULL"), per_label, ["label"], "n_classes").select("cls", "component_id", "keep_cls", "n_docs")
    alone = named.filter("label IS NULL").select("cls", F.col("first_doc").alias("component_id"), F.col("cls").alias("keep_cls"), "n_docs")
    return rows, pin(grouped.unionByName(alone))


def _links(texts: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) of classes that give the components of all links."""
    index = classes.select("cls", "n", "cold", F.inline(F.arrays_zip(F.col("places").alias("pos"), F.col("prefix").alias("gram"))))
    cold, hot = index.filter("pos < cold").drop("cold"), index.filter("pos >= cold").drop("cold")
    counted = cold.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("m > 1")
    shared = hot.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    postings = pin(counted.unionByName(hot.join(shared, "gram")))
    degree = postings.groupBy("cls").agg(F.sum(F.col("m") - 1).alias("degree"), F.count(F.lit(1)).alias("shared"))
    alone = (F.col("indexed") - F.col("shared")).cast("int").alias("alone")
    postings = pin(postings.join(degree.join(classes.select("cls", "indexed"), "cls").select("cls", "degree", alone), "cls"))

    centre = postings.groupBy("gram").agg(
        F.max(F.struct("degree", "cls", "n", "pos", "alone")).alias("top"), F.count(F.lit(1)).alias("rows")
    )
    beside = lookup(postings, pin(centre), ["gram"], "rows").select(
        F.struct("cls", "n", "pos", "alone").alias("x"), F.col("top").alias("y")
    )
    pairs = beside.filter(F.col("x.cls") != F.col("y.cls")).filter(_may_link(percent)).select(
        F.col("y.cls").alias("a"), F.col("x.cls").alias("b")
    ).distinct()
    first = pin(_filtered(pairs, classes, percent))
    found = pin(_verify(first, _sets_of(texts, classes, first, k), percent))

    labels = components(found).select(F.col("v").alias("cls"), "label")
    marked = pin(postings.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    open_grams = marked.groupBy("gram").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("gram")
    left = pin(marked.join(open_grams, "gram", "left_semi").select("gram", "m", "cls", "label", "n", "pos", "alone"))
    apart = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") < F.col("y.label")) & _may_link(percent)
    ends = [F.col("x.cls").alias("a"), F.col("y.cls").alias("b")]
    small = left.filter(F.col("m") <= SMALL_GROUP)
    few = _filtered(small.alias("x").join(small.alias("y"), apart).select(*ends).distinct(), classes, percent)
    large = left.filter(F.col("m") > SMALL_GROUP).join(classes.select("cls", "parts"), "cls")
    many = large.alias("x").join(large.alias("y"), apart & _parts_agree(percent)).select(*ends)
    rest = few.unionByName(many).distinct()
    both = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = pin(rest.join(both, ["a", "b"], "left_anti"))
    more = pin(_verify(rest, _sets_of(texts, classes, rest, k), percent))
    return found.unionByName(more)


def _sets_of(texts: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Whole sets of the classes in ``pairs``: a bit map of fixed size goes to all tasks, which
    compute the sets of documents that may be wanted; a join keeps those that are."""
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = pin(named.join(classes.select("cls", "digest", "first_doc"), "cls"))
    pages = wanted.select("first_doc").mapInArrow(_map_bits, "page int, bits binary").groupBy("page").applyInArrow(
        _join_pages, "page int, bits binary"
    ).collect()  # 2**MAP_BITS bits at most
    packed = np.zeros((1 << (MAP_BITS - 16), 1 << 13), dtype=np.uint8)
    for row in pages:
        packed[row["page"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    bits = np.unpackbits(packed.reshape(-1)).view(bool)
    found = texts.mapInArrow(_whole_sets(k, bits), "doc_id bigint, of binary, members binary")
    exact = found.join(wanted, (found["of"] == wanted["digest"]) & found["doc_id"].eqNullSafe(wanted["first_doc"]))
    return exact.select("cls", "members").dropDuplicates(["cls"])  # dealt by class, as the joins that follow need it


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    y = sets.select(F.col("cls").alias("b"), F.col("members").alias("y_members"))
    x = sets.select(F.col("cls").alias("a"), F.col("members").alias("x_members"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x_members", "y_members").mapInArrow(_verified(percent), "a bigint, b bigint")


def near_report(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per document: the size of its set and the smallest id that links lead to."""
    rows, classes = near_groups(docs, k, percent)
    linked = lookup(rows.filter("cls IS NOT NULL"), classes.drop("keep_cls"), ["cls"], "n_docs")
    alone = rows.filter("cls IS NULL").select("doc_id", "n", "cls", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _tagged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                grams, ends = _sets(part, k)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(_digests(grams, ends), pa.binary())], names=[*part.schema.names, "__cls"]
                )

    return run


def drop_near_copies(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id."""
    _, classes = near_groups(docs, k, percent)
    keep = classes.filter("cls = keep_cls").select(F.col("component_id").alias("__doc"), F.col("keep_cls").alias("__keep"))
    tagged = docs.mapInArrow(_tagged(k), T.StructType([*docs.schema.fields, T.StructField("__cls", T.BinaryType())]))
    some = tagged.filter("__cls IS NOT NULL")
    kept = some.join(keep, (some["__cls"] == keep["__keep"]) & some["doc_id"].eqNullSafe(keep["__doc"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__cls"]).unionByName(tagged.filter("__cls IS NULL")).drop("__cls")
