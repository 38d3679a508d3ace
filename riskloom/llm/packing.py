"""Cost-balanced packing of documents into sequences of a fixed token capacity.

Every document is encoded and ended by one separator id.  Full-length pieces are sequences of
their own; what remains of each document is packed with others: documents are dealt into
groups of bounded size by a hash, and within a group the remainders go, longest first, to the
sequence of lowest cost that has room, where a piece costs ``linear * n + quadratic * n**2``.
A group has just enough sequences for its tokens; a remainder that fits nowhere is cut into the
sequence with most room.  So all sequences of a group together lack fewer than ``capacity`` tokens.

Encoding uses the tiktoken form of the vocabulary, whose ids equal those of the tokenizers file
(the tests compare them), also where a text holds one of the file's added tokens; a text it
refuses is encoded by the tokenizers library.

Defined results: a null or empty text is the separator alone, one piece of length 1; rows that
repeat an id are documents of their own; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
SEPARATOR = 0
#: documents per packing group; bounds what one task holds (at most CAPACITY ids each)
GROUP_ROWS = 8_192
LINEAR, QUADRATIC = 1.0, 1 / 6144  # attention against the rest of a layer of width 1,024

VOCABULARY = "byte_bpe_50k"
_PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
)
_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids, by a public vocabulary; an added token of its file in a text is one id."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        # such a token splits the text wherever it stands; one that takes in its surroundings is left to the library
        plain = {t["content"]: t["id"] for t in added if not any(t[x] for x in ("single_word", "lstrip", "rstrip", "normalized"))}
        others = [t["content"] for t in added if t["content"] not in plain]
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=plain)

        def encode(text: str) -> list[int]:
            if any(token in text for token in others):
                return slow_encoder(vocabulary)(text)
            try:
                if any(token in text for token in plain):
                    return fast.encode(text, allowed_special="all")
                return fast.encode_ordinary(text)
            except BaseException as refused:  # the library's panic is no Exception
                if isinstance(refused, (KeyboardInterrupt, SystemExit)):
                    raise
                return slow_encoder(vocabulary)(text)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def slow_encoder(vocabulary: str = VOCABULARY):
    """The same ids by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    return lambda text: plain.encode(text, add_special_tokens=False).ids


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoded(vocabulary: str, capacity: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                rows = []
                for text in part.column("text"):
                    ids = np.array([*encode(text.as_py() or ""), separator], dtype=np.uint32)
                    whole = len(ids) // capacity * capacity
                    sums = [checksum(ids[i: i + capacity]) for i in range(0, whole, capacity)]
                    rest = ids[whole:]
                    small = rest.astype("<u2") if len(rest) == 0 or rest.max() < 65_536 else rest.astype("<u4")
                    rows.append((len(ids), sums, small.tobytes(), small.itemsize, checksum(rest)))
                n, sums, rest, width, check = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64())),
                     pa.array(rest, pa.binary()), pa.array(width, pa.int32()), pa.array(check, pa.int64())],
                    names=["doc_id", "doc_tokens", "sums", "rest", "width", "rest_sum"],
                )

    return run


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, from, length, sequence, offset) of items given longest first.

    Open sequences with room for the present item wait in a heap by cost, the others in one
    by room, since they can take later, shorter items.
    """
    n_sequences = math.ceil(sum(lengths) / capacity)
    room = [capacity] * n_sequences
    cost = [0.0] * n_sequences
    ready = [(0.0, s) for s in range(n_sequences)]  # by cost; those without room are moved when met
    tight: list[tuple[int, int]] = []  # by room, largest first
    pieces = []
    for item, length in enumerate(lengths):
        while tight and -tight[0][0] >= length:
            _, s = heapq.heappop(tight)
            heapq.heappush(ready, (cost[s], s))
        while ready and room[ready[0][1]] < length:
            _, s = heapq.heappop(ready)
            heapq.heappush(tight, (-room[s], s))
        at = 0
        while at < length:  # more than one turn only if nothing has room for all of it
            s = heapq.heappop(ready)[1] if ready else heapq.heappop(tight)[1]
            take = min(room[s], length - at)
            pieces.append((item, at, take, s, capacity - room[s]))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            at += take
            if room[s]:
                heapq.heappush(tight, (-room[s], s))
    return pieces


def _packed(capacity: int, groups: int, linear: float, quadratic: float):
    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["rest_length", "doc_id", "doc_tokens", "rest_sum"], ascending=[False, True, True, True])
        out, filled = [], 0
        docs = list(zip(table["doc_id"], table["doc_tokens"], table["sums"], table["rest"], table["width"], strict=True))
        for doc_id, tokens, sums, _, _ in docs:
            for i, check in enumerate(sums):
                out.append((doc_id, i * capacity, capacity, check, tokens, filled, 0))
                filled += 1
        with_rest = [d for d in docs if d[3]]
        ids = [np.frombuffer(d[3], dtype=f"<u{d[4]}") for d in with_rest]
        for item, at, n, s, offset in assign([len(x) for x in ids], capacity, linear, quadratic):
            doc_id, tokens, sums, _, _ = with_rest[item]
            out.append((doc_id, len(sums) * capacity + at, n, checksum(ids[item][at: at + n]), tokens, filled + s, offset))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        pieces = pd.DataFrame(out, columns=names)
        pieces["doc_id"] = pieces["doc_id"].astype("Int64")
        pieces["sequence_id"] = pieces["sequence_id"] * groups + int(key[0])
        return pieces

    return run


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR,
    group_rows: int = GROUP_ROWS, linear: float = LINEAR, quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: where it comes from in its document and where it lies in its sequence."""
    groups = max(1, math.ceil(docs.count() / group_rows))
    encoded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _encoded(vocabulary, capacity, separator),
        "doc_id bigint, doc_tokens bigint, sums array<bigint>, rest binary, width int, rest_sum bigint",
    )
    dealt = encoded.withColumn("rest_length", (F.length("rest") / F.col("width")).cast("bigint")).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "rest_sum"), F.lit(groups))
    )
    return dealt.groupBy("group").applyInPandas(_packed(capacity, groups, linear, quadratic), _PIECES)
