"""Token counts of every prefix of every text, for questions about budgets and cuts.

The tokens are those of a byte-pair model file of the sentencepiece library.  Let ``last(i)`` be
the last token of the encoding of the first i characters.  Whatever tokens stand before it are the
encoding of what stands before it, since merges on one side of a token border do not depend on
the other side; and two neighbours of an encoding are also what their joint text alone is encoded as.
So ``last(i)`` is the only piece t that ends at i and forms such a pair with ``last(i - len(t))``,
and the count at i is that at ``i - len(t)`` plus one.  Characters the model does not know
count as their UTF-8 bytes.  A text falls apart wherever two neighbouring characters are
neighbours in no piece; counts of such runs are kept for the next text that holds them.

``prefix_counts`` stores, per row, the change of the count with every character.  From it
``count_at``, ``truncated`` and ``with_budget`` answer without a tokenizer: the count at a prefix, the
longest prefix within a budget (counts may fall as well as rise with a character, so it is the last
prefix that fits, not the one before the first that does not) and whether a text goes over a limit.

Defined results: null and empty texts have no tokens; special strings in a text are plain text;
rows that repeat an id, or have none, are counted one by one; other columns pass
through; column names that begin with ``__`` are reserved; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.words import slices

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4_096
#: bytes of text worked on at a time; runs kept, and the longest run that is kept
SLICE, MOST_RUNS, LONGEST_RUN = 256 << 10, 150_000, 48
_SPACE = "▁"


class Runs(dict):
    """Run of characters -> the changes of its token count, as bytes of 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" aé  ") != f"{_SPACE * 2}aé{_SPACE * 2}" or model.encode("<0x41>") == [model.piece_to_id("<0x41>")]:
            raise ValueError("counts at prefixes need a model that keeps characters as they are")
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.scores))
        known = sorted({c for piece in self.scores for c in piece})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.joined = np.zeros((len(known) + 1, len(known) + 1), dtype=bool)
        for piece in self.scores:
            if len(piece) > 1:
                at = self.number[[ord(c) for c in piece]]
                self.joined[at[:-1], at[1:]] = True
        self.reach: dict[str, int] = {}
        for piece in self.scores:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text, merge by merge: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: str, token: str) -> bool:
        """Whether the two tokens stand side by side in an encoding; ``before`` may be empty."""
        found = self.pairs.get((before, token))
        if found is None:
            if len(self.pairs) >= 8 * MOST_RUNS:
                self.pairs.clear()
            found = self.pairs[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return found

    def steps(self, run: str) -> list[int]:
        """The change of the number of tokens with every character of ``run``."""
        last, count, steps = [""], [0], []
        scores, pairs, reach = self.scores, self.pairs, self.reach
        for end in range(1, len(run) + 1):
            # no piece that ends like this is longer
            start = max(0, end - reach.get(run[end - 2:end], 1)) if end > 1 else 0
            while True:
                token = run[start:end]
                known = token in scores
                if known or end - start == 1:
                    before = last[start]
                    fits = pairs.get((before, token))
                    if fits or (fits is None and self.follows(before, token)):
                        break
                start += 1
            total = count[start] + (1 if known else len(token.encode()))
            last.append(token)
            steps.append(total - count[-1])
            count.append(total)
        return steps

    def __missing__(self, run: str) -> bytes:
        found = array("i", self.steps(run)).tobytes()
        if len(run) <= LONGEST_RUN:
            if len(self) >= MOST_RUNS:
                self.clear()
            self[run] = found
        return found

    def changes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Changes of the count with every character of all texts, and where each text ends."""
        framed = [_SPACE + t.replace(" ", _SPACE) if t else "" for t in texts]
        whole = "".join(framed)
        ends = np.cumsum([len(t) for t in framed])
        number = self.number[np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)]
        apart = np.ones(len(number) + 1, dtype=bool)
        apart[1:-1] = ~self.joined[number[:-1], number[1:]]
        apart[ends] = True
        cuts = np.flatnonzero(apart).tolist()
        steps = np.frombuffer(b"".join([self[whole[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]), dtype=np.int32).copy()
        # the character put before each text is no prefix of its own
        firsts = np.r_[0, ends[:-1]][[bool(t) for t in texts]] if len(texts) else np.zeros(0, int)
        steps[firsts + 1] += steps[firsts]
        return np.delete(steps, firsts), np.cumsum([len(t) for t in texts])


@lru_cache(maxsize=1)
def _runs(path: str | None) -> Runs:
    import public_tokenizers

    return Runs(path or public_tokenizers.path(VOCABULARY))


def _stored(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                plain = part.column("text").fill_null("")
                steps, ends = runs.changes(plain.to_pylist())
                small = steps.astype(np.int8)
                stored, totals, first = [], [], 0
                for end in ends.tolist():
                    own = slice(first, end)
                    totals.append(int(steps[own].sum()))
                    stored.append((small if np.array_equal(small[own], steps[own]) else steps)[own].tobytes())
                    first = end
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pc.binary_length(plain.cast(pa.large_binary())).cast(pa.int64()),
                     pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(totals, pa.int64()), pa.array(stored, pa.binary())],
                    names=[*part.schema.names, "__n_bytes", "__n_chars", "__n_tokens", "__steps"],
                )

    return run


def _added(df: DataFrame, work: Callable, **columns: T.DataType) -> DataFrame:
    return df.mapInArrow(work, T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in columns.items())]))


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``__n_bytes``, ``__n_chars`` (code points), ``__n_tokens`` and ``__steps``.

    ``__steps`` holds the change of the token count with every code point: one signed byte
    each, or four (little-endian) where a change does not fit one.  ``path`` is a model file that every worker can read.
    """
    added = {"__n_bytes": T.LongType(), "__n_chars": T.LongType(), "__n_tokens": T.LongType(), "__steps": T.BinaryType()}
    return _added(docs, _stored(path), **added)


def counts_of(steps: bytes, n_chars: int) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... ``n_chars`` code points."""
    wide = len(steps) == 4 * n_chars and n_chars > 0
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype="<i4" if wide else np.int8), dtype=np.int64)])


def _answers(answer: Callable[[np.ndarray, object], int], given: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(given).to_pylist() if given else [None] * batch.num_rows
            found = [
                answer(counts_of(steps.as_py(), n), x)
                for steps, n, x in zip(batch.column("__steps"), batch.column("__n_chars").to_pylist(), asked, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "__answer"])

    return run


def count_at(index: DataFrame, n_chars: Column, name: str) -> DataFrame:
    """Token count of the first ``n_chars`` code points (of all, if there are fewer; NULL for NULL)."""
    asked = index.withColumn("__asked", n_chars.cast("long"))
    work = _answers(lambda counts, n: None if n is None else int(counts[min(max(n, 0), len(counts) - 1)]), "__asked")
    return _added(asked, work, __answer=T.LongType()).drop("__asked").withColumnRenamed("__answer", name)


def with_budget(index: DataFrame, budget: int, name: str) -> DataFrame:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    work = _answers(lambda counts, _: int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else None, None)
    return _added(index, work, __answer=T.LongType()).withColumnRenamed("__answer", name)


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """``docs`` with every text cut to its longest prefix of at most ``budget`` tokens."""
    cut = with_budget(prefix_counts(docs, path), budget, "__cut")
    text = F.when(F.col("__cut") < F.col("__n_chars"), F.substring(F.col("text"), F.lit(1), F.col("__cut").cast("int"))).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(*docs.columns)


def count_report(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Per document: bytes, tokens, whether it goes over ``limit``, and the code points that do not."""
    index = prefix_counts(docs.select("doc_id", "text"), path).select("doc_id", "__n_bytes", "__n_chars", "__n_tokens", "__steps")
    return with_budget(index, limit, "chars_in_limit").select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_tokens").alias("n_tokens"),
        (F.col("__n_tokens") > limit).alias("over_limit"), "chars_in_limit",
    )
