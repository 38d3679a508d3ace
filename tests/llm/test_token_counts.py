"""Counts at prefixes against the sentencepiece library."""

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import queries, tokencounts

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(tokencounts.VOCABULARY)
ODD = [
    None, "", " ", "  a  b ", "a\nb\tc", "<s>hi</s><unk>", "<0x41>", "ﬁ①Ａ", "a▁b", "▁", "a\u0000b", "é é", "​ x", "x﻿y", "\r\n",
    "日本語のテキスト", "😀😀 and", " " * 40 + "x", "the the", "Token" * 300,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def runs():
    return tokencounts.Runs(PATH)


def test_query_equals_the_library(spark, library):
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    found = queries.QUERIES["op13_token_counts"](spark, FOLDER).collect()
    assert len(found) == len(texts) and any(r["over_limit"] for r in found)
    for r in found:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
        if r["over_limit"]:
            assert len(library.encode(text[: r["chars_in_limit"]])) <= 4096 < len(library.encode(text[: r["chars_in_limit"] + 1]))
        else:
            assert r["chars_in_limit"] == len(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("aeinrst ▁\n.THE<0x>19é日"), st.characters(codec="utf-8")), max_size=40))
def test_every_prefix(text):
    library, runs = _both()
    steps, ends = runs.changes(["", text, text])
    counts = tokencounts.counts_of(steps[: ends[1]].astype("<i4").tobytes(), len(text)).tolist()
    assert counts == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    assert steps[ends[1]:].tolist() == steps[: ends[1]].tolist()


_kept = []


def _both():
    if not _kept:
        _kept.append((sentencepiece.SentencePieceProcessor(model_file=PATH), tokencounts.Runs(PATH)))
    return _kept[0]


def test_runs_of_one_character_and_long_texts(library, runs):
    for text in ("x" * 50_000, " " * 30_000, "ab" * 20_000, "=" * 9_999 + "é" * 9_999):
        assert runs.changes([text])[0].sum() == len(library.encode(text))


def test_questions_without_encoding(spark, library):
    rows = [(i, t, 5, "x") for i, t in enumerate(ODD)] + [(None, "no id", 2, None), (3, ODD[3], None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, n_tokens string")
    index = tokencounts.prefix_counts(docs)
    at = {(r["doc_id"], r["n"]): (r["text"], r["found"]) for r in tokencounts.count_at(index, F.col("n"), "found").collect()}
    assert len(at) == len(rows)
    for (_, n), (text, found) in at.items():
        assert found == (None if n is None else len(library.encode((text or "")[:n])))
    for budget in (0, 3, 7):
        cut = tokencounts.truncated(docs, budget)
        assert cut.schema.simpleString() == docs.schema.simpleString()
        for r, (i, text, *_) in zip(sorted(cut.collect(), key=str), sorted(rows, key=lambda r: str(spark_row(r, budget, library))), strict=True):
            best = longest(text, budget, library)
            assert r["doc_id"] == i and r["text"] == best
    assert tokencounts.count_report(docs.limit(0)).count() == 0


def longest(text, budget, library):
    if text is None:
        return None
    return text[: max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= budget)]


def spark_row(row, budget, library):
    from pyspark.sql import Row

    return Row(doc_id=row[0], text=longest(row[1], budget, library), n=row[2], n_tokens=row[3])


def test_wide_steps_are_stored_whole(monkeypatch, spark):
    monkeypatch.setattr(tokencounts.Runs, "steps", lambda self, run: [300] * len(run))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc", ""])})
    (out,) = tokencounts._stored(PATH)(iter([batch]))
    assert tokencounts.counts_of(out.column("__steps")[0].as_py(), 3).tolist() == [0, 600, 900, 1200]
    assert out.column("__n_tokens").to_pylist() == [1200, 0]
    tokencounts._runs.cache_clear()
