"""Ranked search against plain Python, bounds that never fall below scores, and odd rows."""

import collections
import math
import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import lexical
from riskloom.runtime import pin

TERM = re.compile(lexical.TERM)
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most):
    """Every document scored for every item."""
    found = [(i, terms_of(t)) for i, t in docs]
    held = [(i, t, collections.Counter(t)) for i, t in found if t]
    n_docs, length = len(held), sum(len(t) for _, t, _ in held)
    df = collections.Counter(w for _, _, c in held for w in c)
    out = []
    for item, text in items:
        rows = []
        for i, t, c in held:
            m = 50 + (50 * len(t) * n_docs) // length
            score = 0
            for w in set(terms_of(text)):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
            if score > 0:
                rows.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out, key=str)


def made(n, seed=4):
    draw = random.Random(seed)
    vocabulary = [f"{draw.choice(['ab', 'É', 'x9', 'ß'])}{int(draw.paretovariate(0.6)) % 300}" for _ in range(600)]
    return [" ".join(draw.choice(vocabulary) for _ in range(int(draw.paretovariate(0.5)) % 400)) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 7])
def test_equals_scoring_everything(spark, most):
    texts = made(400)
    texts += [texts[0]] * 30 + [None, "", "?! .", "AB1 ab1 Ab1", "a" * 200_000]
    docs = list(enumerate(texts)) + [(None, texts[1]), (None, texts[1]), (3, texts[3]), (5, "ab1")]
    items = [(i, " ".join(t.split()[:40])) for i, t in enumerate(made(12, 5))] + [(3, texts[0]), (3, texts[0]), (None, "AB1, x9"), (20, None), (21, "...")]
    table = spark.createDataFrame([(i, t, 1, i) for i, t in docs], "doc_id bigint, text string, item int, score bigint").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    want = plain(docs, items, most)
    for most_bytes in (lexical.MOST_BYTES, 150):  # in one pass, and in several
        got = lexical.search(table, asked, most, most_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "two")], "item_id bigint, text string")
    assert lexical.search(docs, items).count() == 1
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, spark.createDataFrame([(1, "three")], "item_id bigint, text string"))):
        assert lexical.search(d, i).count() == 0


def test_bounds_are_never_below_scores(monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)
        get = classmethod(lambda cls: cls)

    monkeypatch.setattr(lexical, "TaskContext", Task)
    texts = made(300) + ["ab1 " * n for n in (2, 5, 70, 999)]
    terms = lexical.Terms.of([sorted(set(terms_of(t))) for t in made(20, 9) if terms_of(t)])
    gathered = lexical._Blocks(terms)
    gathered.add(pa.array(range(len(texts))), pa.array(texts))
    blocks = [b.to_pylist()[0] for b in gathered.blocks()]
    found_in = sum(np.array(b["found_in"]) for b in blocks)
    counted = collections.Counter(w for t in texts for w in set(terms_of(t)))
    names = [terms.raw[a:b].tobytes().decode() for a, b in zip(terms.starts, terms.ends, strict=True)]
    assert found_in.tolist() == [counted[n] for n in names]
    corpus = lexical.Corpus.of(found_in, sum(len(b["ids"]) for b in blocks), sum(sum(b["sizes"]) for b in blocks))
    tight = []
    for b in blocks:
        above, exact = lexical.bounds(b, terms, corpus), lexical.scores(pa.array(b["texts"]), np.array(b["sizes"]), terms, corpus)
        assert (above >= exact).all()
        tight.append((above.sum(), exact.sum()))
    assert sum(a for a, _ in tight) < 1.3 * sum(e for _, e in tight)


def test_a_task_keeps_the_first_of_equals():
    best = lexical._Best(2)
    ids, least = np.array([9, 4, 7, 1]), np.array([1, 5])
    best.add(np.array([[5, 5, 5, 0], [4, 9, 9, 8]]), least, ids, ids)
    item, score, kept, _ = best.kept()
    assert list(zip(item.tolist(), score.tolist(), kept.tolist(), strict=True)) == [(0, 5, 4), (0, 5, 7), (1, 9, 4), (1, 9, 7)]


def test_open_documents_of_a_block_are_scored_in_slices(spark, monkeypatch):
    """A block with megabytes of open texts is not hashed whole."""
    text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(i, f"needle {text}") for i in range(30)], "doc_id bigint, text string").coalesce(1)
    terms = lexical.Terms.of([["needle"], ["needle", "w7"]])
    index = pin(lexical.build_index(docs, terms))
    corpus = lexical.Corpus(np.array([5, 9]), 30, 30 * 30_001)
    whole = index.select("block", "width", "ids", "sizes", "slices", "texts").toArrow()
    assert whole.num_rows == 1
    hashed, hashes = [], lexical.words.word_hashes
    monkeypatch.setattr(lexical.words, "word_hashes", lambda raw, *bounds: hashed.append(len(raw)) or hashes(raw, *bounds))
    monkeypatch.setattr(lexical, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    found = list(lexical._not_excluded(terms, corpus, 50, np.ones(2, dtype=np.int64))(iter(whole.to_batches())))
    rows = [r for batch in found for r in batch.to_pylist()]
    assert [(r["item"], r["doc_id"]) for r in rows] == [(i, d) for i in (0, 1) for d in range(30)]
    assert sum(hashed) > 4 * lexical.SLICE and max(hashed) <= lexical.SLICE
