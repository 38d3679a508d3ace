"""Stages of the pipeline against brute force."""

import itertools
import random

import corpus_pipeline


def shingles(text, k):
    w = text.split()
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def similar(x, y):
    return len(x & y) / len(x | y)


def planted():
    """Originals of 200 words, each with copies of which a share of the words was replaced."""
    draw, texts = random.Random(5), []
    for i in range(12):
        base = [f"t{i}w{draw.randrange(5_000)}" for _ in range(200)]
        texts.append(base)
        for tail in (10, 20, 22, 30):
            texts.append(base[: 200 - tail] + [f"n{draw.random()}" for _ in range(tail)])
        for edits in (2, 4, 5, 9):
            copy = list(base)
            for at in draw.sample(range(200), edits):
                copy[at] = f"e{draw.random()}"
            texts.append(copy)
    draw.shuffle(texts)
    return [" ".join(words) for words in texts]


def kept(texts, k, percent):
    """The smallest id of each component."""
    sets = [shingles(t, k) for t in texts]
    of = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of]
    return set(of)


def test_near_copies_between_80_and_90_percent_go(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    left = [r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()]
    want = kept(texts, 5, 80)
    assert len(left) == len(set(left)) and set(left) == want and len(want) < len(kept(texts, 3, 90))


def test_copy_with_a_new_end_is_one_group(spark):
    base = [f"w{i}" for i in range(200)]
    one, two = " ".join(base), " ".join(base[:180] + [f"z{i}" for i in range(20)])
    assert 0.8 < similar(shingles(one, 5), shingles(two, 5)) < 0.82 and similar(shingles(one, 3), shingles(two, 3)) < 0.9
    docs = spark.createDataFrame([(2, two), (1, one)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()] == [1]
