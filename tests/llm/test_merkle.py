"""The Merkle manifest against a plain tree, rebuilt whole for every tampered row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle

SHAPE = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, __at int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return sha(*map(field, row[:5]))


def up(nodes):
    return [sha(*nodes[i: i + 2]) for i in range(0, len(nodes), 2)]


def fold(nodes):
    while len(nodes) > 1:
        nodes = up(nodes)
    return nodes[0]


def siblings(nodes, at):
    found = []
    while len(nodes) > 1:
        found += [nodes[at ^ 1]] if at ^ 1 < len(nodes) else []
        nodes, at = up(nodes), at >> 1
    return found


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    leaves = {n: [leaf(r) for r in trees[n]] for n in names}
    subroots = [fold(leaves[n]) for n in names]
    root, out = fold(subroots), []
    for k, n in enumerate(names):
        for at, r in enumerate(trees[n]):
            new = list(leaves[n])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                new[at] = leaf((*r[:3], r[3] + 1, r[4]))
            whole = fold([fold(new) if i == k else s for i, s in enumerate(subroots)])
            proof = sha(*siblings(leaves[n], at), *siblings(subroots, k))
            out.append((r[0], leaves[n][at], subroots[k], root, proof, whole, whole == root))
    return sorted(map(str, out))


def made(n, langs, seed=1):
    draw, rows = random.Random(seed), []
    for i in range(n):
        lang = draw.choice(langs)
        rows.append((i, draw.choice(["a", None, "bü"]), lang, draw.choice([i, None, 0]), draw.choice([None, "", f"täxt {i}"]), "l", 1))
    return rows


def change():
    return merkle.tampered(F.col("doc_id")), {"n_chars": F.col("n_chars") + 1}


@pytest.mark.parametrize(("n", "langs", "bits"), [
    (1, ["en"], 9), (2, ["en"], 9), (37, ["en", None, "", "zé"], 2), (200, ["en", "en", "fr"], 2), (129, [f"l{i}" for i in range(40)], 1), (300, ["en", "de", None], 9),
])
def test_equals_a_plain_tree(spark, n, langs, bits):
    rows = made(n, langs)
    if n == 300:  # repeated rows and ids, and no id
        rows += rows[:20] + [(7, "other", "en", 1, "x", "l", 1), (None, None, None, None, None, "l", 1), (None, None, "en", 3, "x" * 100_000, "l", 1), (-4, None, "en", 3, "", "l", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, SHAPE).repartition(3), *change(), bits=bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in got.collect()]
    assert sorted(map(str, found)) == plain(rows)
    if n > 30:
        assert {r[-1] for r in found} == {True, False}


def test_a_version_copies_its_path_and_shares_the_rest(spark):
    rows = made(100, ["en", "fr"])
    docs = spark.createDataFrame(rows, SHAPE)
    nodes = merkle.version_nodes(docs, *change(), bits=3).collect()
    report = {r["doc_id"]: r for r in merkle.manifest(docs, *change(), bits=3).collect()}
    by = {}
    for r in nodes:
        by.setdefault(r["doc_id"], {})[r["level"]] = r
    assert set(by) == {i for i in report if zlib.crc32(str(i).encode()) % 7 == 0 and rows[i][3] is not None}
    sizes = {lang: sum(r[2] == lang for r in rows) for lang in ("en", "fr")}
    for i, path in by.items():
        assert sorted(path) == list(range((sizes[rows[i][2]] - 1).bit_length() + 2))  # one node a level, and one more above two trees
        assert path[0]["digest"] != report[i]["leaf"] and path[max(path)]["digest"] == report[i]["folded_root"]
        assert all(path[k]["node"] == path[0]["node"] >> k for k in path)


def test_no_rows(spark):
    empty = merkle.tamper_report(spark.createDataFrame([], SHAPE))
    assert empty.count() == 0 and "folded_root" in empty.columns
