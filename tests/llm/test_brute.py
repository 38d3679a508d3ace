"""Queries over the smallest table against plain Python over the same rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from riskloom.llm import jaccard, packing, queries, winnowing

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    answer = con.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    expected = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in answer.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in rows(spark, name)) == expected


def test_packing(spark, texts):
    encode, found = packing.slow_encoder(), rows(spark, "op2_pack_sequences")
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, text in texts:
        ids, at = np.array([*encode(text or ""), 0], dtype="<u4"), 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at: at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
        short += packing.CAPACITY - at
    assert short < packing.CAPACITY


def test_assignment_balances_and_fills():
    pieces = packing.assign([700, 700, 400, 300, 300, 100], 1000)
    used = collections.Counter()
    for _, _, n, s, offset in pieces:
        assert offset == used[s]
        used[s] += n
    assert sum(used.values()) == 2500 and max(used.values()) <= 1000 and len(used) == 3


def test_jaccard(spark, texts):
    sets = {}
    for doc, text in texts:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i: i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    for r in rows(spark, "op4_ngram_jaccard"):
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]))


def test_jaccard_is_the_same_with_frequent_grams(spark, monkeypatch):
    want = sorted(rows(spark, "op4_ngram_jaccard"), key=str)
    for level in (-1, 3):  # all n-grams, then those counted more than about three times
        monkeypatch.setattr(jaccard, "COLD_LEVEL", level)
        assert sorted(rows(spark, "op4_ngram_jaccard"), key=str) == want


def test_winnowing(spark, texts):
    found = {r["doc_id"]: r for r in rows(spark, "op5_winnowing")}
    for i, (doc, text) in enumerate(texts):
        after, n = texts[(i + 1) % len(texts)][1], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert found[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[doc]["n_chars"] == n
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.3 > np.mean([r["near_next"] for r in found.values()])


def test_winnowing_guarantee():
    shared = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(winnowing.K + winnowing.W - 1))
    (x, _), (y, _) = winnowing.fingerprints(["before " * 9 + shared + " 1", "0 " + shared + " and after" * 9])
    assert set(x.tolist()) & set(y.tolist())
    hashes = np.array([5, 3, 3, 9, 3, 8], dtype=np.uint64)
    assert winnowing._chosen(hashes, 4).tolist() == [2, 4, 4]


def test_secrets_licenses_lines(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    hidden = {r["doc_id"]: r for r in rows(spark, "op9_secrets")}
    licensed = {r["doc_id"]: r for r in rows(spark, "op7_license_scan")}
    judged = {r["doc_id"]: r for r in rows(spark, "op10_line_cleaning")}
    for doc, text in texts:
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert hidden[doc]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(hidden[doc]["spans"].split(","))

        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
        r = licensed[doc]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert r["first_word"] == (min(at)[0] if at else None) and set(r["base_labels"].split(",")) <= {"", *r["labels"].split(",")}

        w, seen, repeated = WORD.findall(text), set(), 0
        runs = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if runs[tuple(w[i: i + 3])] > 1 for j in (i, i + 1, i + 2)}
        for line in text.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        r = judged[doc]
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_toxicity_on_withheld_rows(spark):
    folder = "/root/testdata/sf0.1"
    scores = {r["doc_id"]: r for r in queries.QUERIES["op3_toxicity"](spark, folder).collect()}
    labels = duckdb.connect().execute(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    pairs = [(scores[d]["score"], t) for d, t in labels if scores[d]["held_out"]]
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == r["held_out"] for d, r in scores.items())
    caught = [s >= 0.5 for s, t in pairs if t]
    false = [s >= 0.5 for s, t in pairs if not t]
    assert np.mean(caught) > 0.6 and np.mean(false) < 0.01
