"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from riskloom.llm import jaccard, licenses, lines, mixing, packing, secrets, threads, toxicity, warc, winnowing

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, label string, __of string"
TEXT = "The quick brown fox jumps over the lazy dog while seven wizards box with jumpy quails. "


def rows():
    return [
        (1, None, "en", None, 0, 1, "x", "y"), (2, "", None, "a", 0, 1, "x", "y"), (3, "word", "en", "a", 4, 1, "x", "y"),
        (4, TEXT * 3, "en", "b", 261, 1, None, "y"), (4, TEXT * 3, "en", "b", 261, 1, None, "y"),
        (5, TEXT * 3, "en", "b", 261, 1, "x", "y"), (None, "no id at all\nhere", "en", "b", 16, 1, "x", "y"),
        (6, "  \t\n \x0b", "en", "c", 5, 1, "x", "y"), (7, "long " * 60_000, "en", "c", 300_000, 1, "x", "y"),
        (8, "\U0001F600é" * 50, "en", "c", 100, 1, "x", "y"), (9, "a" * 300_000, "en", "c", 300_000, 1, "x", "y"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 0), (3, 0), (8, None), (None, 1)], "doc_id bigint, toxic int")


def reports(labels):
    return {
        "mixing": mixing.mixing_report, "packing": packing.pack, "toxicity": lambda d: toxicity.toxicity_report(d, labels),
        "jaccard": jaccard.near_report, "winnowing": winnowing.edited_report, "licenses": licenses.license_report,
        "secrets": secrets.secrets_report, "lines": lines.quality_report,
    }


@pytest.mark.parametrize("name", ["mixing", "packing", "toxicity", "jaccard", "winnowing", "licenses", "secrets", "lines"])
def test_odd_rows_and_no_rows(docs, labels, name):
    run = reports(labels)[name]
    found = run(docs).collect()
    ids = [r["doc_id"] for r in found]
    if name == "packing":
        assert set(ids) == {1, 2, 3, 4, 5, None, 6, 7, 8, 9}
    else:
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows())
    by = {r["doc_id"]: r.asDict() for r in found}
    same = {k: by[4][k] == by[5][k] for k in by[4]}
    if name in ("licenses", "secrets", "lines", "toxicity"):
        assert all(v for k, v in same.items() if k not in ("doc_id", "held_out"))
    if name == "jaccard":
        assert by[5]["component_id"] == 4 and by[1]["n_shingles"] == by[6]["n_shingles"] == 0 and by[3]["n_shingles"] == 1
    if name == "packing":
        assert by[1]["doc_tokens"] == by[2]["doc_tokens"] == 1
    empty = run(docs.limit(0))
    assert empty.count() == 0 and empty.columns == run(docs).columns


def test_stages_keep_columns(docs, labels):
    kept = {
        "toxicity": toxicity.drop_toxic(docs, labels, threshold=1.1), "copies": jaccard.drop_near_copies(docs),
        "secrets": secrets.redact(docs), "mix": mixing.mix(docs), "lines": lines.clean(docs),
    }
    for name, df in kept.items():
        assert df.schema.simpleString() == docs.schema.simpleString(), name
    assert kept["toxicity"].count() == kept["secrets"].count() == len(rows())
    assert kept["copies"].filter("doc_id IN (4, 5)").count() == 1 and kept["copies"].count() == len(rows()) - 2


def test_pages(spark):
    body = "x" * 40_000
    given = [(1, "u", body, 7), (2, None, body, 7), (3, "u\r\nv", None, 7), (4, "u", "short", 7), (5, "u", "short", 7), (None, "u", "é" * 80, 7)]
    pages = spark.createDataFrame(given, "page_id bigint, url string, html string, row int")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_report(pages).collect()}
    assert got[1][0] == got[2][0] == 40_000 and got[1][2:] == ("response", None) and got[2][2:] == ("revisit", 1)
    assert got[3][0] == 0 and got[4][2] == got[5][2] == "response" and got[None][0] == 160
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_pages_without_ids(spark):
    """A page without an id is a response only where no equal payload has an id; the SQL says the same."""
    import duckdb

    shared, lonely = "p" * 200, "q" * 200
    given = [(None, shared), (6, shared), (5, shared), (5, shared), (None, lonely), (None, lonely), (7, "r" * 99), (8, "r" * 99), (9, None)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in given], "page_id bigint, url string, html string")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(repr, (tuple(r) for r in warc.archive_report(pages).select(names).collect())))
    base = duckdb.connect()
    base.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    base.executemany("INSERT INTO pages VALUES (?, ?)", given)
    assert got == sorted(map(repr, base.execute(f"SELECT {', '.join(names)} FROM ({warc.SQL})").fetchall()))
    large = [eval(g) for g in got if "200" in g]
    assert [g[0] for g in large if g[3] == "response" and g[0] is not None] == [5]
    assert sorted(g[4] for g in large if g[3] == "revisit" and g[4] is not None) == [5, 5, 5]


def test_one_phrase_in_a_long_line(spark):
    """Furniture is judged by its share of a line: one phrase fails a short line, not a long paragraph."""
    prose = " ".join(f"word{i} stands beside other{i} things" for i in range(400)) + "."
    phrase = "click here"
    given = [
        (1, prose), (2, f"{prose[:-1]} {phrase} and more."), (3, f"{prose}\n{phrase}"), (4, f"{phrase} to read more about it now. " * 60),
        (5, "\n".join([f"{phrase} number {i} of them." for i in range(60)])), (6, f"{prose} a < b <i <i <i" + " <a" * 3),
    ]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept"] for r in lines.quality_report(docs).collect()}
    assert kept == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    cleaned = {r["doc_id"]: r["text"] for r in lines.clean(docs).collect()}
    assert cleaned[3] == prose and cleaned[2] == given[1][1]


def test_segments_and_framing():
    body = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(body, 77)) == body and warc.unchunked(warc.chunked(b"")) == b""
    parts = [(3, 5, b"e"), (1, None, b"ab"), (2, None, b"cd")]
    assert warc.reassemble(parts) == b"abcde"
    for broken in (parts[:1] + parts[2:], parts + parts[:1], [(1, 9, b"a")]):
        with pytest.raises(ValueError):
            warc.reassemble(broken)


def test_threads(spark):
    shape = "conv_id bigint, turn bigint, role string, text string, depth int"
    given = [
        (1, 0, "a", "Where is the key?\nIt was here.", 0), (1, 1, "b", "On Monday A wrote:\n> where IS the  key?\n\nIn the drawer.", 0),
        (1, 2, "a", "Another matter.", 0), (1, 3, "c", "> > Where is the key?\n> In the drawer.\nNot any more.", 0),
        (1, 4, "c", "> never said\nHm.", 0), (None, 0, None, None, 0), (1, None, "a", "> Another matter.", 0), (2, 0, "a", "> Hm.\nEh?", 0),
    ]
    table = spark.createDataFrame(given, shape)
    got = {(r["conv_id"], r["turn"]): r for r in threads.link_quotations(table).collect()}
    assert len(got) == len(given)
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, 0, None, 1, None]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 0, 2, 0] and [got[1, t]["thread"] for t in range(5)] == [0, 0, 2, 0, 4]
    assert [got[1, t]["position"] for t in range(5)] == [0, 1, 3, 2, 4] and got[1, None]["position"] == 5
    assert got[1, 1]["text"] == "In the drawer." and got[1, 3]["text"] == "Not any more." and got[1, 4]["n_quotes"] == 1
    assert got[2, 0]["reply_to"] is None and got[None, 0]["text"] == ""
    assert threads.link_quotations(table.limit(0)).count() == 0


def test_linked_parts(spark):
    given = [
        (1, "user: alice\npass: hunter22"), (2, "user: alice\n\npass: hunter22"), (3, "pass: hunter22"),
        (4, "see https://db.example.org/x\npwd = abc12345"), (5, "user: alice " + "-" * 500 + " pass: hunter22"),
        (6, "password=token: abcdefghijklmnop"),
    ]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets_report(docs).collect()}
    assert got[1] == "part_id:0:11,part_secret:12:26" and got[2] == got[3] == got[5] == got[6] == ""
    assert got[4] == "part_endpoint:4:28,part_secret:29:43"
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert masked[1] == "[SECRET]\n[SECRET]" and masked[3] == given[2][1]


def test_licenses_of_the_method(spark):
    notice = dict(licenses.NOTICES)["mit"].split()
    given = [(1, " ".join(notice[:20] + ["indeed", "so"] + notice[20:])), (2, " ".join(notice[:12])), (3, "GNU General Public License; under the MIT license")]
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(given, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and 0.6 < got[1]["score"] < 1 and got[2]["labels"] == ""
    assert got[3]["labels"] == "gpl,mit" and got[3]["base_labels"] == "mit" and got[3]["first_word"] == 4


def test_pipeline_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secrets", "mixing", "packing"]
