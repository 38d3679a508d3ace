"""Merkle manifest of a dataset, as a persistent tree whose versions copy only changed paths.

A leaf is the SHA-256 digest of a row's fields.  The leaves of a tree (one per value of a
grouping column) stand in the order of their id; each two neighbours become one node, a last odd one a
node of its own, until one is left; the roots of the trees, in the order of their keys, are the leaves
of the tree above.  Trees are cut into aligned blocks of ``2**bits`` nodes, which are worked out in
parallel: leaves give block roots, those are the nodes of the next layer, until each tree has one.

A tampered leaf makes a version of the tree.  Within its block only its ancestors are copied, all other nodes
are those of the first version; above, the version is carried on from the block's root with the
siblings on the block's way to the root (a few dozen digests per block, joined to it).  So versions are made
where their block is, and no task holds more than one block and one path.

Defined results: NULL fields count as ``-``, others as their UTF-8 length, a colon and their value; a NULL group
is a tree of its own, before the others; NULL ids come first in their tree; rows that repeat an id
are leaves of their own, ordered by digest; fields other than the named ones are ignored; a table of one row has
the leaf as root and the digest of nothing as proof; a tampered row whose fields
stay the same (no n_chars to change) has no version of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spread import lookup, numbered
from riskloom.runtime import pin

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: levels of an aligned block: 512 leaves
BITS = 9


def digest(*parts: str) -> str:
    """SHA-256 of digests and texts written one after the other, as lower-case hexadecimal text."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's fields."""
    plain = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in plain)), 256)


def tampered(key: Column) -> Column:
    """Whether 7 divides the checksum of the decimal id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 0, F.lit(False))


class Block:
    """The nodes of an aligned block, level by level; ``total`` nodes of its layer are in the tree."""

    def __init__(self, digests: list[str], total: int, bits: int):
        height = min(bits, (total - 1).bit_length())
        self.levels = [digests]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(*below[i: i + 2]) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[str]:
        """The way up from node ``at``: per level the sibling, marked by its side, or a lone ``-``."""
        way = []
        for nodes in self.levels[:-1]:
            other = at ^ 1
            way.append("-" if other >= len(nodes) else ("<" if other < at else ">") + nodes[other])
            at >>= 1
        return way

    def version(self, at: int, changed: str) -> list[str]:
        """The nodes that a new leaf copies, from the leaf to the block's root; all others are shared."""
        return carried(changed, self.siblings(at))


def carried(node: str, way: Sequence[str]) -> list[str]:
    """``node`` and its new ancestors along ``way``."""
    copies = [node]
    for step in way:
        side, other = step[0], step[1:]
        copies.append(digest(copies[-1]) if side == "-" else digest(other, copies[-1]) if side == "<" else digest(copies[-1], other))
    return copies


def _sorted(table: pa.Table) -> tuple[dict[str, list], list[str], int]:
    rows = table.sort_by("__at").to_pydict()
    return rows, rows["__digest"], rows["__n"][0]


def _roots(bits: int):
    def run(table: pa.Table) -> pa.Table:
        rows, digests, total = _sorted(table)
        return pa.table({
            "__tree": rows["__tree"][:1], "__at": pa.array([rows["__at"][0] >> bits], pa.int64()),
            "__n": pa.array([-(-total >> bits)], pa.int64()), "__digest": [Block(digests, total, bits).root],
        })

    return run


def _ways(bits: int):
    def run(table: pa.Table) -> pa.Table:
        rows, digests, total = _sorted(table)
        block, size = Block(digests, total, bits), len(digests)
        return pa.table({
            "__tree": rows["__tree"], "__at": pa.array(rows["__at"], pa.int64()),
            "__way": pa.array([block.siblings(i) for i in range(size)], pa.list_(pa.string())),
            "__up": pa.array([at >> bits for at in rows["__at"]], pa.int64()),
            "__n": pa.array([-(-total >> bits)] * size, pa.int64()), "__digest": [block.root] * size,
        })

    return run


_NODE = "__tree string, __at bigint, __n bigint, __digest string"
_WAY = "__tree string, __at bigint, __way array<string>, __up bigint, __n bigint, __digest string"


def _blocks(nodes: DataFrame, bits: int):
    return nodes.groupBy("__tree", F.shiftright("__at", bits).alias("__block"))


def climb(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """From (tree, at, n, digest), ``n`` nodes per tree: the way of each node to its tree's root, and the roots.

    One layer of blocks at a time: the rounds are the logarithm of the largest tree to
    the base ``2**bits``, and each has that many times fewer rows than the one before.
    """
    layers = []
    while nodes.filter("__n > 1").limit(1).count():
        layer = pin(_blocks(nodes.select("__tree", "__at", "__n", "__digest"), bits).applyInArrow(_ways(bits), _WAY))
        layers.append(layer)
        # the first node of a block stands for it
        nodes = layer.filter(F.col("__at") == F.shiftleft("__up", bits)).select("__tree", F.col("__up").alias("__at"), "__n", "__digest")
    if not layers:
        return nodes.select("__tree", "__at", F.array().cast("array<string>").alias("__way")), nodes
    ways = layers[-1].select("__tree", "__at", "__way")
    for layer in layers[-2::-1]:
        above = ways.withColumnsRenamed({"__at": "__up", "__way": "__rest"})
        ways = layer.join(above, ["__tree", "__up"]).select("__tree", "__at", F.concat("__way", "__rest").alias("__way"))
    return ways, nodes


def _leaves(docs: DataFrame, key: str, tree: str, fields: Sequence[str], change: Column, changed: dict[str, Column]) -> DataFrame:
    """Leaves with their place in their tree: columns id, tree, at, n, digest, changed (NULL where nothing is)."""
    old, new = leaf([F.col(f) for f in fields]), leaf([changed.get(f, F.col(f)) for f in fields])
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # NULL before all others
    found = pin(docs.select(
        F.col(key).alias("__id"), name.alias("__tree"), old.alias("__digest"),
        F.when(change, F.nullif(new, old)).alias("__changed"), F.monotonically_increasing_id().alias("__salt"),
    ))
    ranked = numbered(found, [F.col("__tree"), F.col("__id").asc_nulls_first(), F.col("__digest"), F.col("__salt")], "__at").drop("__salt")
    ranked = pin(ranked)
    sizes = pin(ranked.groupBy("__tree").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), F.count("*").alias("__rows")))
    placed = lookup(ranked, sizes, ["__tree"], "__rows")
    return pin(placed.withColumn("__at", F.col("__at") - F.col("__first")).drop("__first"))


def _versions(bits: int, nodes: bool):
    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _shape(nodes)})
        rows, digests, total = _sorted(leaves)
        block, size = Block(digests, total, bits), len(digests)
        (way,), (subroot,), (root,) = (above.column(c).to_pylist() for c in ("__way", "__subroot", "__root"))
        upper = "".join(step[1:] for step in way)
        proofs, copies = [], []
        for at in range(size):
            proofs.append(digest(*(step[1:] for step in block.siblings(at)), upper))
            inside = block.version(at, rows["__changed"][at] or digests[at])
            copies.append(inside + carried(inside[-1], way)[1:])
        told = {
            "__id": leaves.sort_by("__at").column("__id"), "leaf": digests, "subroot": [subroot] * size, "root": [root] * size,
            "proof_sha256": proofs, "folded_root": [c[-1] for c in copies],
        }
        if nodes:
            told = {"__id": told["__id"], "__tree": rows["__tree"], "__at": rows["__at"], "tampered": [c is not None for c in rows["__changed"]], "copies": copies}
        return pa.table(told)

    return run


def _shape(nodes: bool) -> pa.Schema:
    text = pa.string()
    if nodes:
        return pa.schema([("__id", pa.int64()), ("__tree", text), ("__at", pa.int64()), ("tampered", pa.bool_()), ("copies", pa.list_(text))])
    return pa.schema([("__id", pa.int64()), *((c, text) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])


def _run(docs: DataFrame, key: str, tree: str, fields: Sequence[str], change: Column, changed: dict[str, Column], bits: int, nodes: bool) -> DataFrame:
    leaves = _leaves(docs, key, tree, fields, change, changed)
    blocks = pin(_blocks(leaves.select("__tree", "__at", "__n", "__digest"), bits).applyInArrow(_roots(bits), _NODE))
    ways, roots = climb(blocks, bits)
    subroots = pin(roots.select("__tree", F.col("__digest").alias("__subroot")))
    upper = numbered(subroots, [F.col("__tree")], "__at").select(
        F.lit("").alias("__tree"), "__at", F.lit(subroots.count()).cast("bigint").alias("__n"),
        F.col("__subroot").alias("__digest"), F.col("__tree").alias("__of"),
    )
    upper = pin(upper)
    on, top = climb(upper, bits)
    root = top.select("__digest").first()  # one row, or none for an empty table
    sizes = blocks.groupBy("__tree").agg(F.count("*").alias("__rows"))
    trees = upper.select("__at", F.col("__of").alias("__tree"), F.col("__digest").alias("__subroot")).join(
        on.select("__at", F.col("__way").alias("__rest")), "__at"
    ).drop("__at").join(sizes, "__tree")
    above = lookup(ways, pin(trees), ["__tree"], "__rows").select(
        "__tree", F.col("__at").alias("__block"), F.concat("__way", "__rest").alias("__way"), "__subroot",
        F.lit(root[0] if root else None).cast("string").alias("__root"),
    )
    shape = ", ".join(
        f"{f.name} {'array<string>' if pa.types.is_list(f.type) else 'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'bigint'}"
        for f in _shape(nodes)
    ).replace("__id bigint", f"__id {leaves.schema['__id'].dataType.simpleString()}")
    return _blocks(leaves, bits).cogroup(above.groupBy("__tree", "__block")).applyInArrow(_versions(bits, nodes), shape)


def manifest(
    docs: DataFrame, change: Column, changed: dict[str, Column], key: str = "doc_id", tree: str = "lang",
    fields: Sequence[str] = FIELDS, bits: int = BITS,
) -> DataFrame:
    """Per row its leaf, the root of its tree, the root of all, its proof, and the root of its version.

    ``change`` says which rows are tampered, ``changed`` gives the new value of fields.  Columns: ``key``, leaf,
    subroot, root, proof_sha256 (digest of the siblings on the way up), folded_root and verified.
    """
    found = _run(docs, key, tree, fields, change, changed, bits, False)
    return found.withColumnRenamed("__id", key).withColumn("verified", F.col("folded_root") == F.col("root"))


def version_nodes(
    docs: DataFrame, change: Column, changed: dict[str, Column], key: str = "doc_id", tree: str = "lang",
    fields: Sequence[str] = FIELDS, bits: int = BITS,
) -> DataFrame:
    """The nodes that each tampered row's version copies: ``key``, level (0: the leaf), node (its place in its level
    within the tree; 0 above the tree's root) and digest.  All other nodes of a version are those of the first one."""
    found = _run(docs, key, tree, fields, change, changed, bits, True).filter("tampered")
    nodes = found.select(F.col("__id").alias(key), "__at", F.posexplode("copies").alias("level", "digest"))
    return nodes.select(key, "level", F.expr("shiftright(__at, level)").alias("node"), "digest")


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with n_chars raised by one in the rows named by ``tampered``."""
    return manifest(docs, tampered(F.col("doc_id")), {"n_chars": F.col("n_chars") + 1})


SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS back,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT) AS inverse
  FROM documents
), hashed AS (
  SELECT doc_id, tree, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
    CASE WHEN xor(inverse, 4294967295) % 7 = 0
      THEN sha256(front || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || back) END AS changed
  FROM rows
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, max(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), uppers AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, max(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM uppers WHERE n > 1 GROUP BY level, place // 2
), inside AS (
  SELECT doc_id, leaf, tree, place AS leaf_place, 0 AS level, place, n, coalesce(changed, leaf) AS digest, '' AS siblings FROM leaves
  UNION ALL
  SELECT i.doc_id, i.leaf, i.tree, i.leaf_place, i.level + 1, i.place // 2, (i.n + 1) // 2,
    sha256(CASE WHEN i.place % 2 = 1 THEN s.digest || i.digest ELSE i.digest || coalesce(s.digest, '') END), i.siblings || coalesce(s.digest, '')
  FROM inside i LEFT JOIN nodes s ON s.tree = i.tree AND s.level = i.level AND s.place = xor(i.place, 1) WHERE i.n > 1
), above AS (
  SELECT i.doc_id, i.leaf, i.tree, i.leaf_place, r.digest AS subroot, 0 AS level, r.place, r.n, i.digest, i.siblings
  FROM inside i JOIN subroots r ON r.tree = i.tree WHERE i.n = 1
  UNION ALL
  SELECT i.doc_id, i.leaf, i.tree, i.leaf_place, i.subroot, i.level + 1, i.place // 2, (i.n + 1) // 2,
    sha256(CASE WHEN i.place % 2 = 1 THEN s.digest || i.digest ELSE i.digest || coalesce(s.digest, '') END), i.siblings || coalesce(s.digest, '')
  FROM above i LEFT JOIN uppers s ON s.level = i.level AND s.place = xor(i.place, 1) WHERE i.n > 1
)
SELECT a.doc_id, a.leaf, a.subroot, u.digest AS root, sha256(a.siblings) AS proof_sha256, a.digest AS folded_root, a.digest = u.digest AS verified
FROM above a CROSS JOIN (SELECT digest FROM uppers WHERE n = 1) u WHERE a.n = 1
"""
