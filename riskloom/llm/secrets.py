"""Secret scans with linking of multipart credentials; DataFrame functions only.

Strong finds are reported wherever they stand: assignments of long values to secret names
(``assign``), access identifiers (``access``) and long hexadecimal runs (``hex``).  Weak parts
are reported only where parts that complement each other stand close together in one scope:
an identifier (``part_id``), a secret value (``part_secret``: under a secret name, at any length, or
a bare token) and an endpoint (``part_endpoint``).  A value that ``assign`` reports is no weak part,
nor is a bare token within another find.  A scope is a paragraph, text between empty lines.  The link is an interval
join: parts are put into buckets of ``REACH`` characters and joined with those of the same scope
in the same and the neighbouring buckets that start at most ``REACH`` characters away.  A weak
part is reported if a part of another kind (an endpoint: a secret) is among them; an assignment
or access identifier complements weak parts as well.

Spans are (kind, start, end) in code points, end exclusive.  Spans of one kind never overlap;
those of different kinds may.

Defined results: a null text has no spans and counts as empty; rows that repeat an id are
scanned one by one (rows equal in id and text give equal rows); null ids are kept; other
columns stay untouched in ``redact``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds, in the order that breaks ties between spans
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# a run is kept or dropped as a whole, so its least length can be part of the pattern
ACCESS_KEPT, HEX_KEPT = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"

# weak parts: any identifier-like name with a value, a secret-like name with a value or a bare mixed token, and an address;
# names may have a prefix, and an access key is an identifier unless it is called secret
PART_ID = r"""(?i)(?<![A-Za-z0-9_])(?:[A-Za-z0-9_]*_)?(?:user(?:name)?|login|client_?id|(?<!secret)(?<!secret_)access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
PART_SECRET = r"""(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:pass(?:word|wd)?|pwd|secret|token|(?<!access)(?<!access_)key|secret_?access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
# a bare token has 16 characters or more, with lower and upper case and digits
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]+={0,2}(?![A-Za-z0-9+/_=-])"
PART_ENDPOINT = r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}"""

BASE = ("assign", "access", "hex")
WEAK = ("part_id", "part_secret", "part_endpoint")
KINDS = (*BASE, *WEAK)
REACH = 400
SCOPE_END = r"\n[\x20\t\r]*\n"

_SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """Start and end of every match: the lengths of what lies between and of the matches, added up."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(
        F.length(gap).cast("bigint").alias("gap"), F.length(hit).cast("bigint").alias("size")
    ))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return F.aggregate(
        steps, start,
        lambda done, x: F.struct(
            (done["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(done["spans"], F.array(F.struct(
                (done["at"] + x["gap"]).alias("start"), (done["at"] + x["gap"] + x["size"]).alias("stop")
            ))).alias("spans"),
        ),
        lambda done: done["spans"],
    )


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _ordered(spans: Column) -> Column:
    """Distinct spans by start, kind in the order of KINDS, end."""
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")
    ))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")
    ))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _apart(spans: Column, others: Column, covered: bool = False) -> Column:
    """The spans that overlap none of ``others``, or that none of them covers up to the end."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (
        (o["start"] < s["stop"]) & (s["start"] < o["stop"]) & (F.lit(not covered) | (s["stop"] <= o["stop"]))
    )))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` and ``__weak``, the spans found without looking at neighbours.

    Matches are cut out first, and only rows that have some are split at the pattern for places.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS_KEPT, HEX_KEPT, PART_ID, PART_SECRET, PART_ENDPOINT), strict=True))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    # a row that holds none of a pattern's fixed words is not searched for it
    hints = {
        "assign": r"(?i)pass|secret|token|api", "access": "AKIA", "hex": None,
        "part_id": "[:=]", "part_secret": r"(?i)pass|secret|token|key|pwd", "part_endpoint": "://",
    }
    shown = docs.withColumns({
        f"__{kind}": (_found(plain, p) if hints[kind] is None else F.when(
            plain.contains(hints[kind]) if hints[kind] in ("AKIA", "://") else plain.rlike(hints[kind]), _found(plain, p)
        ))
        for kind, p in patterns.items()
    })
    # a bare token counts beside an identifier or endpoint only, so other rows are not searched for it
    beside = (F.size("__part_id") > 0) | (F.size("__part_endpoint") > 0) | (F.size("__access") > 0)
    shown = shown.withColumn("__bare", F.when(beside, _found(plain, BARE)))
    spans = {}
    for kind, pattern in {**patterns, "bare": BARE}.items():
        found = F.col(f"__{kind}")
        some = _placed(plain, pattern, found)
        if kind == "assign":  # scanned as written, then failing values are dropped: they hide what they cover
            value = r"(?is)^.*?[:=]\x20*[\"']?([a-z0-9+/_.=-]+)$"
            long = F.transform(found, lambda hit: F.length(F.regexp_extract(hit, value, 1)) >= LEAST["assign"])
            both = F.zip_with(some, long, lambda s, ok: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), ok.alias("ok")))
            some = F.transform(F.filter(both, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
        spans[kind] = _named("part_secret" if kind == "bare" else kind, F.when(F.size(found) > 0, some).otherwise(none))
    at = {k: F.col(f"__at_{k}") for k in spans}
    placed = shown.withColumns({f"__at_{k}": s for k, s in spans.items()})
    named = _apart(at["part_secret"], at["assign"], covered=True)
    bare = _apart(at["bare"], F.concat(*[at[k] for k in (*WEAK, "assign", "access")]))
    return placed.withColumns({
        "__base": F.concat(*[at[k] for k in BASE]), "__weak": F.concat(at["part_id"], named, bare, at["part_endpoint"]),
    }).drop(*[f"__{k}" for k in spans], *[f"__at_{k}" for k in spans])


def linked(found: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """Weak spans with a complement in reach: the keys and ``__linked``, for rows that have some.

    ``found`` has ``__base``, ``__weak`` and ``__breaks``, the places where scopes end.
    """
    parts = found.filter(F.size("__weak") > 0).distinct().select(*keys, "__breaks", F.explode(
        F.concat("__weak", F.filter("__base", lambda s: s["kind"] != "hex"))
    ).alias("part")).select(*keys, "part.*", F.size(F.filter("__breaks", lambda b: b <= F.col("part.start"))).alias("scope"))
    role = (
        F.when(F.col("kind").isin("part_id", "access"), "id").when(F.col("kind") == "part_endpoint", "endpoint").otherwise("secret")
    )
    placed = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / reach))
    weak = placed.filter(F.col("kind").isin(*WEAK))
    near = placed.select(
        *[F.col(k).alias(f"o_{k}") for k in keys], F.col("scope").alias("o_scope"), F.col("role").alias("o_role"),
        F.col("start").alias("o_start"), F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("o_bucket"),
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    complements = (F.col("role") != F.col("o_role")) & ~(
        ((F.col("role") == "endpoint") & (F.col("o_role") == "id")) | ((F.col("role") == "id") & (F.col("o_role") == "endpoint"))
    )
    kept = weak.join(
        near, same & (F.col("scope") == F.col("o_scope")) & (F.col("bucket") == F.col("o_bucket"))
        & (F.abs(F.col("start") - F.col("o_start")) <= reach) & complements, "left_semi",
    )
    return kept.groupBy(*keys).agg(F.collect_set(F.struct("kind", "start", "stop")).alias("__linked"))


def _with_spans(docs: DataFrame, text: str, reach: int, carry: list[str]) -> DataFrame:
    """``carry`` columns with ``__base`` and ``__all`` spans; a row is known by a digest of its id and text."""
    digest = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))), 256)
    # a key only where a link is possible, so the other rows are spread evenly
    keyed = scan(docs, text).withColumn("__key", F.when(F.size("__weak") > 0, digest))
    ends = _placed(F.coalesce(F.col(text), F.lit("")), SCOPE_END, _found(F.coalesce(F.col(text), F.lit("")), SCOPE_END))
    links = linked(keyed.filter(F.size("__weak") > 0).select(
        "__key", "__base", "__weak", F.transform(ends, lambda s: s["stop"]).alias("__breaks")
    ), ["__key"], reach)
    plain = keyed.select(*carry, "__base", "__key")
    some = plain.filter(F.col("__key").isNotNull()).alias("p").join(
        links.alias("l"), F.col("p.__key") == F.col("l.__key"), "left"
    ).select("p.*", "l.__linked")
    none = plain.filter(F.col("__key").isNull()).withColumn("__linked", F.lit(None).cast(_SPANS))
    return some.unionByName(none).drop("__key").withColumn(
        "__all", _ordered(F.concat("__base", F.coalesce("__linked", F.array().cast(_SPANS))))
    ).drop("__linked")


def secrets_report(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """Per document: finds by base kind, a digest of the base spans, and all spans."""
    found = _with_spans(docs.select("doc_id", text), text, reach, ["doc_id"])
    def of(kind: str) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = {f"n_{k}": of(k) for k in BASE}
    return found.withColumns(counts).select(
        "doc_id", *counts, F.sha2(_said(_ordered(F.col("__base"))), 256).alias("base_sha256"), _said(F.col("__all")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; a column ``n_chars`` follows the new length."""
    found = _with_spans(docs, text, reach, docs.columns)
    merged = F.aggregate(  # overlapping spans become one
        F.col("__all"), F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] > s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")
            ))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))),
    )
    pieces = F.aggregate(
        merged, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda done, s: F.struct(
            s["stop"].alias("at"),
            F.concat(done["out"], F.substring(F.col(text), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mask)).alias("out"),
        ),
        lambda done: F.concat(done["out"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    hit = F.size("__all") > 0
    masked = F.when(hit, pieces).otherwise(F.col(text))
    changed = {text: masked}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


SQL = None  # places of matches and links between parts are beyond plain SQL; tested by brute force
