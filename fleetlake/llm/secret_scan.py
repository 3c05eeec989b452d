"""Secret scans with multipart credential linking.

Patterns find strong parts (assigned secrets, access ids, long hex keys), which are reported as they
are, and weak ones: names of accounts, secret-looking values, endpoints. A weak part is reported only
if a part that complements it reaches into its scope, ``reach`` code points to either side: a weak secret
needs an identifier or an endpoint, a weak identifier or an endpoint needs a secret.

Parts meet in an interval join. A document's positions are cut into buckets as wide as the reach. A part
taken whole lies in every bucket that it touches; per bucket and role only the first start and the last end are kept,
and a candidate meets the few buckets its scope touches. So no pairs of parts are spelt out, however many
a document holds.

Everything is column expressions. Matches of one pattern are the leftmost ones that do not overlap;
positions are code points, ends exclusive, summed up from the texts between the matches.

Defined cases: a null text is an empty one. Rows that repeat are scanned each for itself: rows are told
apart by a number given when the found parts are written. Extra columns are kept; columns with a
result's name are replaced. An empty table gives an empty table. Equal starts are ordered as the kinds
are listed in ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?"
_BEFORE = r"(?<![A-Za-z0-9_])"
#: Kind -> pattern, what a match needs besides, role, and whether it stands alone.
KINDS = {
    "assign": (
        r"(?i:(password|passwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", "secret", True,
    ),
    "access": (r"AKIA[A-Z0-9]{16,}", "identifier", True),
    "hex": (r"[0-9a-f]{24,}", "secret", True),
    "weak_id": (
        _BEFORE + r"(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)" + _VALUE + r"[A-Za-z0-9+/_.@-]{3,}",
        "identifier", False,
    ),
    "weak_secret": (
        _BEFORE + r"(?i:pwd|pass(?:phrase)?|auth|bearer|credentials?|private_?key|signature)" + _VALUE
        + r"[A-Za-z0-9+/_.=-]{6,}"
        r"|(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}",
        "secret", False,
    ),
    "endpoint": (
        r"(?:[a-z][a-z0-9+.]{1,15})://[A-Za-z0-9\[][^\s\"'<>]*"
        r"|" + _BEFORE + r"(?i:host(?:name)?|server|endpoint)" + _VALUE + r"[A-Za-z0-9][A-Za-z0-9.:-]{2,}"
        r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])",
        "endpoint", False,
    ),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
#: Shortest value of an assignment.
ASSIGNED = 6
#: What a weak part of a role needs in its scope.
COMPLEMENT = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
REACH = 240
_BLOCK = 64


def _before(sizes: Column) -> Column:
    """For each place of an array of sizes, the sum of those ahead of it.

    Block by block, so that a text with very many matches does not cost the square of them.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    sums = F.transform(blocks, lambda b: total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)),
                lambda _, i: total(F.slice(sums, F.lit(1), b))
                + total(F.slice(sizes, b * _BLOCK + 1, i)),
            ),
        )
    )


def find(docs: DataFrame, text: str, kind: str, into: str) -> DataFrame:
    """``docs`` with the matches of ``kind`` in ``text`` as an array of (start, ord, kind, end)."""
    pattern = KINDS[kind][0]
    empty = F.array().cast("array<string>")
    found, gaps, long_enough, steps, ahead = (f"__{into}_{x}" for x in ("found", "gaps", "long", "steps", "ahead"))
    hint = {
        "assign": F.instr(text, "=") + F.instr(text, ":") > 0,
        "access": F.instr(text, "AKIA") > 0,
        "hex": F.lit(True),
    }.get(kind, F.lit(True))
    docs = docs.withColumn(
        found, F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    ).withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(empty))
    if kind == "assign":
        values = F.when(F.size(found) > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).otherwise(empty)
        docs = docs.withColumn(long_enough, F.transform(values, lambda v: F.length(v) >= ASSIGNED))
    else:
        docs = docs.withColumn(long_enough, F.transform(found, lambda _: F.lit(True)))
    # Ahead of match i lie the gaps up to it and the matches before it.
    docs = docs.withColumn(
        steps, F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
    ).withColumn(ahead, F.when(F.size(found) > 0, _before(F.col(steps))).otherwise(F.array().cast("array<bigint>")))
    spans = F.transform(
        found,
        lambda m, i: F.struct(
            (F.get(ahead, i) + F.length(F.get(gaps, i))).alias("start"),
            F.lit(ORDER[kind]).alias("ord"),
            F.lit(kind).alias("kind"),
            (F.get(ahead, i) + F.get(steps, i)).alias("end"),
            F.get(long_enough, i).alias("counts"),
        ),
    )
    kept = F.transform(
        F.filter(spans, lambda s: s["counts"]), lambda s: F.struct(s["start"], s["ord"], s["kind"], s["end"])
    )
    return docs.withColumn(into, kept).drop(found, gaps, long_enough, steps, ahead)


def _link(found: DataFrame, reach: int, whole: bool) -> DataFrame:
    """The weak parts with a complement in scope, as one array per row number."""
    end = F.col("end" if whole else "start")
    role = F.element_at(F.create_map(*[F.lit(x) for kind, k in KINDS.items() for x in (kind, k[1])]), F.col("p.kind"))
    parts = found.select("__row", F.explode(F.concat("__strong", "__weak")).alias("p")).select(
        "__row", "p.*", role.alias("role")
    )
    buckets = (
        parts.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(end / reach))))
        .groupBy("__row", "bucket", "role")
        .agg(F.min("start").alias("first"), F.max(end).alias("last"))
        .groupBy("__row", "bucket")
        .agg(
            *[
                f(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{r}")
                for r in COMPLEMENT
                for f, c in ((F.min, "first"), (F.max, "last"))
            ]
        )
    )
    weak = found.select("__row", F.explode("__weak").alias("p")).select("__row", "p.*", role.alias("role"))
    scopes = weak.withColumns({"low": F.col("start") - reach, "high": F.col("end") + reach}).withColumn(
        "bucket",
        F.explode(F.sequence(F.greatest(F.floor(F.col("low") / reach), F.lit(0)), F.floor(F.col("high") / reach))),
    )
    # A scope is wider than a bucket: only its lowest bucket can hold parts that end ahead of it, only its
    # highest ones that start after it.
    inside = {r: (F.col(f"last_{r}") >= F.col("low")) & (F.col(f"first_{r}") <= F.col("high")) for r in COMPLEMENT}
    complemented = F.lit(False)
    for r, others in COMPLEMENT.items():
        hit = F.lit(False)
        for other in others:
            hit = hit | F.coalesce(inside[other], F.lit(False))
        complemented = complemented | ((F.col("role") == r) & hit)
    linked = scopes.join(buckets, ["__row", "bucket"]).where(complemented).select("__row", "start", "ord", "kind", "end")
    return linked.distinct().groupBy("__row").agg(
        F.collect_list(F.struct("start", "ord", "kind", "end")).alias("__linked")
    )


def scan(docs: DataFrame, text: str = "text", reach: int = REACH, whole: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``base`` (strong parts) and ``spans`` (with the linked weak ones).

    With ``whole`` a part is in a scope if any of it is, without only if its start is.
    Both are arrays of (start, ord, kind, end), ordered. The found parts, not the texts, are written to
    the shared folder, so the patterns run once.
    """
    others = [c for c in docs.columns if c not in (text, "base", "spans")]
    strong = [kind for kind, k in KINDS.items() if k[2]]
    weak = [kind for kind, k in KINDS.items() if not k[2]]
    rows = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    for kind in KINDS:
        rows = find(rows, "__text", kind, f"__{kind}")
    rows = rows.select(
        F.monotonically_increasing_id().alias("__row"),
        *others,
        F.sort_array(F.concat(*[f"__{k}" for k in strong])).alias("__strong"),
        F.concat(*[f"__{k}" for k in weak]).alias("__weak"),
    )
    found = materialize(rows, "secret-parts")
    linked = _link(found.where((F.size("__weak") > 0) & (F.size("__weak") + F.size("__strong") > 1)), reach, whole)
    linked_or_none = F.coalesce("__linked", F.array().cast(linked.schema["__linked"].dataType))
    return found.join(linked, "__row", "left").select(
        *others, F.col("__strong").alias("base"), F.sort_array(F.concat("__strong", linked_or_none)).alias("spans")
    )


def render(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
