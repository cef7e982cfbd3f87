"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are regular expressions over the whole text. Beside them the scan collects weak parts, each of which alone would be
noise: identifiers that name an account or are too short for an access key, secret-like tokens without a keyword or with too short a
value, and endpoints. A weak identifier or secret is reported only when its complement, weak or strong, lies within `scope`
characters of it in the same document, and an endpoint only when both an identifier and a secret do.

The interval join of parts is by bins of `scope` characters: each document's parts are pre-aggregated per bin to
the first and last place of identifiers and of secrets, and a part is compared with three bins: its own, whose parts are always within
reach, the one before by its last place and the one after by its first. So the join makes at most three rows per part, whatever a document holds.

Cases: a null text is empty. Places are code points, ends are exclusive. Rows that repeat a document each get the same
result. A weak part that overlaps a base span is not reported. Further columns of the input are ignored. An empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Base kinds as they are listed in a result, and the pattern that finds the same spans as the rule "match, then drop".
BASE = ("assign", "access", "hex")

#: Weak parts: kind, role, pattern. A weak pattern may well match a base span; those are taken out.
WEAK = (
    ("account", "id", r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""),
    ("shortaccess", "id", r"\b(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{4,}"),
    ("shortassign", "secret", ASSIGN),
    ("bare", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"),
    ("upperhex", "secret", r"\b(?=[A-F]{0,31}[0-9])[0-9A-F]{32,}\b"),
    ("endpoint", "endpoint", r"\bhttps?://[A-Za-z0-9][A-Za-z0-9.:_/-]*[A-Za-z0-9/]"),
)
KINDS = (*BASE, *(kind for kind, _, _ in WEAK))
#: Matches of a text that are gathered at a time, so that texts with many matches do not cost their square.
BLOCK = 256
ROLES = {"assign": "secret", "access": "id", "hex": "secret", **{kind: role for kind, role, _ in WEAK}}


def spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Matches of a pattern as an array of (start, kind_no, end), those for which `keep(match)` holds.

    Text between matches and the matches themselves alternate, so running lengths give the places.
    """
    whole = F.lit(pattern)
    matches, between = F.regexp_extract_all(text, whole, F.lit(0)), F.split(text, pattern, -1)
    number = F.lit(KINDS.index(kind))
    span_of = "array<struct<start:int,kind_no:int,end:int>>"
    kind_of, blocks_of = f"struct<at:int,found:{span_of}>", f"struct<at:int,found:array<{span_of}>>"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        one = F.array(F.struct(start.alias("start"), number.alias("kind_no"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(keep(pair["match"]), F.concat(state["found"], one)).otherwise(state["found"]).alias("found")
        )

    def block(state: Column, index: Column) -> Column:
        """One more block of matches; only its own array is copied match by match."""
        none = F.struct(state["at"].alias("at"), F.array().cast(span_of).alias("found")).cast(kind_of)
        part = F.aggregate(F.slice(pairs, index * BLOCK + 1, F.lit(BLOCK)), none, lambda s, p: step(s, p).cast(kind_of))
        both = lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).alias("found"))
        return F.transform(F.array(part), both)[0].cast(blocks_of)

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    indexes = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span_of}>").alias("found")).cast(blocks_of)
    found = F.aggregate(indexes, none, block, lambda s: F.flatten(s["found"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(span_of))


def _value_length(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 1))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and weak spans of every document."""
    text = F.col("text")
    always = lambda m: F.lit(True)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(
        spans(text, "assign", ASSIGN, lambda m: _value_length(m) >= 8),
        spans(text, "access", r"AKIA[A-Z0-9]{12,}", always),
        spans(text, "hex", r"[0-9a-f]{32,}", always),
    )
    weak = F.concat(*(
        spans(text, kind, pattern, (lambda m: _value_length(m) < 8) if kind == "shortassign" else always)
        for kind, _, pattern in WEAK
    ))
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.select("doc_id", base.alias("base"), weak.alias("weak")).withColumn("weak", free)


def linked_parts(found: DataFrame, scope: int) -> DataFrame:
    """(row, linked): per row with linked weak parts, their spans."""
    parts = found.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    roles = F.array(*(F.lit(ROLES[kind]) for kind in KINDS))
    parts = parts.withColumn("role", roles[F.col("kind_no")]).withColumn("bin", F.floor(F.col("start") / scope))
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    bins = parts.groupBy("row", "bin").agg(
        F.min(of("id", "start")).alias("first_id"),
        F.max(of("id", "start")).alias("last_id"),
        F.min(of("secret", "start")).alias("first_secret"),
        F.max(of("secret", "start")).alias("last_secret"),
    )
    near = parts.filter(F.col("kind_no") >= len(BASE)).withColumn("b", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = near.join(bins.withColumnsRenamed({"bin": "b"}), ["row", "b"])

    def reach(role: str) -> Column:
        return (
            F.when(F.col("b") == F.col("bin"), F.col(f"first_{role}").isNotNull())
            .when(F.col("b") < F.col("bin"), F.col("start") - F.col(f"last_{role}") <= scope)
            .otherwise(F.col(f"first_{role}") - F.col("start") <= scope)
        )

    met = near.groupBy("row", "start", "kind_no", "end", "role").agg(
        F.max(F.coalesce(reach("id"), F.lit(False))).alias("id"), F.max(F.coalesce(reach("secret"), F.lit(False))).alias("secret")
    )
    needed = (
        F.when(F.col("role") == "id", F.col("secret")).when(F.col("role") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    )
    span = F.struct("start", "kind_no", "end")
    return met.filter(needed).groupBy("row").agg(F.collect_set(span).alias("linked"))


def joined(all_spans: Column) -> Column:
    names = F.array(*(F.lit(kind) for kind in KINDS))
    one = lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(all_spans), one), ",")


def find_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """doc_id, base and linked spans (start, kind_no, end) of every document; kind_no counts in `KINDS`."""
    found = stored(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    linked = linked_parts(found, scope)
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    return found.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", empty).alias("linked"))


def secret_report(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Counts of base spans, a digest of them and all spans, per document."""
    found = find_secrets(docs, scope)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind_no"] == BASE.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
