"""Secret scan with multipart credential linking: weak parts count only beside complementary parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.llm import common
from accessloom.session import cut_lineage

# Kind, pattern, group whose length is bound, least length. The first three are reported wherever they
# stand; the others are weak and are reported only where a complementary part is near.
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
BASE = (
    ("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("ident", r"""(?i:client_?id|access_?key_?id|user_?name|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    ("endpoint", r"""(?i:https?|wss?|ftp|jdbc|mongodb|redis|amqp)[:A-Za-z0-9+]{0,40}://([^\x20\x09-\x0D"'<>]+)""", 1, 4),
    ("weak", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
)
KINDS = tuple(k[0] for k in BASE + WEAK)
_IDENTIFIERS, _SECRETS, _ENDPOINTS = ("ident", "access"), ("weak", "assign", "hex"), ("endpoint",)


def _matches(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """For one kind: number, lengths of the gaps before the matches, and (length, whether it counts) of each match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bound = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def counts(part: Column) -> Column:
        fits = F.length(part) >= least
        if KINDS[number] == "weak":
            for needed in ("[a-z]", "[A-Z]", "[0-9]"):
                fits = fits & part.rlike(needed)
        return fits

    hits = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("size"),
        F.transform(bound, counts).alias("ok"))
    return F.when(text.rlike(pattern), F.struct(F.lit(number).alias("kind"), hits.alias("hits")))


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every match of every kind as (key, kind, start, end) in code points; the end is exclusive.

    A match starts where the gaps and matches before it end, so two built-in functions give the offsets: splitting
    at the pattern for the gaps, extracting for the matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(common.row_key(id_col, text_col).alias("key"), text.alias("text"))
    kinds = F.array(*[_matches(F.col("text"), i, p, g, n) for i, (_, p, g, n) in enumerate(BASE + WEAK)])
    # The outer form: before the plain one, the optimizer tests the array's size and so matches all patterns twice.
    hits = source.select("key", F.explode_outer(kinds).alias("k")).where("k is not null").select(
        "key", "k.kind", F.posexplode_outer("k.hits").alias("at", "hit")).where("hit.size is not null")
    # Repeated rows have one key: their equal matches are one.
    hits = hits.dropDuplicates(["key", "kind", "at"])
    running = "sum(hit.gap + hit.size) over (partition by key, kind order by at rows between unbounded preceding and current row)"
    return hits.selectExpr("key", "kind", "hit.size as size", "hit.ok as ok", f"{running} as end").where("ok").selectExpr(
        "key", "kind", "end - size as start", "end")


def linked(found: DataFrame, scope: int = 300) -> DataFrame:
    """The weak spans that have a complementary part within ``scope`` code points: an identifier or endpoint needs a
    secret, a weak secret needs an identifier or endpoint.

    Parts are disjoint: what overlaps an identifier or endpoint is part of it, so it is no second part, neither
    of that one nor of another. An interval join: each span is put in the scope-wide cells that it, widened by the scope,
    touches, and joined by cell. Semi joins keep a weak span once, however many parts are near it.
    """
    number = F.col("kind")

    def of(names):
        return number.isin([KINDS.index(n) for n in names])

    def cells(df, widen):
        low, high = F.floor((F.col("start") - widen) / scope), F.floor((F.col("end") - 1 + widen) / scope)
        return df.withColumn("cell", F.explode(F.sequence(low, high)))

    def beside(spans_, others, meet, widen):
        a, b = cells(spans_, widen).alias("a"), cells(others, 0).alias("b")
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.cell") == F.col("b.cell"))
        return a.join(b, same & meet, "left_semi").drop("cell").distinct()

    ahead, behind = F.col("b.start") - F.col("a.end"), F.col("a.start") - F.col("b.end")
    near = (ahead <= scope) & (behind <= scope) & ((ahead >= 0) | (behind >= 0))
    holders = found.where(of(("ident", "endpoint")))
    covered = beside(found.where(of(_SECRETS)), holders, (ahead < 0) & (behind < 0), 0)
    secrets = found.where(of(_SECRETS)).join(covered, ["key", "kind", "start", "end"], "left_anti").select(*found.columns)
    free = cut_lineage(secrets)
    parts = found.where(of(_IDENTIFIERS + _ENDPOINTS))
    return beside(holders, free, near, scope).unionByName(beside(free.where(of(("weak",))), parts, near, scope))


def _shown(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        F.sort_array(spans_), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, n_linked, base_spans, spans (arrays of structs
    start, kind, end, where kind is a place in KINDS).

    Base kinds are reported wherever they match; a weak kind only when a complementary part stands within ``scope``
    code points of it in the same text. Spans of different kinds may overlap. A null or empty text has no spans, a
    repeated row has the spans of its twin, other columns are ignored and an empty table gives no rows. Texts are
    scanned once and never shuffled: only spans, a few numbers each, move.
    """
    found = cut_lineage(spans(docs, id_col, text_col))
    reported = found.where(F.col("kind") < len(BASE)).unionByName(linked(found, scope))
    of_row = reported.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("spans"))
    rows = docs.select(F.col(id_col), common.row_key(id_col, text_col).alias("_key"))
    all_ = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = rows.join(of_row.withColumnRenamed("key", "_key"), "_key", "left").select(
        id_col, F.sort_array(all_).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def of_kind(number: int) -> Column:
        # A second parameter of the lambda, even one with a default, would be the place in the array.
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    counts = [of_kind(i).alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)]
    return joined.select(
        id_col, *counts, F.size(F.filter("spans", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_linked"),
        base.alias("base_spans"), "spans")


def digests(scan: DataFrame) -> DataFrame:
    """The scan with its spans as text: base_sha256 over the base spans and all spans, joined by commas."""
    kept = [c for c in scan.columns if c not in ("base_spans", "spans")]
    return scan.select(
        *kept, F.sha2(_shown(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
