"""Secrets by multipart credential linking, in native operations alone.

Strong parts stand alone: assigned secrets, access identifiers and long hexadecimal strings. Weak
parts are user names and identifiers, short or bare secrets, and endpoints; each is too common to
report by itself. Parts become intervals of a document, dealt into cells as wide as a scope; an
interval join links parts at most a scope apart, and a weak part is reported only with a complementary
one: an identifier or endpoint with a secret near it, a weak secret with an identifier or
endpoint near it.

Positions come from the pieces between matches: a text is split by the pattern, and sums of the
lengths of pieces and matches are offsets, in code points. Texts are read once; only
lengths of matches go on.

Defined cases: a null text counts as empty; rows that repeat an id and text share their spans and
give a row each; null ids are scanned; other columns are ignored, or kept by ``redacted``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from touchline.llm.texts import picked, spare
from touchline.operators.common import stage

SCOPE = 256


@dataclass(frozen=True)
class Part:
    """A pattern; ``least`` bounds the length of ``group``. Strong parts are reported without a partner."""

    kind: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    strong: bool = False


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: In the order in which equal starts are listed.
PARTS = (
    Part("assign", "secret", rf"(?i:(password|passwd|secret|token|api_?key)){_VALUE}([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Part("access", "identifier", "AKIA[A-Z0-9]+", 0, 20, True),
    Part("hex", "secret", "[0-9a-f]{24,}", 0, 24, True),
    Part("user", "identifier", rf"(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)){_VALUE}[A-Za-z0-9@._-]{{3,}}"),
    Part("pass", "secret", rf"(?i:\b(?:pass|pwd|pw|passphrase|credential|key|auth)){_VALUE}[A-Za-z0-9+/_.=!@-]{{4,}}"),
    Part("bare", "secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    Part("endpoint", "endpoint", r"(?i:\b(?:https?|ftp|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s\"'<>]+"),
)
_KEY = ["doc_id", "h"]


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def matched(docs: DataFrame, parts=PARTS) -> DataFrame:
    """``doc_id, h`` (hash of the text) and ``found``: per part with matches an array of
    ``gap`` (length of the piece before), ``size`` and ``core`` (length of the bounded group)."""
    t = F.col("t")
    out = []
    for p in parts:
        rx = _literal(p.pattern)
        whole, core = F.regexp_extract_all(t, rx, F.lit(0)), F.regexp_extract_all(t, rx, F.lit(p.group))
        rows = F.zip_with(F.zip_with(F.split(t, p.pattern, -1), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
                          core, lambda x, c: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(c).alias("core")))
        out.append(F.when(t.rlike(p.pattern), F.struct(F.lit(p.kind).alias("kind"), rows.alias("rows"))))
    df = picked(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return df.select("doc_id", F.struct(F.xxhash64("t").alias("x"), F.length("t").alias("n")).alias("h"),
                     F.filter(F.array(*out), lambda x: x.isNotNull()).alias("found"))


def intervals(found: DataFrame, parts=PARTS) -> DataFrame:
    """``doc_id, h, kind, start, end, role, strong, place`` of every match that passes its bound."""
    each = (found.filter(F.size("found") > 0).select(*_KEY, F.explode("found").alias("f"))
            .select(*_KEY, F.col("f.kind").alias("kind"), F.posexplode("f.rows").alias("i", "r"))
            .filter("r.size IS NOT NULL").dropDuplicates([*_KEY, "kind", "i"]))
    upto = W.partitionBy(*_KEY, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = each.withColumn("end", F.sum(F.col("r.gap") + F.col("r.size")).over(upto).cast("long"))

    def of(field: str) -> Column:
        return F.create_map(*[x for p in parts for x in (F.lit(p.kind), F.lit(getattr(p, field)))])[F.col("kind")]

    place = F.create_map(*[x for n, p in enumerate(parts) for x in (F.lit(p.kind), F.lit(n))])[F.col("kind")]
    return (each.filter(F.col("r.core") >= of("least"))
            .select(*_KEY, "kind", (F.col("end") - F.col("r.size")).alias("start"), "end", of("role").alias("role"),
                    of("strong").alias("strong"), place.alias("place")))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part at most ``scope`` code points away, by interval join.

    A part is in the cells that it touches; its partner in those and the next ones."""
    def cells(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))

    weak = parts.filter("NOT strong").withColumn("cell", cells(F.col("start"), F.col("end")))
    near = parts.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("start").alias("s"), F.col("end").alias("e"),
                        F.col("role").alias("r"), cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("c"))
    partner = (weak["doc_id"].eqNullSafe(near["d"]) & (weak["h"] == near["g"]) & (weak["cell"] == near["c"])
               & (near["s"] <= weak["end"] + scope) & (near["e"] >= weak["start"] - scope)
               & (weak["role"] != near["r"]) & ((weak["role"] == "secret") | (near["r"] == "secret")))
    return weak.join(near, partner, "left_semi").drop("cell").distinct()


def secret_spans(docs: DataFrame, parts=PARTS, scope: int = SCOPE, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every row (``doc_id, h``) and the reported spans (``doc_id, h, kind, start, end, strong, place``)."""
    rows = stage(matched(picked(docs, doc_id=id_col, text=text_col), parts), "secret-matches")
    every = stage(intervals(rows, parts), "secret-parts")
    spans = every.filter("strong").unionByName(linked(every, scope))
    return rows.select(*_KEY), spans


def by_document(docs: DataFrame, parts=PARTS, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` of every row with ``spans``: array of ``start, place, end, kind, strong`` in order."""
    rows, spans = secret_spans(docs, parts, scope, id_col, text_col)
    listed = spans.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", "kind", "strong"))).alias("spans"))
    listed = listed.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "spans")
    return rows.join(listed, rows["doc_id"].eqNullSafe(listed["d"]) & (rows["h"] == listed["g"]), "left").select(
        "doc_id", "h", F.coalesce("spans", F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, place: INT, end: BIGINT, kind: STRING, strong: BOOLEAN>>)")).alias("spans"))


def redacted(docs: DataFrame, parts=PARTS, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text",
             mark: str = "[SECRET]") -> DataFrame:
    """``docs`` in their columns, each reported span (joined where spans overlap) replaced by ``mark``."""
    _, spans = secret_spans(docs, parts, scope, id_col, text_col)
    key, hashed, cuts, last = spare(docs, "__d", "__h", "__cuts", "__last")
    ahead = W.partitionBy(*_KEY).orderBy("start", "place").rowsBetween(W.unboundedPreceding, -1)
    cut = (spans.withColumn("from", F.coalesce(F.max("end").over(ahead), F.lit(0)))
           .groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "place", "from"))).alias(cuts), F.max("end").alias(last))
           .select(F.col("doc_id").alias(key), F.col("h").alias(hashed), cuts, last))
    text = docs[text_col]
    h = F.struct(F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"), F.length(F.coalesce(text, F.lit(""))).alias("n"))
    joined = docs.join(cut, docs[id_col].eqNullSafe(cut[key]) & (h == cut[hashed]), "left")
    pieces = F.transform(cuts, lambda c: F.when(c["start"] >= c["from"], F.concat(
        F.substring(text, c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), F.lit(mark))).otherwise(F.lit("")))
    # A cut that begins inside the one before it has nothing of its own to keep.
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.col(last).cast("int") + 1, F.length(text)))
    return joined.select(*[F.when(F.col(cuts).isNull(), text).otherwise(clean).alias(c) if c == text_col else docs[c]
                           for c in docs.columns])
