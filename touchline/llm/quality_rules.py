"""Quality rules: a threshold table compiled into one projection.

Every statistic is a column expression over the whole text and every rule of ``RULES`` a
comparison of one statistic with its bounds, so the verdict is a single native projection: no user
function, no shuffle, and work in proportion to the text (sorting word windows aside).

Repeated three-word windows are found inside the row: windows are hashed to 64 bits with their
position, sorted, equal neighbours kept, and the words they cover are counted from the gaps
between their positions.

Defined cases: null and empty texts have no words and fail; ratios over nothing are 0; stop words are
those of English, German, French and Spanish; rows that repeat an id give a row each; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.texts import picked

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
STOP_WORDS = """the of and to a in is was it for on with as that this by are be at from or an have not
der die das und ist in den von zu mit nicht ein eine für auf dem sich auch im es
le la les de des et un une est en du que qui dans pour pas sur au par ce
el los las una y que del se por con para su al lo como más o pero
""".split()


@dataclass(frozen=True)
class Rule:
    """The statistic may not be below ``least`` or above ``most``; ``stat`` is SQL over the statistics."""

    name: str
    stat: str
    least: float | None = None
    most: float | None = None


#: Bounds on length, symbols, stop words and lines.
RULES = (
    Rule("words", "n_words", 50, 1_000_000),
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2, 14),
    Rule("longest_word", "longest_word", None, 1_000),
    Rule("symbol_ratio", "n_symbols / greatest(n_words, 1)", None, 0.15),
    Rule("letter_words", "n_letter_words / greatest(n_words, 1)", 0.7, None),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    Rule("upper_ratio", "n_upper / greatest(word_chars, 1)", None, 0.4),
    Rule("exclamation_ratio", "n_exclaims / greatest(n_words, 1)", None, 0.3),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.3),
    Rule("duplicate_line_chars", "1 - line_chars_once / greatest(line_chars, 1)", None, 0.3),
    Rule("bullet_lines", "n_bullets / greatest(n_lines, 1)", None, 0.9),
    Rule("ellipsis_lines", "n_ellipses / greatest(n_lines, 1)", None, 0.3),
)


def _count(chars: str, text: str = "t") -> Column:
    """Characters of ``chars`` in a text."""
    col = F.col(text)
    return F.length(col) - F.length(F.translate(col, chars, ""))


def _sum_lengths(array: str) -> Column:
    return F.length(F.array_join(F.col(array), ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with every statistic the rules use."""
    df = picked(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumns({
        "w": F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x != '')"),
        "l": F.expr(r"filter(split(t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
    })
    df = df.withColumns({
        # Window hashes with their positions, equal ones side by side.
        "s": F.expr("""sort_array(transform(
            CASE WHEN size(w) > 2 THEN zip_with(zip_with(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), (a, b) -> xxhash64(a, b)),
                 slice(w, 3, size(w) - 2), (h, c) -> xxhash64(h, c)) ELSE array() END, (h, i) -> struct(h, i)))"""),
        "once": F.array_distinct("l"),
        "stops": F.expr(f"size(filter(w, x -> lower(rtrim('.,;:!?', x)) in ({', '.join(repr(x) for x in dict.fromkeys(STOP_WORDS))})))"),
    })
    # Positions of windows that equal a neighbour, in text order.
    df = df.withColumn("p", F.expr("""CASE WHEN size(s) < 2 THEN array() ELSE sort_array(transform(filter(zip_with(
        s, zip_with(concat(slice(s, 2, size(s) - 1), array(struct(CAST(NULL AS BIGINT) AS h, -1 AS i))),
                    concat(array(struct(CAST(NULL AS BIGINT) AS h, -1 AS i)), slice(s, 1, size(s) - 1)),
                    (n, b) -> struct(n.h AS n, b.h AS b)),
        (x, y) -> struct(x.i AS i, coalesce(x.h = y.n, false) OR coalesce(x.h = y.b, false) AS twice)), z -> z.twice), z -> z.i)) END"""))
    repeated = F.expr("""CASE WHEN size(p) = 0 THEN 0L ELSE aggregate(zip_with(p,
        concat(slice(p, 2, size(p) - 1), array(element_at(p, -1) + 3)), (x, y) -> least(y - x, 3)), 0L, (a, x) -> a + x) END""")
    return df.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), _sum_lengths("w").cast("long").alias("word_chars"),
        _count(SYMBOLS).cast("long").alias("n_symbols"), (F.size("l") - F.size("once")).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"),
        _sum_lengths("l").cast("long").alias("line_chars"), _sum_lengths("once").cast("long").alias("line_chars_once"),
        F.col("stops").cast("long").alias("n_stop_words"),
        F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).cast("long").alias("longest_word"),
        F.expr(r"size(filter(w, x -> x rlike '\\p{L}'))").cast("long").alias("n_letter_words"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"), _count("!").cast("long").alias("n_exclaims"),
        F.expr(r"size(filter(l, x -> x rlike '^\\s*[-*\u2022]'))").cast("long").alias("n_bullets"),
        F.expr(r"size(filter(l, x -> x rlike '(\\.\\.\\.|\u2026)\\s*$'))").cast("long").alias("n_ellipses"))


def compiled(rules=RULES) -> Column:
    """Names of the rules that fail, comma-joined, as one column over the statistics."""
    tests = []
    for r in rules:
        bounds = [f"({r.stat}) < {r.least}"] * (r.least is not None) + [f"({r.stat}) > {r.most}"] * (r.most is not None)
        tests.append(F.expr(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END"))
    return F.concat_ws(",", *tests)


def judged(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics with ``failed`` (names of failed rules)."""
    return statistics(docs, id_col, text_col).withColumn("failed", compiled(rules))
