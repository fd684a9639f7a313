"""Column expressions: rates, blending, clean-up and scoring, all JVM-side built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.params import FitParams, Methodology, ReportParams

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = DAYS_PER_YEAR / 12
_M = Methodology()
_FIT = FitParams()
_REP = ReportParams()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def per90(total, minutes) -> Column:
    """Rate per 90 minutes; NULL when the total or positive minutes are missing."""
    return F.when(_c(minutes) > 0, _c(total) * F.lit(_M.match_minutes) / _c(minutes))


def nineties(minutes) -> Column:
    return F.greatest(_c(minutes), F.lit(0.0)) / F.lit(_M.match_minutes)


def ratio(numerator, denominator) -> Column:
    """Quotient with NULL when either side is missing or the denominator is not positive."""
    return F.when(_c(denominator) > 0, _c(numerator) / _c(denominator))


def blend(rate_cur, minutes_cur, rate_prev, minutes_prev, *, lam: float = _M.blend_lambda,
          cap: float = _M.prev_minutes_cap) -> Column:
    """Minutes-weighted blend of two seasons -> struct(rate, minutes, used_previous).

    A season's minutes only count when its rate is known.
    """
    r_cur, r_prev = _c(rate_cur), _c(rate_prev)
    known_cur = F.when(r_cur.isNotNull(), F.greatest(_c(minutes_cur), F.lit(0.0)))
    known_prev = F.when(r_prev.isNotNull(), F.greatest(_c(minutes_prev), F.lit(0.0)))
    m_cur = F.coalesce(known_cur, F.lit(0.0))
    w_prev = F.lit(lam) * F.least(F.coalesce(known_prev, F.lit(0.0)), F.lit(cap))
    weight = m_cur + w_prev
    mean = (m_cur * F.coalesce(r_cur, F.lit(0.0)) + w_prev * F.coalesce(r_prev, F.lit(0.0))) / weight
    return F.struct(
        F.when(weight > 0, mean).alias("rate"),
        F.when(weight > 0, weight).otherwise(F.lit(0.0)).alias("minutes"),
        (w_prev > 0).alias("used_previous"),
    )


def shrink(rate, minutes, prior, k) -> Column:
    """Empirical-Bayes pull toward ``prior``; ``k`` is in nineties and must be positive."""
    if isinstance(k, int | float):
        if k <= 0:
            raise ValueError("k must be positive")
        k = F.lit(float(k))
    n = nineties(minutes)
    return (n * _c(rate) + _c(k) * _c(prior)) / (n + _c(k))


def possession_multiplier(share, lo: float = _M.multiplier_min, hi: float = _M.multiplier_max,
                          even: float = _M.even_share) -> Column:
    s = _c(share)
    return F.when(s > 0, F.least(F.greatest(F.lit(even) / s, F.lit(lo)), F.lit(hi)))


def padj_status(matches, unadjusted) -> Column:
    n, u = F.coalesce(_c(matches), F.lit(0)), F.coalesce(_c(unadjusted), F.lit(0))
    return (F.when((n == 0) | (u == n), F.lit("unadjusted"))
            .when(u == 0, F.lit("adjusted")).otherwise(F.lit("partial")))


# Formats of market values and dates at the sources.
MONEY_PATTERN = r"^€?([0-9.,]+)(bn|m|k|th\.)?$"
MONEY_UNITS = {"bn": 1e9, "m": 1e6, "k": 1e3, "th.": 1e3, "": 1.0}
MISSING_TOKENS = ("", "-", "?", "n/a")


def _missing(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING_TOKENS)


def clean_money(s) -> Column:
    """struct(value bigint, bad boolean) from "€32.00m", "€800k", "€1.20bn" or plain numbers."""
    text = _c(s).cast("string")
    squeezed = F.lower(F.regexp_replace(F.trim(text), " ", ""))
    number = F.regexp_replace(F.regexp_extract(squeezed, MONEY_PATTERN, 1), ",", "")
    number = number.try_cast("double")
    unit = catalogue.literal_map(MONEY_UNITS)[F.regexp_extract(squeezed, MONEY_PATTERN, 2)]
    matched = squeezed.rlike(MONEY_PATTERN) & number.isNotNull()
    return F.struct(
        F.when(~_missing(text) & matched, F.rint(number * unit).cast("bigint")).alias("value"),
        (~_missing(text) & ~matched).alias("bad"),
    )


def clean_multi_date(s) -> Column:
    """struct(value date, bad boolean) from ISO, "Jun 10, 2026" or "10.06.2026"."""
    text = F.trim(_c(s).cast("string"))
    parsed = F.coalesce(
        F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))),
        F.to_date(F.try_to_timestamp(text, F.lit("MMM d, yyyy"))),
        F.to_date(F.try_to_timestamp(text, F.lit("d.M.yyyy"))),
    )
    return F.struct(
        F.when(~_missing(text), parsed).alias("value"),
        (~_missing(text) & parsed.isNull()).alias("bad"),
    )


def clean_share(s) -> Column:
    """struct(value double in [0, 1], bad boolean) from "43.4%", "43.4" or 43.4."""
    text = F.trim(F.regexp_replace(F.trim(_c(s).cast("string")), "%+$", ""))
    blank = text.isNull() | (text == "")
    number = text.try_cast("double")
    good = number.isNotNull() & number.between(0.0, 100.0)
    return F.struct(
        F.when(~blank & good, number / F.lit(100.0)).alias("value"),
        (~blank & ~F.coalesce(good, F.lit(False))).alias("bad"),
    )


def clean_bool(s) -> Column:
    """struct(value boolean, bad boolean) from True/1/False/0 in any case."""
    text = F.lower(F.trim(_c(s).cast("string")))
    value = F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))
    return F.struct(value.alias("value"), value.isNull().alias("bad"))


def strict(cleaned: Column, raw, what: str) -> Column:
    """The value of a ``clean_*`` struct; text that could not be read stops the job and is named."""
    told = F.concat(F.lit(f"unreadable {what}: "), F.coalesce(_c(raw).cast("string"), F.lit("null")))
    return F.when(cleaned["bad"], F.raise_error(told)).otherwise(cleaned["value"])


def season_label(start_year) -> Column:
    """"YYYY-YY" for the season starting in ``start_year``."""
    y = _c(start_year).cast("int")
    return F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100)))


def season_start(season) -> Column:
    return F.substring(_c(season), 1, 4).cast("int")


def previous_season(season, n: int = 1) -> Column:
    """Label of the n-th season before ``season``."""
    return season_label(season_start(season) - n)


def previous_seasons(season, n: int) -> Column:
    """Array of the n season labels before ``season``, newest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda i: season_label(season_start(season) - i))


def age_on(birth, as_of) -> Column:
    return F.datediff(_c(as_of), _c(birth)) / F.lit(DAYS_PER_YEAR)


def age_bucket(age, edges: Sequence[float]) -> Column:
    """Index of the first edge at or above the age; ``len(edges)`` beyond; NULL if unknown."""
    a = _c(age)
    out = F.when(a.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        out = out.when(a <= edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def percentile_band(p, r: ReportParams = _REP) -> Column:
    x = _c(p)
    return (F.when(x >= r.elite, F.lit("elite")).when(x >= r.strong, F.lit("strong"))
            .when(x >= r.above_average, F.lit("above_average"))
            .when(x >= r.below_average, F.lit("below_average"))
            .when(x.isNotNull(), F.lit("weak")))


def weighted_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the known values with their weights renormalised; NULL if none is known."""
    zero = F.lit(0.0)
    known = [F.when(v.isNotNull(), F.lit(w)).otherwise(zero) for v, w in parts]
    total = sum((F.coalesce(v, zero) * w for v, w in parts), zero)
    weight = sum(known, zero)
    return F.when(weight > 0, total / weight)


def reliability(minutes, status, chance, p: FitParams = _FIT) -> Column:
    """Minutes volume (0.6) and availability (0.4), 0-100, over the known parts."""
    volume = F.least(F.lit(1.0), F.greatest(_c(minutes), F.lit(0.0)) / p.full_minutes)
    volume = F.when(_c(minutes).isNotNull(), volume)
    ch = _c(chance)
    by_chance = F.when(ch.isNotNull(), F.least(F.greatest(ch, F.lit(0.0)), F.lit(100.0)) / 100.0)
    by_status = F.try_element_at(catalogue.literal_map(catalogue.STATUS_AVAILABILITY), _c(status))
    mean = weighted_mean([(volume, p.volume_weight),
                          (F.coalesce(by_chance, by_status), p.availability_weight)])
    return F.lit(100.0) * mean


def age_profile(age, lo, hi, penalty: float = _FIT.penalty_per_year) -> Column:
    a = _c(age)
    outside = F.greatest(_c(lo) - a, a - _c(hi), F.lit(0.0))
    return F.when(a.isNotNull() & _c(lo).isNotNull(),
                  F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(penalty) * outside))


def upgrade_gate(need_fill, incumbent_need_fill, delta: float = _FIT.upgrade_delta) -> Column:
    a, b = _c(need_fill), _c(incumbent_need_fill)
    return (F.when(a.isNull(), F.lit("insufficient_data"))
            .when(b.isNull(), F.lit("no_incumbent"))
            .when(a - b >= delta, F.lit("upgrade")).otherwise(F.lit("sideways")))


def band_label(value, low, high) -> Column:
    v = _c(value)
    return (F.when(v < _c(low), F.lit("Undervalued"))
            .when(v > _c(high), F.lit("Premium"))
            .when(v.isNotNull() & _c(low).isNotNull() & _c(high).isNotNull(), F.lit("Fair")))


def harmonic_mean(a, b) -> Column:
    x, y = _c(a), _c(b)
    return F.when(x + y > 0, F.lit(2.0) * x * y / (x + y)).when((x + y).isNotNull(), F.lit(0.0))


def iso_utc(ts) -> Column:
    """ISO-8601 text in UTC (the session time zone is UTC); NULL stays NULL."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def alias_json(aliases, name) -> Column:
    """JSON list of the distinct aliases without the club's own name."""
    return F.to_json(F.array_remove(F.array_distinct(_c(aliases)), _c(name)))


def parse_alias_json(text) -> Column:
    return F.from_json(_c(text), "array<string>")


def fit_score(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """struct(total, weights_used map) over the components with evidence."""
    weights = weights or catalogue.FIT_WEIGHTS
    known = F.map_filter(
        F.create_map(*[x for n in weights for x in (F.lit(n), components[n].cast("double"))]),
        lambda _n, v: v.isNotNull(),
    )
    w = catalogue.literal_map(weights)
    weight = F.aggregate(F.map_keys(known), F.lit(0.0), lambda acc, n: acc + w[n])
    total = weighted_mean([(components[n].cast("double"), x) for n, x in weights.items()])
    return F.struct(
        total.alias("total"),
        F.transform_values(known, lambda n, _v: w[n] / weight).alias("weights_used"),
    )
