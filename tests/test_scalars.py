from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.functions import names as NM
from touchline.functions import scalars as S


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def d(x):
    return F.lit(x).cast("double")


def test_rates(spark):
    assert one(spark, S.per90(d(3), d(180)), S.per90(d(None), d(90)), S.per90(d(3), d(0)), S.nineties(d(-5)),
               S.ratio(d(1), d(0)), S.ratio(d(1), d(4))) == (1.5, None, None, 0.0, None, 0.25)


def test_blend_counts_minutes_only_with_a_known_rate(spark):
    both, alone, none = (S.blend(a, d(900), b, d(3000)) for a, b in ((d(1.0), d(2.0)), (d(1.0), d(None)), (d(None), d(None))))
    r = one(spark, both["rate"], both["minutes"], both["used_previous"], alone["rate"], alone["minutes"], alone["used_previous"],
            none["rate"], none["minutes"])
    assert r[0] == pytest.approx((900 + 1000 * 2) / 1900)
    assert r[1:] == (1900.0, True, 1.0, 900.0, False, None, 0.0)


def test_blend_lies_between_the_rates(spark):
    rows = [(a / 7, m1 * 100.0, b / 3, m2 * 130.0) for a in range(5) for b in range(5) for m1 in range(1, 4) for m2 in range(1, 4)]
    df = spark.createDataFrame(rows, "a double, m1 double, b double, m2 double").withColumn("r", S.blend("a", "m1", "b", "m2")["rate"])
    assert df.filter((F.col("r") < F.least("a", "b") - 1e-9) | (F.col("r") > F.greatest("a", "b") + 1e-9)).count() == 0


def test_shrink_and_multiplier(spark):
    r = one(spark, S.shrink(d(2.0), d(900), d(1.0), 10.0), S.shrink(d(None), d(900), d(1.0), 10.0), S.possession_multiplier(d(0.5)),
            S.possession_multiplier(d(0.1)), S.possession_multiplier(d(0.9)), S.possession_multiplier(d(None)), S.possession_multiplier(d(0)))
    assert r == (1.5, None, 1.0, 1.5, 0.67, None, None)
    with pytest.raises(ValueError):
        S.shrink(d(1), d(1), d(1), 0)


def test_cleaning(spark):
    money = ["€32.00m", "€800k", "€1.20bn", "32000000", "-", "n/a", "lots", "€ 5 th."]
    got = one(spark, *[S.clean_money(F.lit(m))["value"] for m in money])
    assert got == (32_000_000, 800_000, 1_200_000_000, 32_000_000, None, None, None, 5000)
    assert one(spark, S.clean_money(F.lit("lots"))["bad"], S.clean_money(F.lit("-"))["bad"]) == (True, False)
    dates = ["2026-06-10", "Jun 10, 2026", "10.06.2026", "2026-06-10T00:00:00", "?", "tomorrow"]
    assert one(spark, *[S.clean_multi_date(F.lit(x))["value"] for x in dates]) == (dt.date(2026, 6, 10),) * 4 + (None, None)
    assert one(spark, S.clean_share(F.lit("43.4%"))["value"], S.clean_share(F.lit("101"))["bad"], S.clean_share(F.lit(""))["bad"],
               S.clean_bool(F.lit(" TRUE"))["value"], S.clean_bool(F.lit("maybe"))["bad"]) == (0.434, True, False, True, True)


def test_seasons_and_ages(spark):
    assert one(spark, S.previous_season(F.lit("2026-27")), S.previous_season(F.lit("2000-01")), S.previous_season(F.lit("2026-27"), 2)) == (
        "2025-26", "1999-00", "2024-25")
    assert one(spark, *[S.age_bucket(d(a), (21, 24, 27, 30)) for a in (21.0, 21.1, 30.0, 35.0, None)]) == (0, 1, 3, 4, None)


def test_scores(spark):
    assert one(spark, *[S.percentile_band(d(p)) for p in (90, 75, 50, 25, 24.9, None)]) == (
        "elite", "strong", "above_average", "below_average", "weak", None)
    rel = one(spark, S.reliability(d(2500), F.lit("a"), d(None)), S.reliability(d(1250), F.lit("x"), d(None)), S.reliability(d(None), F.lit(None), d(50)),
              S.reliability(d(None), F.lit(None), d(None)))
    assert rel == (pytest.approx(100), pytest.approx(50), pytest.approx(50), None)
    assert one(spark, S.age_profile(d(25), F.lit(24), F.lit(28)), S.age_profile(d(30), F.lit(24), F.lit(28)), S.age_profile(d(50), F.lit(24), F.lit(28)),
               S.age_profile(d(None), F.lit(24), F.lit(28))) == (100.0, 70.0, 0.0, None)
    assert one(spark, *[S.upgrade_gate(d(a), d(b)) for a, b in ((None, 1), (50, None), (60, 45), (59, 45))]) == (
        "insufficient_data", "no_incumbent", "upgrade", "sideways")
    fit = S.fit_score({"need_fill": d(80), "role_quality": d(60), "reliability": d(None), "style_fit": d(None), "age_profile": d(100)})
    total, used = one(spark, fit["total"], fit["weights_used"])
    assert total == pytest.approx((0.4 * 80 + 0.25 * 60 + 0.1 * 100) / 0.75)
    assert sum(used.values()) == pytest.approx(1) and set(used) == {"need_fill", "role_quality", "age_profile"}


def test_names(spark):
    assert one(spark, NM.normalise_name(F.lit("  Martin Ødegaard ")), NM.normalise_name(F.lit("Heung-Min Son")), NM.sorted_tokens(F.lit("Son Heung-min")),
               NM.normalise_name(F.lit("Brighton & Hove"), ampersand=True), NM.normalise_name(F.lit("İbrahim Şükür")), NM.normalise_name(F.lit("Groß"))) == (
        "martin odegaard", "heung min son", "heung min son", "brighton and hove", "ibrahim sukur", "gross")
    assert one(spark, NM.edit_similarity(F.lit(""), F.lit("")), NM.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == (
        100.0, pytest.approx(100 * (1 - 3 / 7)))


@pytest.mark.parametrize("anchor,candidate,rule", [
    ("bruno borges fernandes", "bruno fernandes", "tokens"), ("daniel ballard", "dan ballard", "tokens"), ("alisson becker", "alisson", "tokens"),
    ("fernandes", "bruno fernandes", None), ("matthew cash", "matty cash", "initial"), ("jo hart", "joe hart", "initial"),
    ("ana ana silva", "ana silva", "tokens"), ("ana silva", "ana ana silva", "tokens"), ("danny ward", "joel ward", None), ("a b", "", None),
    ("dan daniel x", "daniel dan x", "tokens"), ("dan daniel x", "daniel danny x", None)])
def test_token_match(spark, anchor, candidate, rule):
    # The last case is greedy: "dan" takes "daniel", the first match, and leaves only "danny".
    assert one(spark, NM.token_match(F.lit(anchor), F.lit(candidate)))[0] == rule
