"""Record linkage: match source records to anchor players, settle conflicts, merge.

Tables: anchors(code, names array, team_code, minutes, birth_date); records(source, source_id,
name, team_label, team_codes array, birth_date); links(source, source_id, code, score, method).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as NM
from touchline.operators import search as SE
from touchline.operators.common import sliced_join, spread, stage, top_per
from touchline.params import LinkParams

_L = LinkParams()
REC = ["source", "source_id"]
#: Fields of a spelled name.
NAME = ("norm", "sorted", "toks")
#: Names of one birth date are compared pair by pair up to so many pairs.
FEW_PAIRS = 50_000_000


def build_anchors(players: DataFrame, fact: DataFrame) -> DataFrame:
    """Anchors from players (code, known_name, first_name, second_name, web_name, team_code,
    birth_date) and their minutes; the known or full name comes first."""
    minutes = fact.groupBy("code").agg(F.sum(F.coalesce("minutes", F.lit(0))).cast("double").alias("minutes"))
    full = F.concat_ws(" ", "first_name", "second_name")
    known = F.when(F.col("known_name") != "", F.col("known_name"))
    names = F.array_distinct(F.array_compact(F.array(known, full, F.col("web_name"))))
    return (players.select("code", names.alias("names"), "team_code", "birth_date")
            .join(minutes, "code", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0.0))))


def build_records(rows: DataFrame, clubs: DataFrame, source: str) -> DataFrame:
    """One record per source player: last name, every club played for, birth date if known.

    ``rows``: source_id, name, club, birth_date (may be NULL); ``clubs``: club, team_code.
    A player's clubs are a handful, so the collected sets stay small.
    """
    joined = rows.join(clubs.select("club", "team_code"), "club", "left")
    return joined.groupBy("source_id").agg(
        F.max("name").alias("name"), F.array_sort(F.collect_set("team_code")).alias("team_codes"),
        F.array_join(F.array_sort(F.collect_set("club")), ", ").alias("team_label"),
        F.max("birth_date").alias("birth_date")).withColumn("source", F.lit(source))


def candidate_pairs_block(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """Record x anchor pairs that share a club."""
    r = records.select(*REC, F.explode(F.array_distinct("team_codes")).alias("team_code"))
    return r.join(anchors.select("code", "team_code"), "team_code").select(*REC, "code").distinct()


def name_pairs(records: DataFrame, anchors: DataFrame, rows_per_slice: int = 20_000) -> DataFrame:
    """a, b: every normalised anchor's name and record's name that share a club, once.

    ``records``: team_code, name; ``anchors``: team_code, n. A club's names are one row until they lie by the record's name, where
    they are told apart, so pairs are never dealt out: a record's name goes there once per club with the club's names. A name of
    many records is cut into slices by the other name.
    """
    clubs = (anchors.filter("team_code is not null").select("team_code", NM.normalise_name("n").alias("a")).groupBy("team_code").agg(
        F.collect_set("a").alias("names"), F.count_if(F.col("a").isNull()).alias("nameless")))
    # A set has no NULL; an anchor without a name makes a pair as well.
    names = F.when(F.col("nameless") > 0, F.array_append("names", F.lit(None).cast("string"))).otherwise(F.col("names"))
    clubs = clubs.select("team_code", F.array_sort(names).alias("names"))
    own = records.filter("team_code is not null").select("team_code", NM.normalise_name("name").alias("b"))
    hot = stage(own.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / rows_per_slice).cast("int").alias("slices")).filter("slices > 1"), "hot-names")
    met = own.join(clubs, "team_code").join(hot.withColumnRenamed("b", "hot"), F.col("b").eqNullSafe(F.col("hot")), "left")
    n = F.coalesce("slices", F.lit(1))
    cut = met.select("b", "names", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("slice"))
    mine = F.filter("names", lambda a: F.pmod(F.xxhash64(a), F.col("n")) == F.col("slice"))
    cut = cut.select("b", "slice", F.when(F.col("n") == 1, F.col("names")).otherwise(mine).alias("names")).filter(F.size("names") > 0)
    # One text is dealt out rather than an array: normalised names hold neither bar nor dash.
    dealt = spread(cut.withColumn("names", F.array_join("names", "|", "-")), "b", "slice")
    return dealt.select("b", "slice", F.explode(F.split("names", r"\|")).alias("a")).withColumn("a", F.nullif("a", F.lit("-"))).distinct().select("a", "b")


def _score(p: LinkParams) -> Column:
    return NM.name_score(F.col("spellings"), F.col("spelled"), p)


def _spelled_records(records: DataFrame) -> DataFrame:
    return records.withColumn("spelled", NM.spelled("name"))


def pair_scores(records: DataFrame, anchors: DataFrame, p: LinkParams = _L) -> DataFrame:
    """Name score of every record against the anchors of its clubs, the best over the anchor's spellings.

    Names are dealt out as they are and spelled where they lie. Spellings are rows of plain columns, since expressions over
    arrays of them are not compiled; the rows of a pair lie in one task after the join and meet there again.
    """
    r = records.select(*REC, "name", F.col("birth_date").alias("record_birth"), F.explode(F.array_distinct("team_codes")).alias("team_code"))
    # An anchor without any name keeps its pairs, at 0.
    a = anchors.select("code", "team_code", F.col("birth_date").alias("anchor_birth"), "names")

    def spelled(df: DataFrame, prefix: str) -> DataFrame:
        return NM.with_spelling(df, "name", prefix).drop("name", f"{prefix}toks")

    def apart(df: DataFrame) -> DataFrame:
        return df.select("*", (F.size("names") > 0).alias("named"), F.explode_outer("names").alias("name")).drop("names")

    met = sliced_join(r, a, "team_code", "source_id", keep_slice=True, dealt=(lambda df: spelled(df, "r_"), lambda df: spelled(apart(df), "a_")))
    met = met.withColumns({f"{s}toks": NM.split_name(F.col(f"{s}norm")) for s in ("a_", "r_")})
    score = NM.spelling_score(*[{f: F.col(s + f) for f in NAME} for s in ("a_", "r_")], p)
    keys = ["team_code", "__slice", *REC, "code", "record_birth", "anchor_birth"]
    best = met.select(*keys, F.when(F.col("named"), score).alias("score")).groupBy(*keys).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return best.select(*REC, "code", "score", "record_birth", "anchor_birth")


def names_born_together(records: DataFrame, anchors: DataFrame, p: LinkParams = _L, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """born, r_norm, a_norm of all names of one birth date that score the acceptance score or more; a pair can come twice.

    ``records``: born, r_norm, r_sorted, r_toks; ``anchors``: born, a_norm, a_sorted, a_toks and columns that are kept; every name
    of a date once, whoever bears it. A score that high comes from strings of few edits or from a token rule, which needs the surname of one among the
    tokens of the other. For the edits the names of a date are compared pair by pair, with a distance that gives up beyond the
    edits allowed; only on a date of more than ``few_pairs`` pairs they must share a piece (``similar_strings``), since names that
    have most pieces in common (one word in all of them, say) meet once per piece and place. Hot keys are cut into slices.
    """
    sizes = [df.groupBy("born").agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in ((records, "__r"), (anchors, "__a"))]
    crowded = stage(sizes[0].join(sizes[1], "born").filter(F.col("__r") * F.col("__a") > few_pairs).select("born"), "link-crowded")
    any_crowded = not crowded.isEmpty()
    r, a = (df.join(crowded, "born", "left_anti") if any_crowded else df for df in (records, anchors))

    longest = F.greatest(F.length("a_norm"), F.length("r_norm"))
    most = F.floor(longest * ((100.0 - p.accept_score) / 100.0) + 1e-6).cast("int")

    def close(form: str) -> Column:
        edits = F.call_function("levenshtein", F.col(f"a_{form}"), F.col(f"r_{form}"), most)
        return (edits >= 0) & (NM.share_kept(edits, longest) >= p.accept_score)

    # Both forms of a name have the same letters.
    alike = (F.abs(F.length("a_norm") - F.length("r_norm")) <= most) & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("r_letters"))) <= 2 * most)
    in_order = (F.col("a_norm") == F.col("a_sorted")) & (F.col("r_norm") == F.col("r_sorted"))
    met = sliced_join(r.withColumn("r_letters", NM.letters("r_norm")), a.withColumn("a_letters", NM.letters("a_norm")), "born", "r_norm", rows_per_slice=1_000)
    found = [met.filter(alike & (close("norm") | (~in_order & close("sorted"))))]
    if any_crowded:
        r, a = (df.join(crowded, "born", "left_semi") for df in (records, anchors))
        for form in ("norm", "sorted"):
            near = SE.similar_strings(r.select("born", F.col(f"r_{form}").alias("q")), a.select("born", F.col(f"a_{form}").alias("key")), p.accept_score, by=["born"])
            near = near.select("born", F.col("q").alias(f"r_{form}"), F.col("key").alias(f"a_{form}"))
            found.append(r.join(near, ["born", f"r_{form}"]).join(a, ["born", f"a_{form}"]))

    def keyed(df: DataFrame, tokens: Column) -> DataFrame:
        return df.withColumn("__token", F.explode(tokens)).withColumn("key", F.concat_ws("|", F.col("born").cast("string"), "__token")).drop("__token")

    def held(toks: str) -> Column:
        # A name without tokens, or none at all, equals such names only; the empty token stands for it.
        return F.when(F.size(toks) > 0, F.array_distinct(toks)).otherwise(F.array(F.lit("")))

    def last(toks: str) -> Column:
        return F.when(F.size(toks) > 0, F.array(F.try_element_at(toks, F.lit(-1)))).otherwise(F.array(F.lit("")))

    bare = [c for c in anchors.columns if c not in ("born", "a_sorted", "a_toks")]
    enough = (NM.token_rule("a_toks", "r_toks", (p.token_score, p.initial_score), 0.0) >= p.accept_score) | (longest == 0)
    for mine, theirs in ((last, held), (held, last)):
        # Names are dealt out without what can be made of them again.
        met = sliced_join(keyed(records, mine("r_toks")).select("key", "born", "r_norm"), keyed(anchors, theirs("a_toks")).select("key", *bare), "key", "r_norm")
        found.append(met.withColumns({f"{s}toks": NM.split_name(F.col(f"{s}norm")) for s in ("a_", "r_")}).filter(enough))
    return reduce(DataFrame.unionByName, [df.select("born", "r_norm", *bare) for df in found])


def _keyed(df: DataFrame, norm: str) -> DataFrame:
    """Normalised names as keys of a join: no name is a key of its own, which no normalised name equals."""
    return df.withColumn(norm, F.coalesce(norm, F.lit("-")))


def born_together(records: DataFrame, anchors: DataFrame, p: LinkParams = _L, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """REC, code, score of all records and anchors with one birth date whose name score is the acceptance score or more.

    ``records``: REC, born, spelled; ``anchors``: code, born, spellings.
    """
    r = records.select(*REC, "born", *[F.col(f"spelled.{f}").alias(f"r_{f}") for f in NAME])
    a = anchors.select("code", "born", F.explode("spellings").alias("s")).select("code", "born", *[F.col(f"s.{f}").alias(f"a_{f}") for f in NAME])
    names = names_born_together(r.drop(*REC).dropDuplicates(["born", "r_norm"]), a.drop("code").dropDuplicates(["born", "a_norm"]), p, few_pairs)
    pairs = (_keyed(_keyed(names.distinct(), "r_norm"), "a_norm").join(_keyed(r.select(*REC, "born", "r_norm"), "r_norm"), ["born", "r_norm"])
             .join(_keyed(a.select("code", "born", "a_norm"), "a_norm"), ["born", "a_norm"]).select(*REC, "code").distinct())
    named = pairs.join(records.select(*REC, "spelled"), REC).join(anchors.select("code", "spellings"), "code")
    return (spread(named, *REC, "code").withColumn("score", _score(p)).filter(F.col("score") >= p.accept_score).select(*REC, "code", "score"))


def only_born_together(records: DataFrame, anchors: DataFrame, p: LinkParams = _L, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """``born_together`` of the records that have one such anchor, without a row for every pair of the others.

    ``records``: REC, name, born; ``anchors``: code, names, born. Names are matched once per date, whoever bears them, each with the
    smallest and the largest code that bears it: where these are the same over all matched names of a record, it has one anchor.
    """
    # Both are read by every branch of the search, and spelling names is dear, so the names of both sides are written once.
    r = stage(NM.with_spelling(records.select("born", "name").distinct(), "name", "r_").drop("name").dropDuplicates(["born", "r_norm"]), "link-record-names")
    a = NM.with_spelling(anchors.filter(F.col("code").isNotNull()).select("code", "born", F.explode("names").alias("name")), "name", "a_")
    a = a.groupBy("born", "a_norm").agg(F.first("a_sorted").alias("a_sorted"), F.first("a_toks").alias("a_toks"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    a = stage(a.join(r.select("born").distinct(), "born", "left_semi"), "link-anchor-names")
    code = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    seen = _keyed(names_born_together(r, a, p, few_pairs), "r_norm").groupBy("born", "r_norm").agg(*code)
    spelled = _keyed(records.select(*REC, "born", NM.normalise_name("name").alias("r_norm")), "r_norm")
    lone = (spelled.join(seen, ["born", "r_norm"]).groupBy(*REC).agg(*code).filter(F.col("lo") == F.col("hi")).select(*REC, F.col("lo").alias("code")))
    named = lone.join(_spelled_records(records).select(*REC, "spelled"), REC).join(anchors.select("code", "names"), "code")
    scored = spread(named, *REC, "code").withColumn("spellings", F.transform("names", NM.spelled)).withColumn("score", _score(p)).filter(F.col("score") >= p.accept_score)
    # A record or an anchor that is there twice is no single match.
    return scored.groupBy(*REC).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code"), F.max("score").alias("score")).filter("n = 1").drop("n")


def link_decide(records: DataFrame, anchors: DataFrame, overrides: DataFrame,
                p: LinkParams = _L) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, review, bad overrides) before conflicts are settled.

    ``overrides``: source, source_id, code. A bad override names no anchor.
    """
    known = anchors.select("code").distinct()
    bad = overrides.join(known, "code", "left_anti")
    forced = overrides.join(known, "code", "left_semi").select(*REC, F.col("code").alias("forced"))
    base = records.join(forced, REC, "left")
    open_ = base.filter(F.col("forced").isNull())

    # Read twice below, and scoring names is the dear part, so the scores are written once.
    scores = stage(pair_scores(open_, anchors, p), "link-scores")
    order = [F.desc("score"), F.asc("code")]
    top2 = top_per(scores, REC, order, 2, rank="rank")

    def pick(rank: int, what: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, what))

    best = top2.groupBy(*REC).agg(
        pick(1, F.col("code")).alias("best"), pick(1, F.col("score")).alias("best_score"),
        pick(1, F.col("anchor_birth")).alias("best_birth"), pick(2, F.col("score")).alias("second"))
    same_day = (scores.filter(F.col("record_birth") == F.col("anchor_birth")).groupBy(*REC)
                .agg(F.count(F.lit(1)).alias("n_day"), F.min("code").alias("day_code"), F.max("score").alias("day_score")))
    rows = open_.join(best, REC, "left").join(same_day, REC, "left")
    by_day = (F.coalesce("n_day", F.lit(0)) == 1) & (F.col("day_score") >= p.dob_confirm_score)
    margin = F.col("best_score") - F.coalesce("second", F.lit(0.0))
    reason = (F.when(by_day, F.lit(None).cast("string"))
              .when(F.col("best").isNull(), F.lit("no anchor players at this club"))
              .when(F.col("best_score") < p.accept_score, F.lit("best score below the acceptance score"))
              .when(margin < p.min_margin, F.lit("ambiguous: runner-up within the margin"))
              .when(F.col("birth_date") != F.col("best_birth"), F.lit("date of birth mismatch")))
    rows = rows.withColumn("by_day", by_day).withColumn("reason", reason)

    accepted_columns = (
        *REC, F.when(F.col("by_day"), F.col("day_code")).otherwise(F.col("best")).alias("code"),
        F.bround(F.when(F.col("by_day"), F.col("day_score")).otherwise(F.col("best_score")), 1).alias("score"),
        F.when(F.col("by_day"), F.lit("dob")).otherwise(F.lit("fuzzy")).alias("method"))
    rows = stage(rows, "link-decided")
    accepted = rows.filter("reason is null").select(*accepted_columns)
    unsure = rows.filter("reason is not null")
    dated = unsure.filter(F.col("birth_date").isNotNull()).select(*REC, "name", F.col("birth_date").alias("born"))
    born = anchors.filter(F.col("birth_date").isNotNull()).select("code", "names", F.col("birth_date").alias("born"))
    # Read by both results.
    elsewhere = stage(only_born_together(dated, born, p).select(*REC, "code", F.bround("score", 1).alias("score"), F.lit("dob_any_club").alias("method")), "link-elsewhere")
    override = base.filter(F.col("forced").isNotNull()).select(
        *REC, F.col("forced").alias("code"), F.lit(100.0).alias("score"), F.lit("override").alias("method"))
    links = accepted.unionByName(elsewhere).unionByName(override)
    review = (unsure.join(elsewhere.select(*REC), REC, "left_anti")
              .select(*REC, "name", "team_label", F.col("best").alias("best_candidate"),
                      F.bround("best_score", 1).alias("score"), "reason"))
    return links, review, bad


def link_conflicts(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, losers): one link per source and anchor.

    An override beats everything, then the higher score, then the earlier record id.
    """
    order = [F.desc(F.col("method") == "override"), F.desc("score"), F.asc("source_id")]
    kept = top_per(links, ["source", "code"], order)
    lost = links.join(kept.select(*REC), REC, "left_anti")
    return kept, lost.withColumn("reason", F.lit("outranked by a record of the same source for this player"))


def link_mapping(links: DataFrame, anchors: DataFrame, sources=("understat", "transfermarkt")) -> DataFrame:
    """One row per anchor with its linked id in each source (NULL if unlinked)."""
    wide = links.groupBy("code").agg(*[
        F.max(F.when(F.col("source") == s, F.col("source_id"))).alias(f"{s}_id") for s in sources])
    return anchors.select("code", F.try_element_at("names", F.lit(1)).alias("canonical_name")).join(wide, "code", "left")


def link_edges(links: DataFrame) -> DataFrame:
    return links.select(F.concat(F.lit("fpl:"), F.col("code").cast("string")).alias("a"),
                        F.concat_ws(":", "source", "source_id").alias("b"))


def link_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)``: node, component (its smallest node).

    Every round each node takes the smallest label around it and then that label's own
    label, so a chain halves per round. Each round is written to the shared folder; the loop
    ends when no label changes.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .distinct(), "link-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component"))
    labels = stage(labels, "link-labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        lowest = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        step = lowest.join(jump, "low", "left").select(
            "node", "old", F.least("low", F.coalesce("up", "low")).alias("component"))
        step = stage(step, "link-labels")
        labels = step.select("node", "component")
        if step.filter(F.col("old") != F.col("component")).limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
