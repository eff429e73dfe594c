"""Score accounts against known people and decide auto_match / quarantine / unmatched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.functions import similarity, text
from accessloom.operators import fuzzy
from accessloom.operators.joins import lookup
from accessloom.operators.rank import first_per_key
from accessloom.session import cut_lineage


@dataclass(frozen=True)
class CorrelationPolicy:
    corporate_domains: tuple[str, ...]
    # Fixed values of the scoring policy.
    employee_id_weight: int = 65
    corporate_local_weight: int = 60
    other_local_weight: int = 40
    exact_name_bonus: int = 20
    fuzzy_name_bonus: int = 15
    fuzzy_threshold: int = 90
    auto_match_at: int = 80
    quarantine_at: int = 50
    clear_lead: int = 10


INLINE_NAMES = 16
SHOWN_CANDIDATES = 3
# Tiers of name agreement.
EQUAL, SIMILAR, NEITHER = 2, 1, 0
_CANDIDATE = "array<struct<identity_id:{id},name:string,tier:int>>"


def identifier_index(identities: DataFrame, aliases: DataFrame, alias_type: str) -> DataFrame:
    """(value, identity_id, name, norm_name) of one alias type."""
    named = identities.select("identity_id", "name", text.normalize_name(F.col("name")).alias("norm_name"))
    values = aliases.filter(F.col("alias_type") == alias_type).select("value", "identity_id").distinct()
    return values.join(named, "identity_id").select("value", "identity_id", "name", "norm_name")


def unique_holder(aliases: DataFrame, alias_type: str) -> DataFrame:
    """Holders per alias value: count and smallest identity, from map-side partial aggregates."""
    values = aliases.filter(F.col("alias_type") == alias_type).select("value", "identity_id").distinct()
    return values.groupBy("value").agg(
        F.count("*").alias("holders"), F.min("identity_id").alias("holder_id"))


def _smallest_name() -> Column:
    # Within a struct a null counts, as the smallest.
    return F.min(F.struct("name"))["name"].alias("name")


def _asked(probes: DataFrame, key: str) -> DataFrame:
    """Each (value, probe_name) that accounts ask for, once; no name counts as the empty one."""
    return cut_lineage(
        probes.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("value"), F.coalesce("norm_name", F.lit("")).alias("probe_name")).distinct())


def _case() -> Column:
    """One text for all that a score depends on, null without any identifier. Names hold no separator, and the length says
    where the employee id ends."""
    employee = F.coalesce("_employee_key", F.lit(""))
    return F.when(
        F.col("_employee_key").isNotNull() | F.col("_local_key").isNotNull(),
        F.concat_ws("\u0001", F.length(employee).cast("string"), employee, F.col("_corporate").cast("string"),
                    F.coalesce("_local_key", F.lit("")), "norm_name"))


def _agreeing(asked: DataFrame, names: DataFrame, policy: CorrelationPolicy) -> DataFrame:
    """(value, probe_name, index_name, tier) for the names known under a value that are equal or similar to an asked one.

    Where a value has at most INLINE_NAMES names all are compared, beyond that the similarity join finds them.
    """
    named = asked.filter(F.col("probe_name") != "")
    known = names.filter(F.col("index_name") != "")
    probe, index = F.col("probe_name"), F.col("index_name")
    equal = named.join(known, (named["value"] == known["value"]) & (probe == index), "left_semi").select(
        "value", "probe_name", probe.alias("index_name"), F.lit(EQUAL).alias("tier"))
    crowded = known.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > INLINE_NAMES).select("value")
    any_crowded = not crowded.isEmpty()
    few = named.join(crowded, "value", "left_anti") if any_crowded else named
    compared = few.join(known, "value").filter((probe != index) & similarity.at_least(probe, index, policy.fuzzy_threshold))
    found = equal.unionByName(compared.select("value", "probe_name", "index_name", F.lit(SIMILAR).alias("tier")))
    if not any_crowded:
        return found
    similar = fuzzy.similar_names(
        named.join(crowded, "value", "left_semi").select("value", probe.alias("name")),
        known.join(crowded, "value", "left_semi").select("value", index.alias("name")), ["value"])
    return found.unionByName(similar.filter(probe != index).select("value", "probe_name", "index_name", F.lit(SIMILAR).alias("tier")))


def _attach(probes: DataFrame, asked: DataFrame, index: DataFrame, key: str, out: str, policy: CorrelationPolicy) -> DataFrame:
    """Add array ``out`` of people, with their tier of name agreement, that can decide the outcome for identifier column ``key``.

    Ranking can use, exactly, the first three by tier and id: of the first three by id overall, of each equal and of each
    similar name. They are found once for each value and name that accounts ask for, so the work follows the distinct
    pairs and not the accounts times the holders, and no value ever lists all its holders.
    """
    id_type = dict(index.dtypes)["identity_id"]
    empty = F.array().cast(_CANDIDATE.format(id=id_type))
    if asked.isEmpty():
        return probes.withColumn(out, empty)
    # One row per person and name; of several spellings of a name the smallest is shown.
    holders = index.join(asked.select("value"), "value", "left_semi").groupBy(
        "value", F.coalesce("norm_name", F.lit("")).alias("index_name"), "identity_id").agg(_smallest_name())
    top = cut_lineage(first_per_key(holders, ["value", "index_name"], [F.col("identity_id")], SHOWN_CANDIDATES))
    agreeing = _agreeing(asked, top.select("value", "index_name").distinct(), policy).join(top, ["value", "index_name"])
    people = top.groupBy("value", "identity_id").agg(_smallest_name())
    heads = first_per_key(people, ["value"], [F.col("identity_id")], SHOWN_CANDIDATES)
    rows = agreeing.select("value", "probe_name", "identity_id", "name", "tier").unionByName(
        asked.join(heads, "value").withColumn("tier", F.lit(NEITHER)))
    # A person counts once, by the best tier, so that three different people are kept.
    best = rows.groupBy("value", "probe_name", "identity_id").agg(F.min(F.struct((-F.col("tier")).alias("rank"), "name")).alias("b"))
    best = best.select("value", "probe_name", "identity_id", "b.name", (-F.col("b.rank")).alias("tier"))
    rows = first_per_key(best, ["value", "probe_name"], [F.desc("tier"), F.col("identity_id")], SHOWN_CANDIDATES)
    listed = rows.groupBy("value", "probe_name").agg(
        F.collect_list(F.struct("identity_id", "name", "tier")).alias("_people")).select(
        F.concat_ws("\u0001", "value", "probe_name").alias("_asked_key"), "_people")
    named = F.when(F.col(key).isNotNull(), F.concat_ws("\u0001", F.col(key), F.coalesce("norm_name", F.lit(""))))
    joined = lookup(probes.withColumn("_named", named), "_named", listed, "_asked_key", ["account_key"])
    return joined.withColumn(out, F.coalesce("_people", empty)).drop("_people", "_named")


def _scored(people: Column, base: Column, rule: Column, policy: CorrelationPolicy) -> Column:
    def score(person: Column) -> Column:
        tier = person["tier"]
        total = base + F.when(tier == EQUAL, policy.exact_name_bonus).when(tier == SIMILAR, policy.fuzzy_name_bonus).otherwise(0)
        suffix = F.when(tier == EQUAL, "+EXACT_NAME").when(tier == SIMILAR, "+FUZZY_NAME").otherwise("")
        # Negated score first: the natural struct order is then best score, smallest id.
        return F.struct(
            (-total).alias("order_key"), person["identity_id"].alias("identity_id"),
            person["name"].alias("name"), total.alias("score"), F.concat(rule, suffix).alias("rule"))

    return F.transform(people, score)


def correlate(
    accounts: DataFrame, identities: DataFrame, aliases: DataFrame, policy: CorrelationPolicy
) -> DataFrame:
    """Add decision, best candidate, runner-up score and the top three candidates to ``accounts``.

    ``accounts`` needs account_key, local_part, domain, display_name and employee_id. An identity
    counts its best identifier once, plus one name bonus; a name alone never makes a candidate.
    """
    probes = (
        accounts.withColumn("norm_name", text.normalize_name(F.col("display_name")))
        .withColumn("_employee_key", F.when(F.col("employee_id") != "", F.col("employee_id")))
        .withColumn("_local_key", F.when(F.col("local_part") != "", F.col("local_part")))
        .withColumn("_corporate", F.coalesce(text.is_corporate(F.col("domain"), policy.corporate_domains), F.lit(False))))
    # Parsed once for what is asked and for the accounts themselves.
    keys = ["_employee_key", "_local_key", "_corporate", "norm_name"]
    probes = cut_lineage(probes.withColumn("_case", _case()))
    # Below a case stands for all accounts that show it.
    cases = probes.filter(F.col("_case").isNotNull()).select(F.col("_case").alias("account_key"), *keys)
    scored = cut_lineage(_scored_cases(cases, identities, aliases, policy).withColumnRenamed("account_key", "_case"))
    found = lookup(probes.drop(*keys), "_case", scored, "_case", ["account_key"])
    none = F.array().cast(scored.schema["candidates"].dataType)
    return found.withColumns({
        "candidates": F.coalesce("candidates", none), "decision": F.coalesce("decision", F.lit("unmatched"))}).drop("_case")


def _scored_cases(
    cases: DataFrame, identities: DataFrame, aliases: DataFrame, policy: CorrelationPolicy
) -> DataFrame:
    """Score each distinct case that has a candidate once, whatever the number of accounts that show it."""
    cases = cut_lineage(cases.distinct())
    for key, alias_type, out, asked in [
            ("_employee_key", "employee_id", "_by_id", _asked(cases, "_employee_key")),
            ("_local_key", "email_localpart", "_by_local", _asked(cases, "_local_key"))]:
        cases = _attach(cases, asked, identifier_index(identities, aliases, alias_type), key, out, policy)

    corporate = F.col("_corporate")
    local_weight = F.when(corporate, policy.corporate_local_weight).otherwise(policy.other_local_weight)
    local_rule = F.when(corporate, "CORPORATE_LOCALPART_MATCH").otherwise("NONCORPORATE_LOCALPART_MATCH")
    by_id = _scored(F.col("_by_id"), F.lit(policy.employee_id_weight), F.lit("EMPLOYEE_ID_MATCH"), policy)
    by_local = _scored(F.col("_by_local"), local_weight, local_rule, policy)

    # Without a candidate a case is unmatched.
    ranked = cases.filter((F.size("_by_id") > 0) | (F.size("_by_local") > 0))
    ranked = ranked.withColumn("_all", F.sort_array(F.concat(by_id, by_local)))
    first_seen = F.filter(
        F.col("_all"),
        lambda c, i: ~F.exists(F.slice(F.col("_all"), F.lit(1), i), lambda p: p["identity_id"] == c["identity_id"]))
    ranked = ranked.withColumn("candidates", F.slice(first_seen, 1, SHOWN_CANDIDATES))
    best, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    ranked = ranked.withColumn("best_score", best["score"]).withColumn("runner_up_score", second["score"])
    crowded = (F.col("runner_up_score") >= policy.quarantine_at) & (
        F.col("best_score") - F.col("runner_up_score") < policy.clear_lead)
    decision = (
        F.when(F.col("best_score").isNull() | (F.col("best_score") < policy.quarantine_at), "unmatched")
        .when(crowded, "quarantine")
        .when(F.col("best_score") >= policy.auto_match_at, "auto_match")
        .otherwise("quarantine"))
    ranked = ranked.withColumn("decision", decision)
    return ranked.select(
        "account_key", "candidates", "best_score", "runner_up_score", "decision",
        F.when(F.col("decision") == "auto_match", best["identity_id"]).alias("matched_identity_id"))


def candidate_ids(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: c["identity_id"].cast("string"))


def candidate_text(candidates: Column) -> Column:
    return F.array_join(
        F.transform(candidates, lambda c: F.concat_ws(" ", c["name"], c["score"].cast("string"), c["rule"])), "; ")
