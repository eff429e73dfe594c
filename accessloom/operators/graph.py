"""Traversals as iterated joins: entitlement reachability and reviewer routing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from accessloom.operators.joins import lookup, with_maybe
from accessloom.operators.rank import first_per_key
from accessloom.session import cut_by_slices, cut_lineage, released, stored_tables

MAX_DEPTH = 10


def reachable(
    entitlements: DataFrame, edges: DataFrame, max_depth: int | None = MAX_DEPTH, roots: DataFrame | None = None
) -> DataFrame:
    """(root_id, node_id, depth, path, path_names, truncated): each entitlement and all it implies, once per root.

    ``roots`` (root_id) confines the walk to those that start there.

    With ``max_depth`` None the walk goes on until nothing new is found. ``truncated`` marks the rows at the bound from
    which the walk would have gone on.

    Breadth-first over distinct roots, not over grants. A node keeps its shortest path, the
    smallest by ids among equals, so cycles end and results do not depend on row order.
    """
    nodes = entitlements.select("entitlement_id", "name")
    start = nodes.select(
        F.col("entitlement_id").alias("root_id"), F.col("entitlement_id").alias("node_id"), F.lit(0).alias("depth"),
        F.array("entitlement_id").alias("path"), F.array("name").alias("path_names"))
    if roots is not None:
        start = start.join(roots.select("root_id"), "root_id", "left_semi")
    steps = edges.select("child_id", "parent_id").distinct().join(
        nodes.select(F.col("entitlement_id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id")
    steps = cut_lineage(steps)
    frontier = start.join(steps.select(F.col("child_id").alias("root_id")).distinct(), "root_id", "left_semi")
    levels: list[DataFrame] = []
    visited = frontier.select("root_id", "node_id")
    for _ in count() if max_depth is None else range(max_depth):
        onward = frontier.join(steps, frontier["node_id"] == steps["child_id"]).select(
            "root_id", F.col("parent_id").alias("node_id"), (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array("parent_id")).alias("path"),
            F.concat("path_names", F.array("parent_name")).alias("path_names"))
        fresh = onward.join(visited, ["root_id", "node_id"], "left_anti")
        frontier = cut_lineage(first_per_key(fresh, ["root_id", "node_id"], [F.col("path")]))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        visited = visited.unionByName(frontier.select("root_id", "node_id"))
    else:
        if levels:
            beyond = frontier.join(steps, frontier["node_id"] == steps["child_id"]).select(
                "root_id", F.col("parent_id").alias("next"), F.col("node_id").alias("last"))
            seen = visited.select("root_id", F.col("node_id").alias("next"))
            open_ = beyond.join(seen, ["root_id", "next"], "left_anti").select("root_id", F.col("last").alias("node_id")).distinct()
            levels[-1] = frontier.join(open_.withColumn("truncated", F.lit(True)), ["root_id", "node_id"], "left").withColumn(
                "truncated", F.coalesce("truncated", F.lit(False)))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels, start.withColumn("truncated", F.lit(False)))
    return found.withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def effective_access(
    accounts: DataFrame, grants: DataFrame, entitlements: DataFrame, edges: DataFrame, max_depth: int | None = MAX_DEPTH,
    wanted: Column | None = None, closure: DataFrame | None = None,
) -> DataFrame:
    """Direct and inherited access of every owned account with the path that gives it.

    ``wanted``, a condition on entitlement columns, keeps what leads to such entitlements only, before grants are read.
    A ``closure`` known already, of these edges, is not worked out again.
    """
    attributes = (entitlements if wanted is None else entitlements.filter(wanted)).select(
        F.col("entitlement_id").alias("node_id"), F.col("name").alias("entitlement_name"),
        F.col("type").alias("entitlement_type"), "privileged")
    closure = reachable(entitlements, edges, max_depth) if closure is None else closure
    reach = closure.join(attributes, "node_id").withColumnRenamed("root_id", "entitlement_id")
    owned = accounts.filter(F.col("owner_id").isNotNull()).select(
        "account_id", F.col("owner_id").alias("identity_id"), "username", "application")
    held = grants.select("account_id", "entitlement_id").join(owned, "account_id")
    return held.join(reach, "entitlement_id").select(
        "identity_id", "account_id", "username", "application", F.col("entitlement_id").alias("granted_id"),
        F.col("node_id").alias("entitlement_id"), "entitlement_name", "entitlement_type", "privileged",
        F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("grant_type"), "depth", "path_names")


@dataclass(frozen=True)
class Changed:
    """A closure and the access it gives after a change, and what was worked out anew: roots and accounts."""

    closure: DataFrame
    access: DataFrame
    roots: DataFrame
    accounts: DataFrame


def _differing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are in one of two tables only."""
    sides = old.select(*keys, F.lit(1).alias("_side")).unionByName(new.select(*keys, F.lit(2).alias("_side")))
    return sides.groupBy(*keys).agg(F.bit_or("_side").alias("_sides")).filter("_sides < 3").drop("_sides")


def after_change(
    closure: DataFrame, access: DataFrame, accounts: DataFrame, entitlements: DataFrame, old_grants: DataFrame,
    new_grants: DataFrame, old_edges: DataFrame, new_edges: DataFrame, max_depth: int | None = MAX_DEPTH,
) -> Changed:
    """Closure and access after edges and grants changed, from those before.

    An edge, added or removed, can only change what roots reach that reached its lower end before: the way of any other
    root has no changed edge to begin with. Those roots and new entitlements are walked again; all other rows of the
    closure stay as they are. Access is worked out again for these roots, and for accounts whose grants changed.

    Rows that stay are told by bitmaps of the accounts and roots that changed and are not moved; only those that share a
    bit with one are joined. ``access`` may have some of the columns of ``effective_access``, account_id and granted_id
    at least; the result has the same.
    """
    edge = ["child_id", "parent_id"]
    known = entitlements.select("entitlement_id")

    def live(edges: DataFrame) -> DataFrame:
        return edges.select(*edge).join(known.withColumnRenamed("entitlement_id", "parent_id"), "parent_id", "left_semi")

    moved = cut_lineage(_differing(old_edges, live(new_edges), edge))
    touched = closure.join(moved.select(F.col("child_id").alias("node_id")).distinct(), "node_id", "left_semi").select("root_id")
    walked = closure.filter("depth = 0").select("root_id")
    existing = known.select(F.col("entitlement_id").alias("root_id"))
    roots = cut_lineage(touched.unionByName(existing.join(walked, "root_id", "left_anti")).distinct())
    left = cut_lineage(roots.unionByName(walked.join(existing, "root_id", "left_anti")).distinct())
    seen = with_maybe(closure.filter("root_id IS NOT NULL"), "root_id", left, "_left")
    kept = seen.filter("NOT _left").unionByName(seen.filter("_left").join(left, "root_id", "left_anti")).drop("_left")
    again = released(reachable)(entitlements, new_edges, max_depth, roots)
    after = kept.unionByName(again)
    accounts_ = cut_by_slices(
        lambda old, new: _differing(old, new, ["account_id", "entitlement_id"]).select("account_id").distinct(),
        old_grants, new_grants, by="account_id")

    held = with_maybe(with_maybe(access.filter("granted_id IS NOT NULL"), "granted_id", left, "_left"), "account_id", accounts_, "_changed")
    with stored_tables():
        doubtful = cut_lineage(held.filter("_left OR _changed").select(*access.columns))
        cleared = cut_by_slices(
            lambda rows, changed: rows.join(changed, "account_id", "left_anti").join(
                left.withColumnRenamed("root_id", "granted_id"), "granted_id", "left_anti").select(*access.columns),
            doubtful, accounts_, by="account_id", outlives_scope=True)
    stays = held.filter("NOT (_left OR _changed)").select(*access.columns).unionByName(cleared)

    due = with_maybe(with_maybe(new_grants, "entitlement_id", roots, "_root"), "account_id", accounts_, "_changed")
    with stored_tables():
        due = cut_lineage(due.filter("_root OR _changed"))
        of_accounts = due.filter("_changed").join(accounts_, "account_id", "left_semi")
        of_roots = due.filter("_root").join(accounts_, "account_id", "left_anti").join(
            roots.withColumnRenamed("root_id", "entitlement_id"), "entitlement_id", "left_semi")
        redone = cut_lineage(effective_access(accounts, of_accounts, entitlements, new_edges, closure=after).unionByName(
            effective_access(accounts, of_roots, entitlements, new_edges, closure=again)).select(*access.columns), outlives_scope=True)
    return Changed(after, stays.unionByName(redone), roots, accounts_)


def path_text(path: Column) -> Column:
    return F.array_join(path, " -> ")


DIRECT, NEAREST, FALLBACK = "direct_manager", "nearest_active_manager", "iam_fallback_queue"


def _within(inactive: DataFrame, max_managers: int) -> DataFrame:
    """(passed, reviewer, truncated) by a hop a round."""
    found = [inactive.filter("found").select("passed", F.col("above").alias("reviewer"))]
    walking = inactive.filter(~F.col("found")).select("passed", "above")
    hop = inactive.select(F.col("passed").alias("above"), F.col("above").alias("next"), "found")
    for _ in range(max_managers - 2):
        moved = cut_lineage(walking.join(hop, "above").select("passed", F.col("next").alias("above"), "found"))
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, found).withColumn("truncated", F.lit(False))
        found.append(moved.filter("found").select("passed", F.col("above").alias("reviewer")))
        walking = moved.filter(~F.col("found")).select("passed", "above")
    ended = walking.join(hop.select("above"), "above", "left_semi").select("passed").distinct().withColumn("truncated", F.lit(True))
    return reduce(DataFrame.unionByName, found).withColumn("truncated", F.lit(False)).unionByName(ended, allowMissingColumns=True)


def _highest(inactive: DataFrame) -> DataFrame:
    """(passed, reviewer, truncated) without a bound: each round doubles the hops behind every row, so after as many rounds
    as the number of people has bits only rings are left."""
    state = inactive
    for _ in range(inactive.count().bit_length() + 1):
        onward = state.filter(~F.col("found")).join(state.toDF("above", "next", "next_found"), "above").select(
            "passed", F.col("next").alias("above"), F.col("next_found").alias("found"))
        if onward.isEmpty():
            break
        state = cut_lineage(state.filter("found").unionByName(onward))
    return state.filter("found").select("passed", F.col("above").alias("reviewer"), F.lit(False).alias("truncated"))


def route_reviewers(identities: DataFrame, max_managers: int | None = MAX_DEPTH) -> DataFrame:
    """(identity_id, reviewer_id, reviewer_route, truncated): nearest active manager within ``max_managers`` hops.

    With None the walk goes on to the top; a ring of inactive managers leads nowhere. ``truncated`` marks people whose walk
    the bound ended while managers were left above.

    Only people without an active manager above them need a walk, so the loop runs over inactive
    people and everyone else is one lookup.
    """
    status = identities.select(
        F.col("identity_id").alias("_manager"), (F.col("lifecycle_status") == "active").alias("_manager_active"))
    linked = lookup(
        identities.select("identity_id", "manager_id", "lifecycle_status"), "manager_id", status, "_manager", ["identity_id"])
    linked = linked.withColumn("_known", F.col("_manager_active").isNotNull())
    inactive = cut_lineage(linked.filter((F.col("lifecycle_status") != "active") & F.col("_known")).select(
        F.col("identity_id").alias("passed"), F.col("manager_id").alias("above"), F.col("_manager_active").alias("found")))

    beyond = _highest(inactive) if max_managers is None else _within(inactive, max_managers)
    through = F.when(F.col("_known") & ~F.col("_manager_active"), F.col("manager_id"))
    routed = lookup(linked.withColumn("_through", through), "_through", beyond, "passed", ["identity_id"])
    direct = F.coalesce(F.col("_manager_active"), F.lit(False))
    return routed.select(
        "identity_id", F.when(direct, F.col("manager_id")).otherwise(F.col("reviewer")).alias("reviewer_id"),
        F.when(direct, DIRECT).when(F.col("reviewer").isNotNull(), NEAREST).otherwise(FALLBACK).alias("reviewer_route"),
        (~direct & F.coalesce("truncated", F.lit(False))).alias("truncated"))
