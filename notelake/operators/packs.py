"""Bounded context packs for a table of scopes: structural bands, required reading, retrieved tails, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.graph import required_closure
from notelake.operators.sizes import broadcast_if_small
from notelake.sources.shared import saved

#: Items of each category in a startup pack and in a deep one, items and characters of a pack.
CAPS = {"context": 8, "standard": 6, "goal": 6, "decision": 8, "plan": 6, "walkthrough": 3, "task": 10, "activity": 3, "retrieved": 5}
DEEP_CAPS = {"context": 20, "standard": 20, "goal": 15, "decision": 30, "plan": 15, "walkthrough": 10, "task": 40, "activity": 15, "retrieved": 30}
ITEMS, CHARACTERS, DEEP_ITEMS, DEEP_CHARACTERS = 40, 16_000, 120, 120_000
#: Characters of a response and its frame, of an index line, a required item's mark and a description's.
RESPONSE, FRAMING, LINE, MARK, DESCRIBED = 24_000, 5_000, 110, 90, 16
#: First priority of each band and its width; ranks of decisions; what is still open.
BANDS = {"context": 50, "standard": 100, "goal": 200, "decision": 300, "plan": 400, "walkthrough": 400, "task": 500, "activity": 600, "retrieved": 700}
SPAN = 100
DECISIONS = ("accepted", "proposed", "superseded", "rejected")
OPEN_GOALS, OPEN_PLANS, RUNNING, CLOSED_TASKS = ("proposed", "active"), ("draft", "active"), "in_progress", ("done", "cancelled")


def _detached(path: Column) -> Column:
    return F.startswith(path, F.lit("90_Archive/"))


def _ranked(items: DataFrame, order: list[Column | str], category: str) -> DataFrame:
    """``place`` from 0 within each scope for the first of the band, the last place of the band for all others.

    Only the first ``SPAN`` of a scope are ranked, which Spark cuts before the shuffle, so a scope of any size is fine.
    """
    w = Window.partitionBy("scope_id").orderBy(*order)
    first = items.withColumn("place", F.row_number().over(w)).filter(F.col("place") < SPAN).select("scope_id", "concept_id", (F.col("place") - 1).alias("place"))
    placed = items.join(first, ["scope_id", "concept_id"], "left").withColumn("place", F.coalesce("place", F.lit(SPAN - 1)))
    return placed.withColumn("category", F.lit(category)).withColumn("priority", F.col("place") + BANDS[category])


_RECORD = ("concept_id", "type", "path", "title", "workspace_id", "lifecycle", "created_at", "occurred_at", "covers", "description", "stale", "characters", "required_reading")
_ITEM = ("scope_id", "concept_id", "category", "priority", "binding", "stale", "characters", "title", "path", "description")


def structural_items(scopes: DataFrame, parents: DataFrame, records: DataFrame, sections_of_parents: bool = False) -> DataFrame:
    """Everything structure puts into the pack of each of ``scopes(scope_id)``: the columns of ``_ITEM``.

    ``parents(scope_id, parent_id, depth)`` is the chain outward, ``records`` has the columns of ``_RECORD``. Bands:
    the workspace (priority 0) and its parents by depth; context by path; standards of the workspace, of
    its parents and of no workspace, all binding, one of each folder in turn with those of no workspace first; open goals
    by path; decisions by lifecycle and newest first, accepted ones binding; open plans newest first; walkthroughs in
    progress, without body; open tasks by path; activity newest first. Archived records are in no band. Beyond
    a band's width items share its last priority. ``sections_of_parents`` ranks the parents' sections with the scope's own.
    """
    scopes = broadcast_if_small(scopes.select("scope_id").distinct())
    live = records.select(*_RECORD).filter(~_detached(F.col("path")))
    chain = scopes.select("scope_id", F.col("scope_id").alias("at"), F.lit(0).alias("depth")).union(parents.join(scopes, "scope_id").select("scope_id", "parent_id", "depth"))
    chain = broadcast_if_small(chain)
    own = records.select(*_RECORD).join(chain, F.col("concept_id") == F.col("at")).withColumn("category", F.when(F.col("depth") == 0, "workspace").otherwise("parent")).withColumn("priority", F.col("depth"))
    sections = live.join(chain if sections_of_parents else scopes, F.col("workspace_id") == F.col("at" if sections_of_parents else "scope_id"))

    def band(category: str, kind: str, order: list, kept: Column | None = None) -> DataFrame:
        rows = sections.filter(F.col("type") == kind)
        return _ranked(rows if kept is None else rows.filter(kept), order, category)

    newest = [F.desc(F.coalesce("created_at", F.lit(""))), "path", "concept_id"]
    lifecycle = F.col("lifecycle")
    rank = F.coalesce(*[F.when(lifecycle == v, F.lit(i)) for i, v in enumerate(DECISIONS)], F.lit(len(DECISIONS)))
    happened = F.coalesce(F.nullif("occurred_at", F.lit("")), F.nullif("created_at", F.lit("")), F.lit(""))
    every = [
        own,
        band("context", "context", ["path", "concept_id"]),
        _ranked(_standards(live, scopes, chain), ["turn", "folder", "concept_id"], "standard"),
        band("goal", "goal", ["path", "concept_id"], lifecycle.isin(*OPEN_GOALS)),
        band("decision", "decision", [rank, *newest]),
        band("plan", "plan", newest, lifecycle.isin(*OPEN_PLANS)),
        band("walkthrough", "walkthrough", newest, lifecycle == RUNNING).withColumn("characters", F.lit(None).cast("long")),
        band("task", "task", ["path", "concept_id"], F.coalesce(~lifecycle.isin(*CLOSED_TASKS), F.lit(True))),
        band("activity", "activity_log", [F.desc(happened), "concept_id"]),
    ]
    binding = (F.col("category") == "standard") | ((F.col("category") == "decision") & F.coalesce(lifecycle == DECISIONS[0], F.lit(False)))
    made = None
    for part in every:
        part = part.withColumn("binding", binding).withColumn("priority", F.col("priority").cast("int")).select(*_ITEM)
        made = part if made is None else made.unionByName(part)
    return made


def _standards(live: DataFrame, scopes: DataFrame, chain: DataFrame) -> DataFrame:
    """The standards of each scope with their folder and their turn in it."""
    standards = live.filter("type = 'standard'")
    bound = standards.join(chain, F.col("workspace_id") == F.col("at")).select("scope_id", *standards.columns)
    # Standards of no workspace belong to every scope; that is what the rule says, not a search for pairs.
    free = standards.filter("workspace_id is null").join(scopes, F.lit(True)).select("scope_id", *standards.columns)
    both = bound.unionByName(free).withColumn("folder", F.when(F.col("workspace_id").isNull(), "").otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    return both.withColumn("turn", F.row_number().over(Window.partitionBy("scope_id", "folder").orderBy("path", "concept_id")))


def mark_required(items: DataFrame, records: DataFrame, excepts: DataFrame) -> DataFrame:
    """The items with ``required``: workspaces, parents, context, the newest handoff and the standards to be read in full.

    The handoff is the scope's newest activity that covers nothing else. A standard is required if it says so, and if it says nothing
    when it stands in the system's folder; one that excepts a required standard is required too, in any number of steps:
    ``excepts(source_id, target_id)``.
    """
    items = saved(items, "items")  # read four times below
    facts = records.select("concept_id", F.col("path").alias("at"), "required_reading", "covers")
    held = items.join(facts, "concept_id", "left")
    default = F.coalesce("required_reading", F.startswith("at", F.lit("50_System/")))
    standards = held.filter("category = 'standard'")
    # What applies is decided scope by scope: the closure runs over (scope, standard) pairs.
    key = lambda scope, concept: F.concat_ws("\x00", scope, concept)
    applying = standards.select("scope_id", "concept_id", key(F.col("scope_id"), F.col("concept_id")).alias("key"), default.alias("first"))
    pairs = applying.join(excepts, F.col("concept_id") == F.col("source_id")).select(F.col("key").alias("source_id"), key(F.col("scope_id"), F.col("target_id")).alias("target_id"))
    closed = required_closure(applying.filter("first").select(F.col("key").alias("concept_id")), pairs).select(F.col("concept_id").alias("key"), F.lit(True).alias("follows"))
    handoff = held.filter(F.col("category").eqNullSafe("activity") & F.nullif("covers", F.lit("")).isNull()).groupBy("scope_id").agg(F.min_by("concept_id", F.struct("priority", "concept_id")).alias("handoff"))
    marked = held.withColumn("key", key(F.col("scope_id"), F.col("concept_id"))).join(closed, "key", "left").join(handoff, "scope_id", "left")
    required = (
        F.col("category").isin("workspace", "parent", "context")
        | ((F.col("category") == "standard") & F.coalesce("follows", F.lit(False)))
        | ((F.col("category") == "activity") & F.coalesce(F.col("concept_id") == F.col("handoff"), F.lit(False)))
    )
    return marked.withColumn("required", required).select(*items.columns, "required")


def retrieved_items(fused: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """What searching found, ``fused(scope_id, concept_id, rank)`` from rank 1, behind what structure already holds."""
    fresh = fused.join(items.select("scope_id", "concept_id").distinct(), ["scope_id", "concept_id"], "left_anti")
    met = fresh.join(records.select("concept_id", "path", "title", "stale", "characters"), "concept_id")
    priority = F.least(F.col("rank") - 1, F.lit(SPAN - 1)) + BANDS["retrieved"]
    return met.select("scope_id", "concept_id", F.lit("retrieved").alias("category"), priority.cast("int").alias("priority"), F.lit(False).alias("binding"), "stale", "characters", "title", "path", F.lit(None).cast("string").alias("description"))


def startup_pack(scopes: DataFrame, parents: DataFrame, records: DataFrame, excepts: DataFrame, fused: DataFrame | None = None) -> DataFrame:
    """The startup pack of each scope: structure with required reading marked, then what was found for a named task."""
    structural = structural_items(scopes, parents, records)
    items = mark_required(structural, records, excepts)
    if fused is not None:
        items = items.unionByName(retrieved_items(fused, structural, records).withColumn("required", F.lit(False)))
    return apply_budget(items)


def index_room(items: DataFrame, limit: int = CHARACTERS, response: int | None = RESPONSE) -> DataFrame:
    """Characters for bodies: the budget, or what frame and index lines leave of the response if that is less."""
    line = F.length("title") + LINE + F.when(F.col("required"), F.length("path") + MARK).otherwise(0) + F.when(F.coalesce(F.length("description"), F.lit(0)) > 0, F.length("description") + DESCRIBED).otherwise(0)
    left = F.lit(limit) if response is None else F.least(F.lit(limit), F.lit(response - FRAMING) - F.sum(line))
    return items.groupBy("scope_id").agg(F.greatest(F.lit(0), left).cast("long").alias("room"))


def category_caps(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The first items of each category. Binding items do not count and stay; required ones count and stay."""
    caps = CAPS if caps is None else caps
    cap = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in caps.items()], F.lit(1 << 30))
    order = Window.partitionBy("scope_id", "category").orderBy("priority", "concept_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of k optional items and r required ones before an optional item, it stays while k + r are below the cap;
    # optional items that are dropped do not count, but no later one can stay either.
    used = F.sum(F.when(F.col("binding"), 0).otherwise(1)).over(order)
    return items.withColumn("used", used).filter(F.col("binding") | F.col("required") | (F.col("used") <= cap)).drop("used")


def admitted(items: DataFrame, most: int = ITEMS, caps: dict[str, int] | None = None) -> DataFrame:
    """Items within their caps; the pack's ceiling is for those neither binding nor required. ``place`` is the order."""
    kept = category_caps(items, caps).withColumn("free", ~F.col("binding") & ~F.col("required"))
    rank = F.row_number().over(Window.partitionBy("scope_id", "free").orderBy("priority", "concept_id"))
    kept = kept.withColumn("rank", rank).filter(~F.col("free") | (F.col("rank") <= most)).drop("rank", "free")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("scope_id").orderBy("priority", "concept_id")))


def apply_budget(items: DataFrame, limit: int = CHARACTERS, most: int = ITEMS, documents: int | None = None, caps: dict[str, int] | None = None, response: int | None = RESPONSE) -> DataFrame:
    """``(scope_id, concept_id, place, full, reason)``: order, caps, item ceiling, then bodies greedily.

    The room for bodies is that of ``index_room`` over the admitted items. Bodies go to required items
    first, then binding, fresh and stale ones, each by priority. A body that does not fit is passed over
    with its reason, and later smaller ones may still fit: larger than the room, beyond ``documents`` full
    bodies (``most`` if None), or the room spent. An item without characters has no body and no reason.
    The greedy step is a fold over the sizes of one pack.
    """
    kept = saved(admitted(items, most, caps), "admitted")
    rooms = index_room(kept, limit, response)
    documents = most if documents is None else documents

    def fold(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.assign(turn=(~pack.required).astype(int) * 4 + (~pack.binding).astype(int) * 2 + pack.stale.astype(int)).sort_values(["turn", "place"])
        room, spent, bodies, full, reasons = int(pack.room.iloc[0]), 0, 0, [], []
        for size in pack.characters:
            bodiless = pd.isna(size)
            reason = None if bodiless else "larger than budget" if size > room else "document limit" if bodies >= documents else "budget spent" if spent + size > room else None
            if not bodiless and reason is None:
                spent, bodies = spent + size, bodies + 1
            full.append(not bodiless and reason is None)
            reasons.append(reason)
        return pack.assign(full=full, reason=reasons)[["scope_id", "concept_id", "place", "full", "reason"]]

    fields = kept.select("scope_id", "concept_id", "place", "required", "binding", "stale", "characters").join(rooms, "scope_id")
    return fields.groupBy("scope_id").applyInPandas(fold, "scope_id string, concept_id string, place int, full boolean, reason string")


def pack_usage(packed: DataFrame, items: DataFrame) -> DataFrame:
    """Items, characters and tokens of bodies, full documents, items dropped, and the size of what is required."""
    every = items.select("scope_id", "concept_id", "characters", "required")
    met = every.join(packed.select("scope_id", "concept_id", "full"), ["scope_id", "concept_id"], "left")
    kept, held = F.col("full").isNotNull(), F.when(F.col("full"), F.col("characters")).otherwise(0)
    usage = met.groupBy("scope_id").agg(
        F.count_if(kept).alias("items"),
        F.sum(held).cast("long").alias("characters"),
        F.count_if(F.coalesce("full", F.lit(False))).alias("full_documents"),
        F.count_if(~kept).alias("dropped"),
        F.sum(F.when(kept & F.col("required"), F.coalesce("characters", F.lit(0))).otherwise(0)).cast("long").alias("required_characters"),
    )
    return usage.withColumn("tokens", F.ceil(F.col("characters") / 4).cast("long"))
