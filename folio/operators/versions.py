"""Versioned artifacts: upserts, heads, dependencies, invalidation, overrides, cache verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.checkpoints import cut


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and the new rows whose key it lacks; of new rows that repeat a key one is added, the least by all columns."""
    fresh = new.join(table.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*new.columns)).alias("r")).select("r.*")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str, update: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of their key; with ``update`` only those columns change and the rest stay as they were. Of new rows that repeat a key the last by ``order`` counts."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("n"))
    both = table.select(*keys, F.struct(*table.columns).alias("o")).join(last, keys, "full")
    change = set(update or [c for c in table.columns if c not in keys])
    return both.select(*(F.when(F.col("n").isNotNull() & (F.lit(c in change) | F.col("o").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in table.columns))


def update_then_insert(table: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer sync of found values into a table: found values win where they aren't null."""
    side = found.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return table.join(side, keys, "full").select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rows.columns).alias("r"))).alias("m")).select("m.r.*")


def heads(revisions: DataFrame) -> DataFrame:
    """The active head of each owner and artifact type: the newest ACTIVE revision."""
    return latest(revisions.where("state = 'ACTIVE'"), ["owner_scope", "artifact_type"], ["revision_id"])


def find_existing(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the newest usable revision of the same owner, type, input and algorithm, or null: a build is reused, not repeated."""
    on = ["owner_scope", "artifact_type", "input_hash", "algorithm_version"]
    best = revisions.where("state in ('ACTIVE', 'SUPERSEDED')").groupBy(*on).agg(F.max("revision_id").alias("existing_id"))
    return wanted.join(best, on, "left")


def promote(revisions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen BUILDING revisions become ACTIVE and their owner's older heads SUPERSEDED; a revision that is active already stays (reuse)."""
    pick = chosen.select("revision_id", F.lit(True).alias("__pick")).distinct()
    rows = revisions.join(pick, "revision_id", "left").withColumn("__pick", F.coalesce("__pick", F.lit(False)) & F.col("state").isin("BUILDING", "ACTIVE"))
    w = W.partitionBy("owner_scope", "artifact_type")
    rows = rows.withColumn("__top", F.max(F.when(F.col("__pick"), F.col("revision_id"))).over(w))
    state = F.when(F.col("__pick") & (F.col("revision_id") == F.col("__top")), "ACTIVE").when((F.col("state") == "ACTIVE") & F.col("__top").isNotNull(), "SUPERSEDED").otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("__pick", "__top")


def interrupted(revisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """BUILDING revisions without a running session (an anti-join, so null ids hide none)."""
    return revisions.where("state = 'BUILDING'").join(sessions.where("state = 'RUNNING'").select("revision_id"), "revision_id", "left_anti")


HOPS = 4  # edges followed between two checkpoints


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth (the least, from 1) of all that depends on each root, however deep.

    ``edges`` has dependency and dependent; ``roots`` has node. Nodes are visited level by level, and only those that are
    new go on, so neither many paths nor circles cost more; a root itself is reached only by a circle. Null ends are no edges.
    """
    return _walk(edges, roots.where("node is not null").select(F.col("node").alias("root"), "node").distinct())


def _walk(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """``reach`` from the rows (root, node) of ``frontier``."""
    step = cut(edges.where("dependency is not null and dependent is not null").select(F.col("dependency").alias("node"), F.col("dependent").alias("next")).distinct())
    seen, depth = None, 0
    while True:
        found, level = None, frontier
        for hop in range(1, HOPS + 1):
            level = level.join(step, "node").select("root", F.col("next").alias("node")).distinct()
            at = level.withColumn("depth", F.lit(depth + hop))
            found = at if found is None else found.unionByName(at)
        found = found.groupBy("root", "node").agg(F.min("depth").alias("depth"))
        new = cut(found if seen is None else found.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen, depth = new if seen is None else cut(seen.unionByName(new)), depth + HOPS
        frontier = new.where(F.col("depth") == depth).select("root", "node")
        if not frontier.limit(1).count():
            return seen


def downstream(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth (the least) of everything that depends on any root. All roots are walked as one."""
    return _walk(edges, roots.where("node is not null").select(F.lit(0).alias("root"), "node").distinct()).select("node", "depth")


def would_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """``proposed`` (dependent, dependency) with cycle: whether the dependency already depends on the dependent, or is it."""
    below = reach(edges, proposed.select(F.col("dependent").alias("node")).distinct())
    pairs = proposed.join(below.select(F.col("root").alias("dependent"), F.col("node").alias("dependency"), F.lit(True).alias("__hit")), ["dependent", "dependency"], "left")
    return pairs.withColumn("cycle", F.coalesce("__hit", F.lit(False)) | (F.col("dependent") == F.col("dependency"))).drop("__hit")


def invalidate(edges: DataFrame, events: DataFrame, revisions: DataFrame) -> DataFrame:
    """``revisions`` with invalid: those below a whole-book event, and those that a local event names."""
    whole = events.where("scope = 'BOOK'").select(F.col("revision_id").alias("node")).distinct()
    hit = downstream(edges, whole).select("node").union(events.select("revision_id")).distinct()
    return revisions.join(hit.select(F.col("node").alias("revision_id"), F.lit(True).alias("__hit")), "revision_id", "left").withColumn("invalid", F.coalesce("__hit", F.lit(False))).drop("__hit")


def compile_overrides(rules: DataFrame, keys: list[str], rank: str, seq: str = "seq") -> DataFrame:
    """State of override rules in order of their corrections: a rule weaker than one before it is DISABLED, an equal or stronger one supersedes the last, the last strong one is ACTIVE.

    Larger ranks are weaker. A running minimum of the rank does the sequential fold.
    """
    w = W.partitionBy(*keys).orderBy(seq)
    best = F.min(rank).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rules.withColumn("__weak", F.coalesce(F.col(rank) > best, F.lit(False)))
    last = F.max(F.when(~F.col("__weak"), F.col(seq))).over(W.partitionBy(*keys))
    return rows.withColumn("state", F.when(F.col("__weak"), "DISABLED").when(F.col(seq) == last, "ACTIVE").otherwise("SUPERSEDED")).drop("__weak")


def active_overrides(rules: DataFrame, order: list[str]) -> DataFrame:
    """Active rules from the strongest priority on; ``order`` names priorities, strongest first."""
    rank = F.coalesce(*(F.when(F.col("priority") == p, F.lit(i)) for i, p in enumerate(order)), F.lit(len(order)))
    return rules.where("state = 'ACTIVE'").orderBy(rank, "seq")


def undo(events: DataFrame, ids: DataFrame, next_id: Column) -> DataFrame:
    """Reverse events of the given ones: old and new values swapped, pointing to what they undo."""
    hit = events.join(ids.select("event_id").distinct(), "event_id", "left_semi")
    return hit.select(next_id.alias("event_id"), F.col("event_id").alias("undoes"), "target", F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"))


def lineage_of(lineage: DataFrame, ids: DataFrame) -> DataFrame:
    """Lineage rows that lead from or to the given entities."""
    wanted = ids.select(F.col("entity").alias("__e")).distinct()
    from_ = lineage.join(wanted, lineage["from_entity"] == F.col("__e"), "left_semi")
    to = lineage.join(wanted, lineage["to_entity"] == F.col("__e"), "left_semi")
    return from_.union(to).distinct()


def cache_verdict(state_revision: Column, wanted_revision: Column, state_names: Column, wanted_names: Column, prepared_until: Column, needed_until: Column) -> Column:
    """HIT, EXTEND or MISS with its reasons. Segment 0 may be the last one prepared; only a negative value means none is."""
    reasons = F.array_compact(F.array(
        F.when(state_revision.isNull(), "NO_STATE"), F.when(state_revision != wanted_revision, "SOURCE_CHANGED"), F.when(state_names != wanted_names, "NAMES_CHANGED"), F.when(F.coalesce(prepared_until, F.lit(-1)) < 0, "NOTHING_PREPARED"),
    ))
    return F.struct(F.when(F.size(reasons) > 0, "MISS").when(prepared_until >= needed_until, "HIT").otherwise("EXTEND").alias("verdict"), reasons.alias("reasons"))


def remaining(segments: DataFrame, checkpoint: DataFrame, keys: list[str], order: str = "ordinal", every: int = 12) -> DataFrame:
    """Segments that a resumed run still has to do, with the number of the checkpoint that each closes into."""
    rows = segments.join(checkpoint.select(*keys, F.col("next_ordinal").alias("__next")), keys, "left").where(F.col(order) >= F.coalesce("__next", F.lit(0)))
    return rows.withColumn("checkpoint_no", F.floor(F.col(order) / every)).drop("__next")
