"""Identities: pair evidence, hard negatives, merges and splits, clusters, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs in one form, so both directions meet in an equi-join; pairs of one and the same are left out."""
    return df.where(F.col(a) != F.col(b)).withColumns({a: F.least(F.col(a), F.col(b)), b: F.greatest(F.col(a), F.col(b))})


def pair_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by relation and sign for each unordered pair, with the summed strength and whether a hard negative stands.

    ``evidence`` has a, b, relation, sign (+1 or -1), strength and hard.
    """
    pairs = ordered_pair(evidence.select(*keys, "a", "b", "relation", "sign", "strength", "hard"), "a", "b")
    by_kind = pairs.groupBy(*keys, "a", "b", "relation", "sign").agg(F.count("*").alias("n"), F.sum(F.col("sign") * F.col("strength")).alias("s"), F.bool_or("hard").alias("h"))
    label = F.concat_ws(":", "relation", F.col("sign").cast("string"))
    return by_kind.groupBy(*keys, "a", "b").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label.alias("k"), F.col("n"))))).alias("counts"), F.sum("s").alias("strength"), F.bool_or("h").alias("hard_negative"))


def mergeable(pairs: DataFrame, least: float = 1.5) -> DataFrame:
    """Pairs strong enough to be one, without a hard negative."""
    return pairs.where((F.col("strength") >= least) & ~F.col("hard_negative"))


def candidate_pairs(candidates: DataFrame, keys: list[str], index: str = "idx", block: int = 64) -> DataFrame:
    """All i < j pairs of a key's candidates, numbered from 0. Lists are cut into blocks of ``block`` numbers, and each pair of blocks is a key of its own."""
    rows = candidates.withColumn("__own", F.floor(F.col(index) / block))
    rows = rows.join(rows.groupBy(*keys).agg(F.max("__own").alias("__last")), keys)
    left = rows.select(*keys, F.col(index).alias("i"), F.col("candidate").alias("a"), F.col("__own").alias("__x"), F.explode(F.sequence("__own", "__last")).alias("__y"))
    right = rows.select(*keys, F.col(index).alias("j"), F.col("candidate").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "__own")).alias("__x"), F.col("__own").alias("__y"))
    return left.join(right, [*keys, "__x", "__y"]).where("i < j").drop("__x", "__y")


def cluster_pair_evidence(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence between clusters: summed over all pairs of members, and blocked if any pair is. Each pair row finds its clusters by two equi-joins."""
    of = lambda c: members.select(F.col("entity").alias(c), F.col("cluster").alias(f"cluster_{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where("cluster_a <> cluster_b")
    return met.groupBy(F.least("cluster_a", "cluster_b").alias("cluster_a"), F.greatest("cluster_a", "cluster_b").alias("cluster_b")).agg(F.sum("strength").alias("strength"), F.bool_or("hard_negative").alias("hard_negative"))


def replay_merges(log: DataFrame, entities: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Cluster of each entity after a log of MERGE (source, target) and SPLIT (source) rows, each giving fresh clusters.

    A merge moves both entities to a new cluster, out of any older one; a split moves the source to one of its own. So the
    last row that names an entity decides: no replay loop. Entities never named are clusters of their own.
    """
    merge = F.col("action") == "MERGE"
    touched = log.select(*keys, seq, F.explode(F.when(merge, F.array("source", "target")).otherwise(F.array("source"))).alias("entity"), F.concat(F.lit("cluster-"), F.col(seq).cast("string")).alias("cluster"))
    last = touched.groupBy(*keys, "entity").agg(F.max_by("cluster", seq).alias("cluster"))
    own = F.concat(F.lit("entity-"), F.col("entity").cast("string"))
    return entities.select(*keys, "entity").distinct().join(last, [*keys, "entity"], "left").withColumn("cluster", F.coalesce("cluster", own))


def clusters_by_links(links: DataFrame, nodes: DataFrame, checkpoint) -> DataFrame:
    """Transitive clusters: node, cluster (least node) by spreading minima along links and jumping to the label's label.

    ``checkpoint`` cuts the plan after each round; only one changed flag comes to the driver. Rounds go on until no
    label changes: minima only fall, so they end.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct()
    labels = nodes.select(F.col("node").alias("u"), F.col("node").alias("c"))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        stepped = labels.join(near, "u", "left").select("u", F.least("c", F.coalesce("n", "c")).alias("m"), F.col("c").alias("old"))
        jump = stepped.select(F.col("u").alias("m"), F.col("m").alias("j"))
        after = checkpoint(stepped.join(jump, "m", "left").select("u", F.least("m", F.coalesce("j", "m")).alias("c"), "old"))
        labels = after.select("u", "c")
        if not after.where("c <> old").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("c").alias("cluster"))


def aliases_of(members: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted names of each cluster's entities."""
    return members.join(entities, [*keys, "entity"]).groupBy(*keys, "cluster").agg(F.array_sort(F.collect_set("name")).alias("aliases"))


# What an observation may be, and the table that it feeds.
OBSERVATION_ROUTES = {"MENTION": "mention", "ALIAS": "evidence", "SAME_AS": "evidence", "NOT_SAME": "evidence", "ATTRIBUTE": "attribute", "VOICE_PHASE": "interval", "EMBODIMENT": "interval", "TEMP_VOICE": "event", "RELATION": "evidence", "MERGE": "merge", "SPLIT": "merge"}


def compile_observations(observations: DataFrame, keys: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """One filtered projection for each target table, and the counts by type; unknown types are counted as REJECTED."""
    table = F.try_element_at(F.create_map(*(F.lit(x) for kv in OBSERVATION_ROUTES.items() for x in kv)), F.col("type"))
    routed = observations.withColumn("target", table)
    parts = {t: routed.where(F.col("target") == t).drop("target") for t in sorted(set(OBSERVATION_ROUTES.values()))}
    counts = routed.groupBy(*keys, F.when(F.col("target").isNull(), "REJECTED").otherwise(F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    return parts, counts


def profiles(mentions: DataFrame, keys: list[str], alias_limit: int = 4) -> DataFrame:
    """Profile of each name: mentions, first line, majority of the gender votes, latest age, evidence and confidence, a few aliases."""
    vote = F.sum(F.when(F.col("gender") == "F", -1).when(F.col("gender") == "M", 1).otherwise(0))
    kinds = F.count_distinct("evidence")
    return mentions.groupBy(*keys, "name").agg(
        F.count("*").alias("n_mentions"), F.min("line_no").alias("first_line"), F.when(vote > 0, "M").when(vote < 0, "F").otherwise("UNKNOWN").alias("gender"), F.max_by("age", F.when(F.col("age").isNotNull(), F.col("line_no"))).alias("age"),
        F.when(kinds >= 3, 0.9).when(kinds == 2, 0.7).when(kinds == 1, 0.5).otherwise(0.2).alias("confidence"), F.slice(F.array_sort(F.collect_set("alias")), 1, alias_limit).alias("aliases"),
    )


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """User values win over extracted ones, column by column, where they aren't null."""
    side = overrides.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return rows.join(side, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def importance(characters: DataFrame, aliases: DataFrame, span_cap: int = 1000) -> DataFrame:
    """Importance of canonical characters: mentions against the most mentioned, share of dialogue, and capped span; aliases are rolled up first.

    ``characters`` has book, name, n_mentions, n_dialogue, first_at and last_at; ``aliases`` has book, name and canonical.
    """
    rows = characters.join(aliases.select("book", "name", "canonical"), ["book", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    rolled = rows.groupBy("book", "canonical").agg(F.sum("n_mentions").alias("n_mentions"), F.sum("n_dialogue").alias("n_dialogue"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.array_sort(F.collect_set("name")).alias("names"))
    top = rolled.agg(F.max("n_mentions").alias("top"))
    both = rolled.crossJoin(F.broadcast(top))
    span = F.least(F.col("last_at") - F.col("first_at"), F.lit(span_cap)) / span_cap
    return both.withColumn("importance", F.round(0.5 * F.col("n_mentions") / F.col("top") + 0.3 * F.col("n_dialogue") / F.greatest(F.col("n_mentions"), F.lit(1)) + 0.2 * span, 6)).drop("top")


def narration_ir(segments: DataFrame, phases: DataFrame, overrides: DataFrame, bodies: DataFrame, clusters: DataFrame, key: str = "entity", at: str = "position") -> DataFrame:
    """Segments with the phase, override, body and cluster that hold at their position: a chain of as-of and interval joins."""
    from folio.operators.asof import asof_last, stab
    from folio.operators.state import state_summary

    rows = asof_last(segments, phases, key, at, ["phase"], "start_at")
    rows = stab(rows, overrides, key, at, "start_at", "end_at", ["descriptor"], closed=False)
    rows = stab(rows, bodies, key, at, "start_at", "end_at", ["body"])
    rows = rows.join(clusters.select(F.col("node").alias(key), "cluster"), key, "left")
    return rows.withColumn("voice_state", state_summary(F.col("asof_phase"), F.col("held_descriptor"), F.col("held_body")))


