"""Knowledge triples: checks against an ontology, duplicates, conflicts, review queue, stale documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Fixed types of entities, and the pairs of types that each relation may join ("*": any type).
ENTITY_TYPES = ("Agent", "User", "Project", "Task", "Decision", "Preference", "Artifact", "SourceDocument", "Claim", "Failure", "Verification", "Event")
RELATIONS = {
    "assigned_to": ["Task Agent"],
    "authored_by": ["Artifact Agent", "Artifact User", "SourceDocument Agent", "SourceDocument User"],
    "mentions": ["SourceDocument *"],
    "links_to": ["SourceDocument *"],
    "derived_from": ["Claim SourceDocument", "Decision SourceDocument"],
    "decided_by": ["Decision Agent", "Decision User"],
    "depends_on": [
        "Task Task", "Task Decision", "Task Artifact", "Decision Task", "Decision Decision", "Decision Artifact", "Artifact Task", "Artifact Decision", "Artifact Artifact",
    ],
    "supersedes": ["Decision Decision", "Claim Claim", "Preference Preference"],
    "invalidated_by": [
        "Claim Failure", "Claim Verification", "Claim Decision", "Decision Failure", "Decision Verification", "Decision Decision", "Verification Failure",
        "Verification Verification", "Verification Decision",
    ],
    "verified_by": ["Claim Verification", "Artifact Verification", "Task Verification"],
    "caused_by": [
        "Failure Event", "Failure Decision", "Failure Failure", "Event Event", "Event Decision", "Event Failure", "Decision Event", "Decision Decision", "Decision Failure",
    ],
    "relates_to": ["* *"],
    "observed_in": ["* SourceDocument", "* Event"],
}
#: Fixed properties that a relation must have.
NEEDS = {"caused_by": ["mechanism", "evidence"]}


def ontology() -> list[tuple[str, str, str]]:
    """All allowed (subject_type, predicate, object_type)."""
    any_of = lambda name: ENTITY_TYPES if name == "*" else (name,)
    return [(s, relation, o) for relation, pairs in RELATIONS.items() for pair in pairs for s in any_of(pair.split()[0]) for o in any_of(pair.split()[1])]


def validated(facts: DataFrame, allowed: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """facts (subject_type, predicate, object_type, confidence, properties map) with status and reason.

    allowed (subject_type, predicate, object_type) are the pairs a relation may join, a small table of configuration; needs
    lists the properties a predicate must have. relates_to may join whatever there is.
    """
    pairs = allowed.select("subject_type", "predicate", "object_type", F.lit(True).alias("_ok"))
    known = allowed.select("predicate").distinct().withColumn("_known", F.lit(True))
    missing = F.lit(False)
    for predicate, names in needs.items():
        for name in names:
            missing = missing | ((F.col("predicate") == predicate) & F.coalesce(F.col("properties").getItem(name), F.lit("")).eqNullSafe(""))
    bad = ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    reason = (
        F.when(F.col("_known").isNull(), "unknown relation").when(F.col("_ok").isNull() & (F.col("predicate") != "relates_to"), "types not allowed")
        .when(missing, "property missing").when(bad, "confidence out of range")
    )
    found = facts.join(F.broadcast(pairs), ["subject_type", "predicate", "object_type"], "left").join(F.broadcast(known), "predicate", "left")
    return found.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "accepted").otherwise("rejected")).drop("_ok", "_known")


def updated(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """facts (id, status and others) with the newest decision (id, status, reason, at) on each: status, reason, reviewed_at. Of equal
    times the greatest status counts; facts without a decision keep their status, and decisions on unknown facts are not looked at."""
    newest = decisions.groupBy("id").agg(F.max_by(F.struct("status", "reason", "at"), F.struct("at", "status", "reason")).alias("_d"))
    rest = [c for c in facts.columns if c not in ("id", "status", "reason", "reviewed_at")]
    joined = facts.join(newest, "id", "left")
    return joined.select("id", *rest, F.coalesce("_d.status", "status").alias("status"), F.col("_d.reason").alias("reason"), F.col("_d.at").alias("reviewed_at"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(subject_type, subject_key, predicate) with several facts and several objects: n, n_objects, objects in order."""
    keys = ["subject_type", "subject_key", "predicate"]
    groups = facts.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("object_key").alias("n_objects"), F.sort_array(F.collect_set("object_key")).alias("objects"))
    return groups.where("n > 1 and n_objects > 1")


def duplicates_of(facts: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed facts that pending or accepted facts already hold; missing objects are equal to each other."""
    live = facts.where(F.col("status").isin("pending", "accepted")).select("subject_key", "predicate", F.col("object_key").alias("_object")).distinct()
    same = (proposed["subject_key"] == live["subject_key"]) & (proposed["predicate"] == live["predicate"]) & proposed["object_key"].eqNullSafe(live["_object"])
    return proposed.join(live, same, "left_semi")


def review_queue(facts: DataFrame, limit: int = 1000) -> DataFrame:
    """Rejected, ambiguous and conflicting facts, newest first."""
    return facts.where(F.col("status").isin("rejected", "ambiguous", "in_conflict")).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys whose stored hash differs from the current one."""
    now = current.select(key, F.col("hash").alias("_now"))
    return stored.join(now, key).where("hash <> _now").select(key, "hash", F.col("_now").alias("current_hash"))


def reconciled(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """What each event in a log of file states asks for: delete where the value is null, unchanged where the key's value before
    is the same, else index."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    action = F.when(F.col(value).isNull(), "delete").when(~first & before.eqNullSafe(F.col(value)), "unchanged").otherwise("index")
    return stream.withColumn("action", action)
