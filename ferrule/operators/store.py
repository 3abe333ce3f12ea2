"""Tables that change: upserts, scan states, feedback, score logs and provider blocks, as aggregations and windows.

Nothing is updated in place.  Changes are appended, and the current rows are an aggregation of them, which combines
before the shuffle, so a key with very many changes is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from .relate import first_n
from .windows import micros


def current(changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row a key: of each field the latest value that isn't null.

    A change names only the fields that it sets; the others are null.  Of changes with the same order the largest value
    wins.  Changes without a key or an order are left out.
    """
    known = changes.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    return known.groupBy(key).agg(*[F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("order"), F.col(f).alias("value"))))["value"].alias(f) for f in fields])


def listed(scans: DataFrame, created: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of scans, newest first (S21); the limit is the feature."""
    return scans.orderBy(F.desc(created), F.desc(key)).offset(offset).limit(limit)


def scan_states(events: DataFrame, key: str, event: str, order: str, ts: str) -> DataFrame:
    """(key, status, created_at, completed_at) from a scan's events (R8): pending, running, completed or failed.

    The first end decides; events after it change nothing.  ``order`` doesn't repeat within a scan.
    """
    at = F.col(ts)
    rank = F.when(F.col(event).isin("completed", "failed"), F.col(order))
    ended = F.min_by(event, rank)
    return events.groupBy(key).agg(
        F.coalesce(ended, F.when(F.count_if(F.col(event) == "running") > 0, "running"), F.lit("pending")).alias("status"),
        F.min(at).alias("created_at"), F.min_by(ts, rank).alias("completed_at"),
    )


def scan_audit(events: DataFrame, key: str, event: str, order: str, ts: str) -> DataFrame:
    """(key, action, created_at): the audit entries that a scan's start and end leave (R8); one of each at most."""
    action = F.when(F.col(event) == "running", "scan.triggered").when(F.col(event).isin("completed", "failed"), F.concat(F.lit("scan."), event))
    rows = events.select(key, action.alias("action"), F.when(F.col(event) == "running", "start").otherwise("end").alias("end_"), order, ts).where(F.col("action").isNotNull())
    firsts = rows.groupBy(key, "end_").agg(F.min_by("action", order).alias("action"), F.min_by(ts, order).alias("created_at"))
    # A failed scan is told to webhooks only, not to the audit.
    return firsts.where(F.col("action") != "scan.failed").select(key, "action", "created_at")


def feedback_rows(feedback: DataFrame, registry: DataFrame, package: str = "package", label: str = "label") -> DataFrame:
    """Feedback with its package's metadata (J11); only named packages and labels 0 and 1 count.

    Both tables have the package's column; packages that the registry doesn't know keep their row, with nulls.
    """
    y = F.col(label).cast("double")
    good = feedback.where((F.coalesce(F.col(package).cast("string"), F.lit("")) != "") & y.isin(0.0, 1.0)).withColumn(label, y.cast("int"))
    return good.join(registry, package, "left")


def new_training_rows(known: DataFrame, rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows whose features and label no known row has (J19), each once; null features equal null features."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f) for f in features], F.col(label)), {"ignoreNullFields": "false"}), 256)
    fresh = rows.withColumn("digest_", digest).dropDuplicates(["digest_"])
    return fresh.join(known.select(digest.alias("digest_")).distinct(), "digest_", "left_anti").drop("digest_")


def package_labels(good: DataFrame, bad: DataFrame, name: str = "name") -> DataFrame:
    """(name, label): the distinct names of both lists (S33, U6).  A name in both is in both."""
    lists = [rows.select(F.trim(name).alias(name)).where(F.col(name) != "").withColumn("label", F.lit(y)) for rows, y in ((good, 0), (bad, 1))]
    return lists[0].unionByName(lists[1]).distinct()


def recent_scores(log: DataFrame, kind: str, order: str, n: int = 500) -> DataFrame:
    """The last ``n`` scores of each kind (R5); the number is the feature."""
    return first_n(log, [kind], [F.desc(order)], n)


def score_drift(recent: DataFrame, training: DataFrame, kind: str, score: str, threshold: float = 0.2) -> DataFrame:
    """(kind, recent_count, train_count, ks, drifted) of recent against training scores (R5, M12); 0 where one side is empty.

    Equal scores move both distributions at once.
    """
    both = recent.select(kind, score, F.lit(1).alias("now_")).unionByName(training.select(kind, score, F.lit(0).alias("now_")))
    per = both.groupBy(kind, score).agg(F.sum("now_").alias("b_"), F.sum(1 - F.col("now_")).alias("a_"))
    whole, run = W.partitionBy(kind), W.partitionBy(kind).orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.sum("a_").over(run), F.sum("a_").over(whole)) - F.try_divide(F.sum("b_").over(run), F.sum("b_").over(whole)))
    found = per.withColumn("gap_", gap).groupBy(kind).agg(F.sum("b_").alias("recent_count"), F.sum("a_").alias("train_count"), F.round(F.coalesce(F.max("gap_"), F.lit(0.0)), 6).alias("ks"))
    return found.withColumn("drifted", F.col("ks") >= threshold)


def provider_blocks(calls: DataFrame, provider: str, ts: str, order: str, error: str) -> DataFrame:
    """Every call with ``blocked``: whether its provider's last refusal still holds.

    A refusal names a fixed sign; with 403 it blocks for an hour, otherwise for six seconds, counted from the call.
    """
    said = F.coalesce(F.col(error), F.lit(""))
    refused = F.lit(False)
    for sign in fixed.REFUSALS:
        refused = refused | said.contains(sign)
    seconds = F.when(said.contains("403"), fixed.LONG_BLOCK).otherwise(fixed.SHORT_BLOCK).cast("long")
    at = micros(ts)
    until = F.when(refused, at + seconds * 1_000_000)
    before = W.partitionBy(provider).orderBy(ts, order).rowsBetween(W.unboundedPreceding, -1)
    return calls.withColumn("blocked", F.coalesce(F.last(until, ignorenulls=True).over(before) > at, F.lit(False)))


def timeline(created: Column, modified: Column, first_commit: Column) -> Column:
    """Events (at, type) of a package by date (O5); unknown dates have none, equal dates keep the order given here."""
    named = [(created, "registry_created"), (modified, "registry_modified"), (first_commit, "first_commit")]
    rows = F.array(*[F.when(c.isNotNull(), F.struct(c.alias("at"), F.lit(i).alias("place"), F.lit(kind).alias("type"))) for i, (c, kind) in enumerate(named)])
    return F.transform(F.array_sort(F.filter(rows, lambda r: r.isNotNull())), lambda r: F.struct(r["at"], r["type"]))


def merged_evidence(docs_score: Column, docs_phrases: Column, issue_score: Column, issue_phrases: Column) -> Column:
    """(score, phrases) of documentation and issues (U4): the mean up to 1 and distinct phrases in order; without issues the first alone."""
    known = issue_score.isNotNull()
    return F.struct(
        F.when(known, F.least(F.lit(1.0), (docs_score + issue_score) / 2)).otherwise(docs_score).alias("score"),
        F.when(known, F.array_union(docs_phrases, F.coalesce(issue_phrases, F.slice(docs_phrases, 1, 0)))).otherwise(docs_phrases).alias("phrases"),
    )
