"""Risk and trust over dependency graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def propagate_risk(nodes: DataFrame, edges: DataFrame, decay: float = 0.85) -> DataFrame:
    """(node, base, risk) with risk = min(1, max(base, decay * parent's)), from the roots down (G1).

    ``nodes`` (node, base), ``edges`` (parent, child).  A node with several parents takes the highest.  Each step
    joins only the nodes whose risk has just risen to their children, until none rises: graphs of any depth are
    done, and cycles end, as risk shrinks along them.
    """
    best = cut(nodes.select("node", "base", F.least(F.lit(1.0), F.col("base")).alias("risk")))
    raised = best.select("node", "risk")
    while True:
        below = edges.join(raised, edges["parent"] == raised["node"]).groupBy(F.col("child").alias("c_")).agg((F.max("risk") * decay).alias("from_parent"))
        moved = best.join(below, F.col("node") == F.col("c_"), "left")
        rises = F.coalesce(F.col("from_parent") > F.col("risk"), F.lit(False))
        marked = cut(moved.select("node", "base", F.when(rises, F.col("from_parent")).otherwise(F.col("risk")).alias("risk"), rises.alias("rose")))
        raised = marked.where("rose").select("node", "risk")
        if raised.isEmpty():
            return marked.select("node", "base", "risk")
        best = marked.select("node", "base", "risk")


def highest_risk(risks: DataFrame) -> DataFrame:
    """(risk) of the whole graph: the highest of its nodes."""
    return risks.agg(F.max("risk").alias("risk"))


def root_risks(risks: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, base, risk) of nodes without a parent."""
    return risks.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def impacted(risks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Nodes at or above the threshold, highest first."""
    return risks.where(F.col("risk") >= threshold).orderBy(F.desc("risk"), "node")


def transitive_trust(nodes: DataFrame, edges: DataFrame, weight: float = 0.3) -> DataFrame:
    """(node, trust) from the leaves up (G2, A32): the direct score if there is one, else weight times the mean of the children's.

    ``nodes`` (node, direct).  Children without a direct score count only if theirs is above 0.  Level by level, to
    any depth: a node is settled when all its children are.  Nodes on a cycle without a direct score, and those
    above one, are never settled; they have trust 0.
    """
    known = cut(nodes.where("direct IS NOT NULL").select("node", F.col("direct").alias("trust"), F.lit(True).alias("counts"))
                .unionByName(nodes.where("direct IS NULL").join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0.0).alias("trust"), F.lit(False).alias("counts"))))
    while True:
        open_ = nodes.join(known.select("node"), "node", "left_anti").select("node")
        children = edges.join(open_, edges["parent"] == open_["node"], "left_semi").join(known, edges["child"] == known["node"], "left")
        ready = children.groupBy("parent").agg(F.count_if(F.col("counts").isNull()).alias("missing"), F.avg(F.when(F.col("counts"), F.col("trust"))).alias("mean"))
        fresh = ready.where("missing = 0").select(F.col("parent").alias("node"), F.least(F.lit(1.0), F.coalesce(F.col("mean") * weight, F.lit(0.0))).alias("trust"))
        fresh = cut(fresh.withColumn("counts", F.col("trust") > 0))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return nodes.join(known.select("node", "trust"), "node", "left").select("node", F.coalesce("trust", F.lit(0.0)).alias("trust"))
