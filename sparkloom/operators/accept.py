"""Candidates accepted up to a quota per group, none too like a held-out text, each text once.

Candidates come in an order. Of those not too like a held-out text, the first of a fingerprint counts,
and the first ``quota`` of a group are taken; what a candidate meets doesn't hang on later ones, so
this can be done in rounds of growing size, and only candidates of a round are compared. A round ends
with what it took in the shared folder; rounds go on until quotas are full or candidates end, which
takes a logarithm of rounds. The driver sees counts by group.

Cases: groups without a quota take none; a null text is its own fingerprint and like nothing; equal
places in the order go by the candidate's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.similar import best_ratio
from sparkloom.session import settled


def accepted(candidates: DataFrame, held_out: DataFrame, quotas: DataFrame, threshold: float, first: int = 2) -> DataFrame:
    """candidate_id, grp, fingerprint, similarity of the candidates that are taken.

    ``candidates`` has candidate_id, grp, text and place (from 0 within its group, without gaps);
    ``held_out`` has item_id and text; ``quotas`` has grp and quota, one row per group.
    """
    rows = candidates.join(quotas, "grp").withColumn("fingerprint", F.sha1(F.concat_ws("|", "grp", F.coalesce("text", F.lit("\0")))))
    rows = settled(rows)
    taken = None
    low, size = 0, first
    while True:
        here = rows.filter((F.col("place") >= F.col("quota") * low) & (F.col("place") < F.col("quota") * (low + size)))
        if taken is not None:
            full = taken.groupBy("grp").agg(F.count("*").alias("have"))
            here = here.join(full, "grp", "left").filter(F.coalesce("have", F.lit(0)) < F.col("quota")).drop("have")
            here = here.join(taken.select("fingerprint"), "fingerprint", "left_anti")
        scores = best_ratio(here.select(F.col("candidate_id").alias("doc_id"), "text"), held_out).select(F.col("doc_id").alias("candidate_id"), "similarity")
        good = here.join(scores, "candidate_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).filter(F.col("similarity") < threshold)
        one = good.withColumn("r", F.row_number().over(W.partitionBy("fingerprint").orderBy("place", "candidate_id"))).filter("r = 1").drop("r")
        have = one.withColumn("have", F.lit(0)) if taken is None else one.join(full, "grp", "left").fillna(0, ["have"])
        fit = have.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy("place", "candidate_id"))).filter(F.col("r") + F.col("have") <= F.col("quota"))
        new = fit.select("candidate_id", "grp", "fingerprint", "similarity")
        taken = settled(new if taken is None else taken.unionByName(new))
        low, size = low + size, size * 2
        have = taken.groupBy("grp").agg(F.count("*").alias("have"))
        short = rows.join(have, "grp", "left").filter((F.coalesce("have", F.lit(0)) < F.col("quota")) & (F.col("place") >= F.col("quota") * low))
        if short.isEmpty():
            return taken
