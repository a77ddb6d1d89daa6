"""Screening of offers against a profile, as ordered cases and a weighted score.

An offer has name, advertiser, condition, raw, approval (per cent), reward and epc (yen), rate and region; every number
may be NULL, which means that it isn't known. The profile is configuration: its keywords become literals of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Funnels as (kind, keywords), condition tiers as (id, score, keywords), exclusions as (reason, keywords); thresholds that are None don't apply."""

    funnels: list[tuple[str, list[str]]]
    tiers: list[tuple[str, float, list[str]]] = field(default_factory=list)
    exclusions: list[tuple[str, list[str]]] = field(default_factory=list)
    areas: list[str] = field(default_factory=list)
    min_approval: float | None = None
    min_epc: float | None = None
    min_reward: int | None = None
    min_score: float = 50.0
    unknown_approval: float = 0.4
    unknown_condition: float = 0.5
    weights: tuple[float, float, float, float] = (40.0, 25.0, 20.0, 15.0)
    epc_full: int = 100
    reward_full: int = 10_000


def _holds(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k.lower())) for k in keywords], F.lit(False))


def _fold(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def funnel(offer: dict[str, Column], profile: Profile) -> Column:
    """struct of weight and kind of the best funnel: 1 if the name holds a keyword, 0.7 the condition or advertiser, 0.5 the text; the first of equals. NULL if none fits."""
    places = [(1.0, _fold(offer["name"])), (0.7, _fold(offer["condition"], offer["advertiser"])), (0.5, _fold(offer["raw"]))]
    found = []
    for n, (kind, words) in enumerate(profile.funnels):
        weight = F.coalesce(*[F.when(_holds(text, words), F.lit(w)) for w, text in places])
        found.append(F.when(weight.isNotNull(), F.struct(weight.alias("weight"), F.lit(-n).alias("order"), F.lit(kind).alias("kind"))))
    return F.array_max(F.array_compact(F.array(*found)))


def screen(offers: DataFrame, profile: Profile) -> DataFrame:
    """All columns of offers and verdict (apply, hold, reject), score, kind, tier and why."""
    o = {c: F.col(c) for c in ("name", "advertiser", "condition", "raw", "approval", "reward", "epc", "rate", "region")}
    p = profile
    whole = _fold(o["name"], o["advertiser"], o["condition"], o["raw"])
    excluded = F.coalesce(*[F.when(_holds(whole, words), F.lit(reason)) for reason, words in p.exclusions], F.lit(None).cast("string"))
    text = F.lower(F.coalesce(F.nullif(o["condition"], F.lit("")), o["raw"]))
    tier = F.coalesce(*[F.when(_holds(text, words), F.struct(F.lit(i).alias("id"), F.lit(float(s)).alias("score"))) for i, s, words in p.tiers], F.struct(F.lit("unknown").alias("id"), F.lit(p.unknown_condition).alias("score")))
    floor = p.min_approval or 0.0
    approval = F.when(o["approval"].isNull(), p.unknown_approval).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (o["approval"] - floor) / max(100.0 - floor, 1.0))))
    earning = F.when(o["epc"].isNotNull(), F.least(F.lit(1.0), o["epc"] / max(p.epc_full, 1))).when(o["reward"].isNotNull(), F.least(F.lit(1.0), o["reward"] / max(p.reward_full, 1))).when(o["rate"].isNotNull(), 0.5).otherwise(0.0)
    elsewhere = F.coalesce(o["region"], F.lit("")) != ""
    elsewhere &= F.lit(bool(p.areas)) & ~_holds(F.lower(o["region"]), [*p.areas, "全国"])
    df = offers.withColumn("_f", funnel(o, p)).withColumn("_t", tier)
    wf, wc, wa, we = p.weights
    score = F.round(F.col("_f.weight") * wf + F.col("_t.score") * wc + approval * wa + earning * we, 4)
    below = lambda c, least: F.lit(False) if least is None else F.coalesce(c < least, F.lit(False))
    rejected = F.when(excluded.isNotNull(), excluded).when(F.col("_f").isNull(), "no_funnel").when(below(o["approval"], p.min_approval), "approval").when(below(o["reward"], p.min_reward), "reward")
    held = F.when(elsewhere, "region").when(o["approval"].isNull(), "approval_unknown").when(below(o["epc"], p.min_epc), "epc").when(F.col("_s") < p.min_score, "score")
    df = df.withColumn("_s", score).withColumn("_r", rejected).withColumn("_h", held)
    named = F.col("_r").isNull() | F.col("_r").isin("approval", "reward")
    return df.withColumns(
        {
            "verdict": F.when(F.col("_r").isNotNull(), "reject").when(F.col("_h").isNotNull(), "hold").otherwise("apply"),
            "score": F.when(F.col("_r").isNotNull(), 0.0).otherwise(F.col("_s")), "kind": F.when(named, F.col("_f.kind")), "tier": F.when(F.col("_r").isNull(), F.col("_t.id")), "why": F.coalesce("_r", "_h", F.lit("")),
        }
    ).drop("_f", "_t", "_s", "_r", "_h")


def ranked(screened: DataFrame) -> DataFrame:
    """Those to apply for first, then those on hold, then the rejected; by falling score, those that need a review first, by name. Equal ones come by id where there is one."""
    rank = F.when(F.col("verdict") == "apply", 0).when(F.col("verdict") == "hold", 1).otherwise(2)
    review = [F.desc_nulls_last("review_required")] if "review_required" in screened.columns else []
    return screened.orderBy(rank, F.desc("score"), *review, "name", *(["id"] if "id" in screened.columns else []))
