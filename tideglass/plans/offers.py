"""Offer screening over parts and their suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import handover, paste
from tideglass.operators.offers import Profile, ranked, screen
from tideglass.session import table

PROFILE = Profile(
    funnels=[("ring", ["ring"]), ("bolt", ["bolt", "promo"]), ("gear", ["gear", "large"])],
    tiers=[("light", 1.0, ["small"]), ("middle", 0.6, ["medium", "standard"]), ("heavy", 0.2, ["large"])],
    exclusions=[("brand", ["brand#13", "brand#7 "])],
    areas=["area1", "area2"],
    min_approval=20.0,
    min_epc=10.0,
    min_reward=905,
    min_score=55.0,
)


def offers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, folder, "part")
    return part.select(
        k.alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit(" ")).alias("advertiser"), F.when(k % 5 != 0, F.col("p_type")).alias("condition"), F.concat_ws(" ", "p_type", "p_name").alias("raw"),
        F.when(k % 6 != 0, (k % 101).cast("double")).alias("approval"), F.when(k % 4 != 0, F.col("p_retailprice").cast("long")).alias("reward"), F.when(k % 3 == 0, (k % 150).cast("double")).alias("epc"),
        F.when(k % 8 == 0, 5.0).alias("rate"), F.when(k % 7 == 0, F.concat(F.lit("area"), (k % 4).cast("string"))).alias("region"),
    )


def offer_screen(spark: SparkSession, folder: str) -> DataFrame:
    return screen(offers(spark, folder), PROFILE).select("id", "verdict", "score", "kind", "tier", "why")


#: Pasted listings of three layouts, and the offers in them: place, name, yen, rate, condition, approval, days of the cookie.
PASTES = [
    "検索結果 31件\n\n山の家買取サービス\n株式会社やまのいえ\n成果報酬 12,000円\n成果条件 査定申込の完了\n確定率 82.5%\n\n海の家リフォーム\n合同会社うみ\n成果報酬 5%\n成果条件 見積依頼の完了\n確定率 -\n",
    "広告サンプル\n畑の土地相談\nはたけ株式会社\n成果報酬（税込）:\n新規相談申込\n20000円\nEPC\n-\n確定率\n91.2%\n---\n森の管理代行\nもり社\n成果報酬\n3,000円\n再訪問\n90日\n",
    "空き地の片付け\nサイト\n成果 8,000円\n未申請\n空き地の片付け\n成約後: 20,000円\n再訪問 90日\n草刈りの匠\nサイト\n成果 700円\n未申請\nお問い合わせ完了後: 5,000円\n",
    "ただの文章です。\n提携先の会社について",
]
FOUND = [
    (0, 0, "山の家買取サービス", 12000, None, "査定申込の完了", 82.5, None), (0, 1, "海の家リフォーム", None, 5.0, "見積依頼の完了", None, None), (1, 0, "畑の土地相談", 20000, None, "新規相談申込", 91.2, None), (1, 1, "森の管理代行", 3000, None, "", None, 90),
    (2, 0, "空き地の片付け", 8000, None, "成約後", None, 90), (2, 1, "草刈りの匠", 700, None, "お問い合わせ完了後", None, None),
]


def paste_offers(spark: SparkSession, folder: str) -> DataFrame:
    """The offers in one of the listings above, for each customer."""
    k = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, PASTES)), (k % len(PASTES) + 1).cast("int"))
    return paste.parse(table(spark, folder, "customer").select(k.alias("id"), text.alias("text"))).select("id", "place", "name", "reward_yen", "reward_rate", "condition", "approval_rate", "cookie_days")


def offer_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty offers in the order in which they are gone through."""
    return ranked(screen(offers(spark, folder), PROFILE)).limit(50).select("id", "verdict", "score")


#: A form for code and one for a table of offers, with the names of their values in braces.
CODE = 'Offer(id={id}, kind="{kind}", name="{name}", reward={reward}, words=[{words}], {unknown})'
FORM = {"offer": {"id": "{id}", "label": "{kind}: {name}", "words": "{words_list}"}, "reward": "{reward}", "fixed": [1, 2]}


def offer_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the screening, line by line."""
    lines = handover.report(screen(offers(spark, folder), PROFILE), "sample")
    return lines.select("place.section", "place.part", "place.n", "line")


def offer_handover(spark: SparkSession, folder: str) -> DataFrame:
    """Each offer that isn't rejected in the forms of its takers."""
    kept = screen(offers(spark, folder), PROFILE).filter("verdict <> 'reject'").withColumn("words", F.split("name", " "))
    values = {**{c: F.col(c) for c in ("id", "kind", "name", "reward")}, "words": handover.listed(F.col("words")), "words_list": F.col("words")}
    return kept.select("id", handover.filled(CODE, values, "None").alias("code"), handover.handed_over(FORM, values).alias("form"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"offer_screen": offer_screen, "offer_order": offer_order, "paste_offers": paste_offers, "offer_report": offer_report, "offer_handover": offer_handover}
_SAID = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in FOUND)
_HIT = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
ORACLES = {
    "offer_screen": f"""WITH o AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_brand) || ' ' AS adv, CASE WHEN p_partkey % 5 <> 0 THEN lower(p_type) END AS cond, lower(p_type || ' ' || p_name) AS raw,
CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 101 END AS approval, CASE WHEN p_partkey % 4 <> 0 THEN CAST(trunc(p_retailprice) AS BIGINT) END AS reward, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 150 END AS epc,
CASE WHEN p_partkey % 8 = 0 THEN 5.0 END AS rate, CASE WHEN p_partkey % 7 = 0 THEN 'area' || (p_partkey % 4) END AS region FROM part),
f AS (SELECT *, concat_ws(' ', name, adv, cond, raw) AS hay, concat_ws(' ', cond, adv) AS near, coalesce(nullif(cond, ''), raw) AS txt FROM o),
w AS (SELECT *, {", ".join(f"CASE WHEN {_HIT('name', ws)} THEN 1.0e0 WHEN {_HIT('near', ws)} THEN 0.7e0 WHEN {_HIT('raw', ws)} THEN 0.5e0 ELSE 0 END AS w{i}" for i, (_, ws) in enumerate(PROFILE.funnels))},
CASE {" ".join(f"WHEN {_HIT('txt', ws)} THEN '{t}'" for t, _, ws in PROFILE.tiers)} ELSE 'unknown' END AS tid, CASE {" ".join(f"WHEN {_HIT('txt', ws)} THEN {s}e0" for _, s, ws in PROFILE.tiers)} ELSE 0.5e0 END AS ts FROM f),
x AS (SELECT *, greatest(w0, w1, w2) AS fw, CASE WHEN greatest(w0, w1, w2) = 0 THEN NULL WHEN w0 >= w1 AND w0 >= w2 THEN 'ring' WHEN w1 >= w2 THEN 'bolt' ELSE 'gear' END AS k FROM w),
y AS (SELECT *, round(fw * 40e0 + ts * 25e0 + CASE WHEN approval IS NULL THEN 0.4e0 ELSE least(1e0, greatest(0e0, (approval - 20e0) / 80e0)) END * 20e0
+ CASE WHEN epc IS NOT NULL THEN least(1e0, epc / 100e0) WHEN reward IS NOT NULL THEN least(1e0, reward / 10000e0) WHEN rate IS NOT NULL THEN 0.5e0 ELSE 0 END * 15e0, 4) AS s,
CASE WHEN {_HIT('hay', ['brand#13', 'brand#7 '])} THEN 'brand' WHEN k IS NULL THEN 'no_funnel' WHEN approval < 20 THEN 'approval' WHEN reward < 905 THEN 'reward' END AS r FROM x),
z AS (SELECT *, CASE WHEN region IS NOT NULL AND NOT {_HIT('region', ['area1', 'area2'])} THEN 'region' WHEN approval IS NULL THEN 'approval_unknown' WHEN epc < 10 THEN 'epc' WHEN s < 55 THEN 'score' END AS h FROM y)
SELECT id, CASE WHEN r IS NOT NULL THEN 'reject' WHEN h IS NOT NULL THEN 'hold' ELSE 'apply' END AS verdict, CASE WHEN r IS NOT NULL THEN 0e0 ELSE s END AS score, CASE WHEN r IS NULL OR r IN ('approval', 'reward') THEN k END AS kind, CASE WHEN r IS NULL THEN tid END AS tier, coalesce(r, h, '') AS why FROM z""",
    "paste_offers": f"""SELECT c_custkey AS id, CAST(place AS INTEGER) AS place, name, CAST(yen AS BIGINT) AS reward_yen, CAST(rate AS DOUBLE) AS reward_rate, condition, CAST(approval AS DOUBLE) AS approval_rate, CAST(days AS INTEGER) AS cookie_days
FROM customer JOIN (VALUES {_SAID}) f(i, place, name, yen, rate, condition, approval, days) ON c_custkey % {len(PASTES)} = i""",
}
ORACLES["offer_order"] = f"""SELECT id, verdict, score FROM (SELECT s.*, p_name FROM ({ORACLES["offer_screen"]}) s JOIN part ON p_partkey = id) ORDER BY CASE verdict WHEN 'apply' THEN 0 WHEN 'hold' THEN 1 ELSE 2 END, score DESC, p_name, id LIMIT 50"""
ORACLES["offer_report"] = f"""WITH s AS (SELECT s.*, p_name AS name, p_brand AS adv, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS cond FROM ({ORACLES["offer_screen"]}) s JOIN part ON p_partkey = id),
c AS (SELECT count(*) FILTER (verdict = 'apply') AS a, count(*) FILTER (verdict = 'hold') AS h, count(*) FILTER (verdict = 'reject') AS r FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY score DESC, name, id) AS n FROM s),
x AS (SELECT 0 AS section, unnest(['# 案件の選定結果（プロファイル: sample）', format('申請 {{}} 件 / 保留 {{}} 件 / 除外 {{}} 件（合計 {{}} 件）', a, h, r, a + h + r)]) AS line, generate_subscripts([1, 2], 1) - 1 AS n FROM c
UNION ALL SELECT 1, unnest(CASE WHEN a > 0 THEN ['## 申請する順', '| # | 案件名 | 広告主 | 種別 | 成果条件 | 点 | 理由 |', '| --- | --- | --- | --- | --- | --- | --- |'] ELSE ['## 申請する順', '採用できる案件が無い。'] END), unnest(CASE WHEN a > 0 THEN [0, 1, 2] ELSE [0, 1] END) FROM c
UNION ALL SELECT 2, unnest(CASE WHEN h > 0 THEN ['## 保留（今は出さないが、候補として残す）', '| # | 案件名 | 広告主 | 種別 | 成果条件 | 点 | 理由 |', '| --- | --- | --- | --- | --- | --- | --- |'] ELSE [] END), unnest(CASE WHEN h > 0 THEN [0, 1, 2] ELSE [] END) FROM c
UNION ALL SELECT 3, unnest(CASE WHEN r > 0 THEN ['## 除外', '| # | 案件名 | 広告主 | 除外理由 |', '| --- | --- | --- | --- |'] ELSE ['## 除外', '除外した案件は無い。'] END), unnest(CASE WHEN r > 0 THEN [0, 1, 2] ELSE [0, 1] END) FROM c)
SELECT section, 1 AS part, CAST(n AS BIGINT) AS n, line FROM x UNION ALL
SELECT CASE verdict WHEN 'apply' THEN 1 WHEN 'hold' THEN 2 ELSE 3 END, 2, n, CASE WHEN verdict = 'reject' THEN concat('| ', n, ' | ', name, ' | ', adv, ' | ', why, ' |')
ELSE concat('| ', n, ' | ', name, ' | ', adv, ' | ', kind, ' | ', CASE WHEN tier <> 'unknown' THEN tier ELSE coalesce(cond, 'unknown') END, ' | ', printf('%.0f', score), ' | ', coalesce(nullif(why, ''), '-'), ' |') END FROM n"""
ORACLES["offer_handover"] = f"""WITH s AS (SELECT s.id, kind, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN CAST(trunc(p_retailprice) AS BIGINT) END AS reward, string_split(p_name, ' ') AS ws FROM ({ORACLES["offer_screen"]}) s JOIN part ON p_partkey = id WHERE verdict <> 'reject')
SELECT id, concat('Offer(id=', id, ', kind="', kind, '", name="', name, '", reward=', coalesce(CAST(reward AS VARCHAR), 'None'), ', words=["', array_to_string(ws, '", "'), '"], {{unknown}})') AS code,
concat('{{"offer":{{"id":', id, ',"label":"', kind, ': ', name, '","words":["', array_to_string(ws, '","'), '"]}},"reward":', coalesce(CAST(reward AS VARCHAR), 'null'), ',"fixed":[1,2]}}') AS form FROM s"""
