"""Workload queries. Tasks are (user, day) slices of the event table; answers and EEG ratios follow from its numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import scoring as SC
from loomwright.operators import workload as W
from loomwright.plans.registry import query
from loomwright.session import shared_folder

c = F.col
AS_OF = "2024-01-30 00:00:00"
KEYS = ["user_id", "task_id"]


def behaviour_events(t):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(c("event_type") == "signup", "task_start").when(c("event_type") == "purchase", "task_end")
        .when(c("event_type") == "error", "error_or_repeat")
        .when((c("event_type") == "view") & (c("k") % 3 == 0), "back").when(c("event_type") == "view", "step_view").otherwise("click")
    )
    base = t.events.withColumn("k", k)
    return base.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("task_id"), kind.alias("event_type"), "value", "k",
        F.unix_millis("ts").alias("ts"), c("event_id").alias("pos"), c("ts").alias("happened"),
        F.when(c("k") % 5 == 0, None).otherwise(c("k") % 4).alias("total_steps"),
    )


BEH = """beh AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS task_id, CASE event_type WHEN 'signup' THEN 'task_start' WHEN 'purchase' THEN 'task_end'
 WHEN 'error' THEN 'error_or_repeat' WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'back' ELSE 'step_view' END ELSE 'click' END AS event_type,
 value, k, epoch_us(ts) // 1000 AS ts, event_id AS pos, ts AS happened, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 4 END AS total_steps
 FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events))"""
FEAT = f"""{BEH},
agg AS (SELECT user_id, task_id, count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'back') AS back_count,
 count(*) FILTER (event_type = 'error_or_repeat') AS error_count, count(*) FILTER (event_type = 'step_view') AS step_count,
 min_by(ts, pos) FILTER (event_type = 'task_start') AS s, min_by(ts, pos) FILTER (event_type = 'task_end') AS e,
 CASE WHEN count(*) >= 2 THEN max(ts) - min(ts) ELSE 0 END AS span, max(coalesce(nullif(total_steps, 0), 1)) FILTER (event_type = 'step_view') AS steps
 FROM beh GROUP BY ALL),
feat AS (SELECT user_id, task_id, click_count, back_count, error_count, step_count, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e - s ELSE span END AS duration_ms,
 round(back_count / greatest(click_count + back_count + error_count, 1), 4) AS back_rate,
 round(error_count / greatest(click_count + back_count + error_count, 1), 4) AS error_rate,
 round(click_count / greatest((CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e - s ELSE span END) / 1000, 1), 4) AS click_density,
 round(CASE WHEN e IS NULL THEN 1.0 ELSE least(step_count / greatest(coalesce(steps, 1), 1), 1.0) END::DOUBLE, 4) AS completion_rate,
 round((CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e - s ELSE span END) / greatest(step_count, 1), 2) AS time_per_step FROM agg)"""


def _unit(x, low, high):
    return f"least(greatest(({x} - {low}) / ({high} - {low}), 0), 1)"


BSCORE = f"""{FEAT},
bs AS (SELECT *, round(least(greatest({_unit('back_rate', 0.1, 0.3)} * 0.25 + {_unit('error_rate', 0.05, 0.15)} * 0.2
 + {_unit('click_density', 0.3, 0.8)} * 0.15 + {_unit('duration_ms / 1000', 30, 180)} * 0.2 + 0.1, 0), 1)::DOUBLE, 4) AS behavior_score FROM feat)"""
# answers exist for most tasks, EEG ratios for some
DIMS = V.TLX_DIMENSIONS
TLX = f"""tlx AS (SELECT user_id, task_id, {', '.join(f"CAST((sum(k) * {i + 1} + count(*)) % 7 + 1 AS INT) AS {d}" for i, d in enumerate(DIMS))}
 FROM beh GROUP BY ALL HAVING sum(k) % 5 <> 0),
ts AS (SELECT *, (mental_demand + physical_demand + temporal_demand + effort + frustration - 5 + 7 - performance) / 36 AS questionnaire_score FROM tlx)"""
EEG = """eeg AS (SELECT user_id, task_id, (sum(k) % 50) / 10 AS theta_beta, (sum(k) % 30) / 10 AS alpha_beta, (count(*) % 4) / 2 AS theta_alpha, count(*) > 1 AS any_power
 FROM beh GROUP BY ALL HAVING sum(k) % 3 = 0),
es AS (SELECT *, CASE WHEN any_power THEN least(greatest(0.5 * least(coalesce(nullif(theta_beta, 0), 1.5) / 3, 1) + 0.3 * (1 - least(coalesce(nullif(alpha_beta, 0), 1.5) / 2.5, 1))
 + 0.2 * coalesce(nullif(theta_alpha, 0), 1.0) / 2.5, 0), 1) ELSE 0.5 END::DOUBLE AS eeg_score FROM eeg)"""
ASSESS = f"""{BSCORE}, {TLX}, {EEG},
base AS (SELECT user_id, sum(k) % 10 / 10.0 AS baseline FROM beh GROUP BY ALL HAVING count(*) % 2 = 0),
fused AS (SELECT user_id, task_id, behavior_score, questionnaire_score, eeg_score, (behavior_score * 0.4 + coalesce(questionnaire_score * 0.6, 0)) / (0.4 + CASE WHEN questionnaire_score IS NULL THEN 0 ELSE 0.6 END) AS f
 FROM bs LEFT JOIN ts USING (user_id, task_id) LEFT JOIN es USING (user_id, task_id)),
marks AS (SELECT user_id, task_id, max(happened) AS created_at, CASE sum(k) % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'patient_education' ELSE '' END AS source FROM beh GROUP BY ALL),
assessed AS (SELECT user_id, task_id, round(f::DOUBLE, 4) AS final_score, CASE WHEN f < CASE WHEN baseline IS NULL THEN 0.4 ELSE greatest(0.1, baseline * 0.7) END THEN 'low' WHEN f < CASE WHEN baseline IS NULL THEN 0.7 ELSE least(0.9, baseline * 1.3) END THEN 'medium' ELSE 'high' END AS level,
 behavior_score, round(questionnaire_score::DOUBLE, 4) AS questionnaire_score, round(eeg_score, 4) AS eeg_score, created_at, source
 FROM fused LEFT JOIN base USING (user_id) JOIN marks USING (user_id, task_id))"""
FULL = f"{ASSESS}, fullrow AS (SELECT * FROM assessed JOIN (SELECT * EXCLUDE (behavior_score) FROM bs) USING (user_id, task_id) LEFT JOIN tlx USING (user_id, task_id))"


def features(t):
    return W.behaviour_features(behaviour_events(t), KEYS)


def answers(t):
    total, n = F.sum("k"), F.count("*")
    dims = [((total * (i + 1) + n) % 7 + 1).cast("int").alias(d) for i, d in enumerate(DIMS)]
    return behaviour_events(t).groupBy(*KEYS).agg(*dims, total.alias("_k")).filter("_k % 5 <> 0").drop("_k")


def eeg_rows(t):
    total, n = F.sum("k"), F.count("*")
    rows = behaviour_events(t).groupBy(*KEYS).agg(
        ((total % 50) / 10).alias("theta_beta"), ((total % 30) / 10).alias("alpha_beta"), ((n % 4) / 2).alias("theta_alpha"),
        (n > 1).alias("any_power"), total.alias("_k"),
    )
    score = SC.eeg_score(c("theta_beta"), c("alpha_beta"), c("theta_alpha"), c("any_power"))
    return rows.filter("_k % 3 = 0").drop("_k").withColumn("eeg_score", score)


def assessments(t):
    events = behaviour_events(t)
    baselines = events.groupBy("user_id").agg((F.sum("k") % 10 / 10.0).alias("baseline"), F.count("*").alias("n")).filter("n % 2 = 0")
    k = F.sum("k") % 3
    marks = events.groupBy(*KEYS).agg(
        F.max("happened").alias("created_at"), F.when(k == 0, "chat").when(k == 1, "patient_education").otherwise("").alias("source")
    )
    scored = W.assess(
        W.behaviour_scores(features(t)).select(*KEYS, "behavior_score"), W.tlx_scores(answers(t)).select(*KEYS, "questionnaire_score"),
        eeg_rows(t).select(*KEYS, "eeg_score"), KEYS, baselines,
    )
    return scored.join(marks, KEYS)


def full_rows(t):
    return assessments(t).join(features(t), KEYS).join(answers(t), KEYS, "left")


@query("cl1_behaviour_features", f"WITH {FEAT} SELECT * FROM feat")
def _(t):
    return features(t)


@query("cl2_behaviour_score", f"""WITH {BSCORE} SELECT user_id, task_id, behavior_score,
 CASE WHEN behavior_score < 0.35 THEN 'low' WHEN behavior_score < 0.65 THEN 'medium' ELSE 'high' END AS behavior_level FROM bs""")
def _(t):
    return W.behaviour_scores(features(t)).select(*KEYS, "behavior_score", "behavior_level")


@query("cl3_4_questionnaire_score", f"""WITH {BEH}, {TLX} SELECT user_id, task_id, round((mental_demand - 1) / 6, 6) AS mental, round(questionnaire_score, 6) AS score,
 round((2 * (mental_demand - 1) / 6 + (frustration - 1) / 6) / 3, 6) AS weighted,
 CASE WHEN questionnaire_score < 0.4 THEN 'low' WHEN questionnaire_score < 0.7 THEN 'medium' ELSE 'high' END AS level FROM ts""")
def _(t):
    plain = W.tlx_scores(answers(t))
    zero = {d: 0.0 for d in DIMS}
    weighted = SC.tlx_score({d: c(f"{d}_unit") for d in DIMS}, {**zero, "mental_demand": 2.0, "frustration": 1.0})
    return plain.select(
        *KEYS, F.round("mental_demand_unit", 6).alias("mental"), F.round("questionnaire_score", 6).alias("score"),
        F.round(weighted, 6).alias("weighted"), c("questionnaire_level").alias("level"),
    )


RADAR = " UNION ALL ".join(
    f"SELECT user_id, task_id, '{V.TLX_LABELS[d]}' AS dimension, coalesce({d}, 4) AS raw_score, round((coalesce({d}, 4) - 1) / 6, 3) AS score, {V.TLX_NORMS[d]}::DOUBLE AS norm FROM x"
    for d in DIMS
)


@query("cl5_radar", f"WITH {BEH}, {TLX}, x AS (SELECT user_id, task_id, {', '.join(f't.{d}' for d in DIMS)} FROM (SELECT DISTINCT user_id, task_id FROM beh) LEFT JOIN tlx t USING (user_id, task_id)) {RADAR}")
def _(t):
    tasks = behaviour_events(t).select(*KEYS).distinct()
    return W.radar(tasks.join(answers(t), KEYS, "left"), KEYS)


@query("cl6_levels", f"""WITH {ASSESS} SELECT user_id, task_id, CASE WHEN eeg_score > 0.7 THEN 'high' WHEN eeg_score > 0.4 THEN 'medium' ELSE 'low' END AS eeg_level,
 CASE WHEN final_score < 0.4 THEN 'low' WHEN final_score < 0.7 THEN 'medium' ELSE 'high' END AS fusion_level FROM assessed WHERE eeg_score IS NOT NULL""")
def _(t):
    rows = assessments(t).filter("eeg_score is not null")
    return rows.select(*KEYS, SC.eeg_level(c("eeg_score")).alias("eeg_level"), SC.level_for(c("final_score"), "fusion").alias("fusion_level"))


@query("cl7_personal_cuts", f"WITH {ASSESS} SELECT user_id, round(greatest(0.1, baseline * 0.7)::DOUBLE, 6) AS low, round(least(0.9, baseline * 1.3)::DOUBLE, 6) AS high FROM base")
def _(t):
    base = behaviour_events(t).groupBy("user_id").agg((F.sum("k") % 10 / 10.0).alias("baseline"), F.count("*").alias("n"))
    low, high = SC.personal_cuts(c("baseline"))
    return base.filter("n % 2 = 0").select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("cl8_fusion", f"""WITH {ASSESS} SELECT user_id, task_id,
 CASE WHEN eeg_score IS NULL AND questionnaire_score IS NULL THEN 0.5 ELSE round(((coalesce(questionnaire_score, 0) + coalesce(eeg_score, 0)) / 2
  / ((CASE WHEN questionnaire_score IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN eeg_score IS NULL THEN 0 ELSE 0.5 END)))::DOUBLE, 6) END::DOUBLE AS fused,
 CASE WHEN eeg_score IS NULL AND questionnaire_score IS NULL THEN 'default' ELSE 'weighted' END AS method,
 CASE WHEN eeg_score IS NULL THEN NULL WHEN questionnaire_score IS NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS eeg_weight FROM assessed WHERE eeg_score IS NOT NULL OR questionnaire_score IS NULL""")
def _(t):
    rows = assessments(t).filter("eeg_score is not null or questionnaire_score is null")
    scores = {"questionnaire": c("questionnaire_score"), "eeg": c("eeg_score")}
    weights = {"questionnaire": 0.5, "eeg": 0.5}
    share = F.when(c("eeg_score").isNotNull(), SC.adjusted_weights(scores, weights)["eeg"])
    return rows.select(
        *KEYS, F.round(SC.fused_score(scores, weights), 6).alias("fused"), SC.fusion_method(scores).alias("method"),
        F.round(share, 6).alias("eeg_weight"),
    )


@query("cl6_all_levels", f"""WITH {ASSESS} SELECT user_id, task_id, CASE WHEN eeg_score IS NULL THEN NULL WHEN eeg_score > 0.7 THEN 'high' WHEN eeg_score > 0.4 THEN 'medium' ELSE 'low' END AS eeg_level,
 CASE WHEN final_score < 0.4 THEN 'low' WHEN final_score < 0.7 THEN 'medium' ELSE 'high' END AS fusion_level FROM assessed""")
def _(t):
    eeg = F.when(c("eeg_score").isNotNull(), SC.eeg_level(c("eeg_score")))
    return assessments(t).select(*KEYS, eeg.alias("eeg_level"), SC.level_for(c("final_score"), "fusion").alias("fusion_level"))


@query("cl7_all_cuts", f"""WITH {ASSESS} SELECT DISTINCT user_id, CASE WHEN baseline IS NULL THEN 0.4 ELSE round(greatest(0.1, baseline * 0.7)::DOUBLE, 6) END::DOUBLE AS low,
 CASE WHEN baseline IS NULL THEN 0.7 ELSE round(least(0.9, baseline * 1.3)::DOUBLE, 6) END::DOUBLE AS high FROM beh LEFT JOIN base USING (user_id)""")
def _(t):
    users = behaviour_events(t).groupBy("user_id").agg((F.sum("k") % 10 / 10.0).alias("_b"), F.count("*").alias("n"))
    low, high = SC.personal_cuts(F.when(c("n") % 2 == 0, c("_b")))
    return users.select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("cl8_all_fusions", f"""WITH {ASSESS} SELECT user_id, task_id,
 CASE WHEN eeg_score IS NULL AND questionnaire_score IS NULL THEN 0.5 ELSE round(((coalesce(questionnaire_score, 0) + coalesce(eeg_score, 0)) / 2
  / ((CASE WHEN questionnaire_score IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN eeg_score IS NULL THEN 0 ELSE 0.5 END)))::DOUBLE, 6) END::DOUBLE AS fused,
 CASE WHEN eeg_score IS NULL AND questionnaire_score IS NULL THEN 'default' ELSE 'weighted' END AS method,
 CASE WHEN eeg_score IS NULL THEN NULL WHEN questionnaire_score IS NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS eeg_weight FROM assessed""")
def _(t):
    scores = {"questionnaire": c("questionnaire_score"), "eeg": c("eeg_score")}
    weights = {"questionnaire": 0.5, "eeg": 0.5}
    share = F.when(c("eeg_score").isNotNull(), SC.adjusted_weights(scores, weights)["eeg"])
    return assessments(t).select(
        *KEYS, F.round(SC.fused_score(scores, weights), 6).alias("fused"), SC.fusion_method(scores).alias("method"), F.round(share, 6).alias("eeg_weight"))


@query("cl9_assessments", f"WITH {ASSESS} SELECT * FROM assessed")
def _(t):
    return assessments(t).select(*KEYS, "final_score", "level", "behavior_score", "questionnaire_score", "eeg_score", "created_at", "source")


def picked(rules):
    """SQL for the chosen categories: high ones first, then medium, in rule order, five at most."""
    high = ", ".join(f"CASE WHEN ({when}) AND ({prio}) = 'high' THEN '{name}' END" for when, name, prio in rules)
    medium = ", ".join(f"CASE WHEN ({when}) AND ({prio}) = 'medium' THEN '{name}' END" for when, name, prio in rules)
    return f"array_to_string(list_filter([{high}, {medium}], lambda x: x IS NOT NULL)[1:5], '|')"


def joined_names(column):
    return F.array_join(F.transform(column, lambda x: x["category"]), "|")


@query("cl10_behaviour_suggestions", f"""WITH {FEAT} SELECT user_id, task_id, {picked([
 ("back_rate > 0.2", "导航优化", "CASE WHEN back_rate > 0.3 THEN 'high' ELSE 'medium' END"),
 ("error_rate > 0.1", "界面优化", "CASE WHEN error_rate > 0.15 THEN 'high' ELSE 'medium' END"),
 ("click_density > 0.6", "界面简化", "'medium'"), ("duration_ms > 180000", "内容拆分", "'medium'"), ("completion_rate < 0.7", "任务简化", "'high'")])} AS categories FROM feat""")
def _(t):
    return features(t).select(*KEYS, joined_names(W.behaviour_suggestions()).alias("categories"))


@query("cl11_questionnaire_suggestions", f"""WITH {FEAT}, {TLX} SELECT user_id, task_id, {picked([
 ("(mental_demand - 1) / 6 >= 0.67", "内容优化", "'high'"), ("(mental_demand - 1) / 6 >= 0.67", "呈现方式", "'high'"), ("(frustration - 1) / 6 >= 0.5", "用户体验", "'high'"),
 ("(temporal_demand - 1) / 6 >= 0.67", "时间安排", "'medium'"), ("(effort - 1) / 6 >= 0.67", "操作简化", "'medium'")])} AS from_units,
 {picked([("mental_demand >= 5", "内容优化", "'high'"), ("frustration >= 4", "用户体验", "'high'"), ("back_rate > 0.2", "导航优化", "'medium'")])} AS from_answers
 FROM tlx JOIN feat USING (user_id, task_id)""")
def _(t):
    rows = W.tlx_scores(answers(t)).join(features(t), KEYS)
    return rows.select(*KEYS, joined_names(W.tlx_suggestions()).alias("from_units"), joined_names(W.report_suggestions()).alias("from_answers"))


TOP = f"greatest({', '.join(DIMS)})"
TOPNAME = "CASE " + " ".join(f"WHEN {d} = {TOP} THEN '{V.TLX_LABELS[d]}'" for d in DIMS) + " END"


@query("cl12_14_findings", f"""WITH {FULL} SELECT user_id, task_id, array_to_string(list_filter([
 CASE WHEN back_rate > 0.1 THEN '回退率为' || printf('%.0f', back_rate * 100) || CASE WHEN back_rate > 0.2 THEN '%，高于正常水平，可能遇到理解困难' ELSE '%，处于正常范围' END END,
 CASE WHEN error_rate > 0.1 THEN '错误操作率为' || printf('%.0f', error_rate * 100) || '%，建议简化操作流程' END,
 CASE WHEN {TOP} >= 5 THEN 'NASA-TLX中' || {TOPNAME} || '维度得分最高(' || {TOP} || '/7)，是主要负荷来源' END,
 CASE WHEN duration_ms > 180000 THEN '任务完成耗时' || printf('%.1f', duration_ms / 60000) || '分钟较长，可能内容偏多或难度偏高' END,
 CASE WHEN duration_ms > 0 AND duration_ms < 15000 THEN '任务完成较快(' || printf('%.0f', duration_ms / 1000) || '秒)，内容相对简单' END], lambda x: x IS NOT NULL), '|') AS findings,
 (final_score > 0.7)::INT + coalesce(frustration >= 5, false)::INT + (back_rate > 0.3)::INT + (error_rate > 0.15)::INT + (duration_ms > 300000)::INT AS n_alerts,
 (final_score < 0.4)::INT + (completion_rate >= 0.9)::INT + (error_rate < 0.05)::INT + coalesce(performance >= 5, false)::INT + coalesce(frustration <= 2, false)::INT AS n_positive
FROM fullrow""")
def _(t):
    return full_rows(t).select(
        *KEYS, F.array_join(W.key_findings(), "|").alias("findings"), F.size(W.risk_alerts()).alias("n_alerts"),
        F.size(W.positive_aspects()).alias("n_positive"),
    )


def listed(*cases):
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {when} THEN {text!r} END' for when, text in cases)}], lambda x: x IS NOT NULL), '|')"


ALERT_TEXTS = listed(
    ("final_score > 0.7", "⚠️ 高认知负荷预警：当前任务对用户造成较高认知负荷"), ("frustration >= 5", "⚠️ 高挫败感预警：用户在任务中感到明显烦躁"),
    ("back_rate > 0.3", "⚠️ 操作困难预警：频繁回退表明内容可能较难理解"), ("error_rate > 0.15", "⚠️ 错误率高预警：操作错误频繁，需检查界面设计"), ("duration_ms > 300000", "⚠️ 内容过载预警：任务时间过长，建议拆分内容"))
ASPECT_TEXTS = listed(
    ("final_score < 0.4", "✅ 认知负荷处于低水平，任务对用户友好"), ("completion_rate >= 0.9", "✅ 任务完成率高，操作流畅"), ("error_rate < 0.05", "✅ 操作错误少，界面易于理解"),
    ("performance >= 5", "✅ 用户对自身表现满意"), ("frustration <= 2", "✅ 任务过程顺利，用户无明显挫败感"))


@query("cl13_14_texts", f"WITH {FULL} SELECT user_id, task_id, {ALERT_TEXTS} AS alerts, {ASPECT_TEXTS} AS aspects FROM fullrow")
def _(t):
    return full_rows(t).select(*KEYS, F.array_join(W.risk_alerts(), "|").alias("alerts"), F.array_join(W.positive_aspects(), "|").alias("aspects"))


@query("cl15_benchmarks", f"""WITH {ASSESS}, s AS (SELECT *, avg(final_score) OVER (PARTITION BY user_id) AS a, min(final_score) OVER (PARTITION BY user_id) AS best, max(final_score) OVER (PARTITION BY user_id) AS worst FROM assessed)
SELECT user_id, task_id, round(a, 4) AS user_avg, best AS user_best, worst AS user_worst, CAST(least(100, greatest(0, trunc((1 - (final_score - a)) * 50 + 50))) AS INT) AS percentile FROM s""")
def _(t):
    return W.benchmarks(assessments(t)).select(*KEYS, F.round("user_avg", 4).alias("user_avg"), "user_best", "user_worst", "percentile")


@query("cl16_single_reports")
def _(t):
    return W.single_reports(full_rows(t))


MEAN4 = "(2 * sum(CAST(round(final_score * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000"


@query("cl17_task_reports", f"""WITH {ASSESS} SELECT user_id, source AS task_id, count(*) AS assessments, {MEAN4} AS overall_score,
 CASE WHEN avg(final_score) < 0.4 THEN 'low' WHEN avg(final_score) < 0.7 THEN 'medium' ELSE 'high' END AS overall_level,
 round(avg(coalesce(behavior_score, 0)), 10) AS avg_behavior_score, round(avg(coalesce(questionnaire_score, 0)), 10) AS avg_questionnaire_score FROM assessed GROUP BY ALL""")
def _(t):
    rows = assessments(t).drop("task_id").withColumn("task_id", c("source"))
    return W.task_reports(rows).withColumns({n: F.round(n, 10) for n in ("avg_behavior_score", "avg_questionnaire_score")})


STATS = """count(*) AS total, round(avg(final_score), 10) AS avg_score, min(final_score) AS min_score, max(final_score) AS max_score,
 count(*) FILTER (level = 'low') AS n_low, count(*) FILTER (level = 'medium') AS n_medium, count(*) FILTER (level = 'high') AS n_high"""
RECENT = "created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY"


@query("cl18_trend_summary", f"WITH {ASSESS} SELECT user_id, {STATS} FROM assessed WHERE {RECENT} GROUP BY ALL")
def _(t):
    return W.trend_summary(assessments(t), AS_OF, 7).withColumn("avg_score", F.round("avg_score", 10))


@query("cl18_trend_points", f"WITH {ASSESS} SELECT user_id, created_at, CAST(created_at AS DATE) AS date, final_score, level FROM assessed WHERE {RECENT}")
def _(t):
    return W.trend_points(assessments(t), AS_OF, 7)


@query("cl19_user_stats", f"WITH {ASSESS} SELECT user_id, {STATS} FROM assessed GROUP BY ALL")
def _(t):
    return W.user_stats(assessments(t)).withColumn("avg_score", F.round("avg_score", 10))


HALVES = """r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, task_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM src),
h AS (SELECT user_id, avg(final_score) FILTER (p <= n // 2) AS a, avg(final_score) FILTER (p > n // 2) AS b FROM r GROUP BY ALL),
rate AS (SELECT user_id, CASE WHEN a IS NULL OR a = 0 THEN 0.0 ELSE round((b - a) / a, 3) END AS change_rate FROM h)"""


@query("cl20_change_rate", f"WITH {ASSESS}, src AS (SELECT * FROM assessed), {HALVES} SELECT * FROM rate")
def _(t):
    return W.change_rates(assessments(t))


PEAKS = """hours AS (SELECT user_id, hour(created_at) AS hh, count(*) AS n, max(created_at) AS last FROM src WHERE hour(created_at) BETWEEN 6 AND 22 GROUP BY ALL HAVING count(*) >= 2),
peaks AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC) AS INT) AS rank, hh || ':00-' || (hh + 1) || ':00' AS period, n FROM hours QUALIFY rank <= 2)"""


@query("cl21_peak_hours", f"WITH {ASSESS}, src AS (SELECT * FROM assessed), {PEAKS} SELECT * FROM peaks")
def _(t):
    return W.peak_hours(assessments(t))


@query("cl22_trend_reports", f"""WITH {ASSESS}, src AS (SELECT * FROM assessed WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 20 DAY), {HALVES}, {PEAKS},
g AS (SELECT user_id, {STATS} FROM src GROUP BY ALL HAVING count(*) >= 2),
pk AS (SELECT user_id, string_agg(period, ', ' ORDER BY rank) AS peak_times FROM peaks GROUP BY ALL)
SELECT user_id, total, avg_score, change_rate, CASE WHEN change_rate > 0 THEN 'increasing' WHEN change_rate < 0 THEN 'decreasing' ELSE 'stable' END AS trend,
 coalesce(peak_times, '') AS peak_times, (change_rate > 0)::INT + (avg_score > 0.7)::INT AS n_alerts, (change_rate > 0)::INT + (peak_times IS NOT NULL)::INT AS n_suggestions
FROM g JOIN rate USING (user_id) LEFT JOIN pk USING (user_id)""")
def _(t):
    out = W.trend_reports(assessments(t), AS_OF, 20)
    return out.select(
        "user_id", "total", F.round("avg_score", 10).alias("avg_score"), "change_rate", "trend",
        F.coalesce(F.array_join("peak_times", ", "), F.lit("")).alias("peak_times"), F.size("risk_alerts").alias("n_alerts"),
        F.size("suggestions").alias("n_suggestions"),
    )


@query("cl23_period_reports", f"""WITH {ASSESS} SELECT user_id, count(*) AS assessments, {MEAN4} AS overall_score,
 CASE WHEN avg(final_score) < 0.4 THEN 'low' WHEN avg(final_score) < 0.7 THEN 'medium' ELSE 'high' END AS overall_level,
 count(*) FILTER (level = 'low') AS n_low, count(*) FILTER (level = 'medium') AS n_medium, count(*) FILTER (level = 'high') AS n_high FROM assessed WHERE {RECENT} GROUP BY ALL""")
def _(t):
    return W.period_reports(assessments(t), AS_OF, 7)


@query("cl24_history", f"""WITH {ASSESS} SELECT user_id, task_id, created_at, final_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id) AS INT) AS rank
 FROM assessed WHERE source = 'chat' QUALIFY rank BETWEEN 2 AND 6""")
def _(t):
    return W.history(assessments(t), source="chat", limit=5, offset=1).select(*KEYS, "created_at", "final_score", "rank")


@query("src16_export_history", f"""WITH {ASSESS} SELECT user_id, user_id || '/' || task_id AS id, task_id, source, final_score, level, behavior_score, questionnaire_score, eeg_score,
 duration_ms, created_at FROM assessed JOIN (SELECT user_id, task_id, duration_ms FROM bs) USING (user_id, task_id) WHERE {RECENT}""")
def _(t):
    rows = assessments(t).join(features(t).select(*KEYS, "duration_ms"), KEYS)
    rows = rows.withColumn("id", F.concat_ws("/", "user_id", "task_id"))
    return W.export_history(rows, AS_OF, 7)


@query("src16_export_files", f"""WITH {ASSESS}, rows AS (SELECT user_id, user_id || '/' || task_id AS id, task_id, source, final_score, level, behavior_score, questionnaire_score, eeg_score, duration_ms, created_at
 FROM assessed JOIN (SELECT user_id, task_id, duration_ms FROM bs) USING (user_id, task_id) WHERE {RECENT})
SELECT form, user_id, id, final_score, level, questionnaire_score, eeg_score, duration_ms, created_at FROM rows, (VALUES ('csv'), ('json')) AS f(form)""")
def _(t):
    rows = assessments(t).join(features(t).select(*KEYS, "duration_ms"), KEYS)
    exported = W.export_history(rows.withColumn("id", F.concat_ws("/", "user_id", "task_id")), AS_OF, 7)
    out = []
    for form in ("csv", "json"):
        folder = shared_folder(t.spark, f"export-{form}")
        W.write_export(exported, folder, form)
        read = t.spark.read.schema(exported.schema)
        back = read.option("header", True).csv(folder) if form == "csv" else read.json(folder)
        out.append(back.select(F.lit(form).alias("form"), "user_id", "id", "final_score", "level", "questionnaire_score", "eeg_score", "duration_ms", "created_at"))
    return out[0].unionByName(out[1])
