"""Dashboard queries: events as activity, orders as recording sessions and graph catalogue, event props as history."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import dashboards as D
from loomwright.plans.registry import query

c = F.col


def activity(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.withColumn("k", k)
    kind = F.when(c("event_type") == "signup", "task_start").when(c("event_type") == "purchase", "task_end").otherwise(c("event_type"))
    source = F.when(c("k") % 4 == 0, "chat").when(c("k") % 4 == 1, "patient_education").when(c("k") % 4 == 2, "")
    params = F.concat(
        F.lit('{"duration_ms": '), F.floor(c("value") * 10).cast("string"), F.lit(', "duration": '), (c("k") + 1).cast("string"),
        F.when(c("k") % 3 == 0, ', "view_mode": "step"').when(c("k") % 3 == 1, ', "answer_style": "concise"').otherwise(', "concise": true'), F.lit("}"),
    )
    return rows.select(
        c("event_id").alias("pos"), "user_id", F.date_format("ts", "yyyy-MM-dd").alias("task_id"), kind.alias("event_type"),
        source.alias("source"), F.unix_millis("ts").alias("ts"), params.alias("params"), "k", c("ts").alias("happened"),
    )


ACT = """act AS (SELECT event_id AS pos, user_id, strftime(ts, '%Y-%m-%d') AS task_id, CASE event_type WHEN 'signup' THEN 'task_start' WHEN 'purchase' THEN 'task_end' ELSE event_type END AS event_type,
 coalesce(nullif(CASE k % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'patient_education' WHEN 2 THEN '' END, ''), 'unknown') AS source, epoch_us(ts) // 1000 AS ts, floor(value * 10) AS dur, k, ts AS happened
 FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events))"""


def questionnaires(t):
    answers = F.concat(
        F.lit('[{"qid": "q1", "value": '), (c("k") % 7 + 1).cast("string"), F.lit('}, {"qid": "q2", "value": '), (c("k") % 5).cast("string"),
        F.lit('}, {"qid": "q3", "value": "n/a"}]'),
    )
    return activity(t).filter("event_type = 'view'").select("pos", "user_id", "task_id", "source", "ts", answers.alias("answers"))


QUEST = "quest AS (SELECT source, k % 7 + 1 AS v FROM act WHERE event_type = 'view' UNION ALL SELECT source, k % 5 FROM act WHERE event_type = 'view')"


@query("db1_overview", f"""WITH {ACT} SELECT count(*) AS total_events, count(DISTINCT user_id) AS total_users, count(DISTINCT CASE WHEN event_type = 'task_start' THEN task_id END) AS total_tasks,
 count(DISTINCT CAST(happened AS DATE)) AS active_days, count(*) FILTER (event_type = 'view') AS total_questionnaires FROM act""")
def _(t):
    return D.overview(activity(t), questionnaires(t))


@query("db2_by_source", f"WITH {ACT} SELECT source, count(*) AS cnt FROM act GROUP BY ALL")
def _(t):
    return D.events_by_source(activity(t))


@query("db3_by_type", f"WITH {ACT} SELECT event_type, count(*) AS cnt FROM act GROUP BY ALL")
def _(t):
    return D.events_by_type(activity(t))


@query("db4_daily_activity", f"WITH {ACT} SELECT CAST(happened AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM act WHERE happened >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY GROUP BY ALL")
def _(t):
    return D.daily_activity(activity(t), "2024-01-30", 14)


@query("db5_mean_answers", f"WITH {ACT}, {QUEST} SELECT source, round(avg(v), 2) AS avg_score, count(*) AS count FROM quest GROUP BY ALL")
def _(t):
    return D.mean_answers(questionnaires(t))


@query("db6_mean_durations", f"WITH {ACT} SELECT source, CAST(round(avg(dur)) AS BIGINT) AS avg_duration_ms, count(*) AS count FROM act WHERE event_type = 'task_end' AND dur > 0 GROUP BY ALL")
def _(t):
    return D.mean_durations(activity(t))


@query("db7_top_users", f"""WITH {ACT} SELECT user_id, count(*) AS events, count(DISTINCT CASE WHEN event_type = 'task_start' THEN task_id END) AS tasks FROM act GROUP BY ALL
ORDER BY events DESC, user_id LIMIT 10""")
def _(t):
    return D.top_users(activity(t))


@query("db8_duration_buckets", f"""WITH {ACT} SELECT source, CASE WHEN k % 3 = 0 THEN 'step' ELSE 'unknown' END AS view_mode, CASE WHEN k % 3 = 0 THEN 'normal' ELSE 'concise' END AS style,
 count(*) AS n, round(avg(CASE WHEN dur <> 0 THEN dur ELSE k + 1 END), 10) AS avg_ms FROM act WHERE event_type = 'task_end' AND ts >= 1705276800000 GROUP BY ALL""")
def _(t):
    return D.duration_buckets(activity(t), 1705276800000).withColumn("avg_ms", F.round("avg_ms", 10))


@query("db9_mean_answers_rollup", f"WITH {ACT}, {QUEST} SELECT source, round(avg(v), 10) AS avg_score, count(*) AS count FROM quest GROUP BY ROLLUP (source)")
def _(t):
    return D.mean_answers_rollup(questionnaires(t)).withColumn("avg_score", F.round("avg_score", 10))


def subjects(t):
    return t.customer.select(
        c("c_custkey").alias("id"), F.concat(F.lit("S"), c("c_custkey").cast("string")).alias("subject_code"), c("c_name").alias("name"),
        (c("c_nationkey") + 60).alias("age"), F.when(c("c_custkey") % 2 == 0, "male").otherwise("female").alias("gender"),
        F.when(c("c_mktsegment") == "BUILDING", "mci").when(c("c_mktsegment") == "MACHINERY", "other").otherwise("normal").alias("cognitive_status"),
    )


def sessions(t):
    key = c("o_orderkey")
    a, b = (key % 6).cast("string"), (key % 4).cast("string")
    note = F.when(
        key % 2 == 0, F.concat(F.lit('{"baseline": {"m": '), a, F.lit(', "e": '), b, F.lit('}, "post": {"m": '), b, F.lit(', "x": "no"}, "subject_info": {"age": '), a, F.lit("}}"))
    ).otherwise(F.concat(F.lit('{"subject_display_name": "D'), a, F.lit('", "baseline": [{"value": '), a, F.lit('}], "post": [{"value": '), b, F.lit('}, {"value": 2}]}')))
    return t.orders.select(
        key.alias("id"), c("o_custkey").alias("subject_id"), c("o_orderdate").alias("start_time"),
        (F.floor("o_totalprice") % 3600).alias("duration_seconds"), F.round(c("o_totalprice") / 5000, 2).alias("avg_score"),
        F.when(c("o_orderstatus") == "F", "low").when(c("o_orderstatus") == "O", "medium").otherwise("high").alias("cognitive_level"),
        F.when(c("o_orderpriority") == "5-LOW", "aborted").otherwise("completed").alias("status"), note.alias("session_note"),
    )


SES = """sub AS (SELECT c_custkey AS id, 'S' || c_custkey AS subject_code, c_name AS name, c_nationkey + 60 AS age, CASE WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender,
 CASE c_mktsegment WHEN 'BUILDING' THEN '轻度障碍' WHEN 'MACHINERY' THEN 'other' ELSE '正常' END AS cognitive_status FROM customer),
ses AS (SELECT o_orderkey AS id, o_custkey AS subject_id, o_orderdate AS start_time, CAST(floor(o_totalprice) AS BIGINT) % 3600 AS duration_seconds, round(o_totalprice / 5000, 2) AS avg_score,
 CASE o_orderstatus WHEN 'F' THEN 'low' WHEN 'O' THEN 'medium' ELSE 'high' END AS cognitive_level, o_orderpriority <> '5-LOW' AS done FROM orders)"""


@query("db10_session_page", f"""WITH {SES} SELECT s.id, subject_id, start_time, cognitive_level, subject_code, sub.name AS subject_name, (SELECT count(*) FROM ses WHERE start_time >= '1997-01-01') AS total
FROM ses s LEFT JOIN sub ON s.subject_id = sub.id WHERE start_time >= '1997-01-01' ORDER BY start_time DESC, s.id LIMIT 200 OFFSET 200""")
def _(t):
    rows = D.session_page(sessions(t), subjects(t), start="1997-01-01", limit=200, offset=200)
    return rows.select("id", "subject_id", "start_time", "cognitive_level", "subject_code", "subject_name", "total")


@query("db11_subject_page", f"WITH {SES}, f AS (SELECT * FROM sub WHERE contains(subject_code, '12') OR contains(name, '12')) SELECT id, subject_code, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 50")
def _(t):
    return D.subject_page(subjects(t), "12").select("id", "subject_code", "name", "total")


@query("db12_session_summary", f"""WITH {SES} SELECT count(*) AS total_sessions, count(DISTINCT subject_id) AS total_subjects, round(avg(avg_score), 1) AS avg_score,
 round(count(*) FILTER (cognitive_level = 'high') / count(*), 4) AS high_risk_ratio FROM ses""")
def _(t):
    return D.session_summary(sessions(t))


@query("db13_session_breakdowns", f"""WITH {SES}, g AS (
 SELECT 'subject' AS kind, subject_id, NULL AS cognitive_level, NULL::DATE AS day, count(*) AS n, avg(avg_score) AS m, min(avg_score) AS lo, max(avg_score) AS hi, avg(duration_seconds) AS d FROM ses GROUP BY ALL
 UNION ALL SELECT 'level', NULL, cognitive_level, NULL, count(*), avg(avg_score), min(avg_score), max(avg_score), avg(duration_seconds) FROM ses GROUP BY ALL
 UNION ALL SELECT 'date', NULL, NULL, CAST(start_time AS DATE), count(*), avg(avg_score), min(avg_score), max(avg_score), avg(duration_seconds) FROM ses GROUP BY ALL)
SELECT kind, subject_id, cognitive_level, day, n, round(m, 10) AS mean_score, lo AS min_score, hi AS max_score, round(d, 10) AS mean_duration, subject_code FROM g LEFT JOIN sub ON subject_id = sub.id""")
def _(t):
    out = D.session_breakdowns(sessions(t), subjects(t))
    return out.withColumns({n: F.round(n, 10) for n in ("mean_score", "mean_duration")})


@query("db14_experiment_sheet", f"""WITH {SES}, r AS (SELECT *, row_number() OVER (ORDER BY start_time, id) AS number,
 CASE WHEN id % 2 = 0 THEN id % 6 + id % 4 ELSE id % 6 END AS b, CASE WHEN id % 2 = 0 THEN id % 4 ELSE id % 4 + 2 END AS p FROM ses WHERE done)
SELECT number, subject_code AS code, CASE WHEN r.id % 2 = 1 THEN 'D' || (r.id % 6) ELSE name END AS display_name, CASE WHEN r.id % 2 = 0 THEN CAST(r.id % 6 AS VARCHAR) ELSE CAST(age AS VARCHAR) END AS age,
 gender, cognitive_status, nullif(b, 0)::DOUBLE AS baseline_total, nullif(p, 0)::DOUBLE AS post_total, CASE WHEN b <> 0 AND p <> 0 THEN p - b END::DOUBLE AS delta,
 CASE cognitive_level WHEN 'low' THEN '低' WHEN 'medium' THEN '中' ELSE '高' END AS level, CASE WHEN duration_seconds <> 0 THEN CAST(duration_seconds AS VARCHAR) ELSE '' END AS duration,
 strftime(start_time, '%Y-%m-%d %H:%M') AS start FROM r JOIN sub ON r.subject_id = sub.id""")
def _(t):
    return D.experiment_sheet(sessions(t), subjects(t))


def history_records(t):
    k = c("k").cast("string")
    content = (
        F.when(c("k") % 11 == 0, "").when(c("k") % 13 == 0, F.concat(F.lit('{"record_type": "search", "keyword": "w'), k, F.lit('"}')))
        .when(c("event_type") == "view", F.concat(F.lit('{"question": "q'), k, F.lit('"}'))).when(c("event_type") == "click", F.concat(F.lit('{"entity": "e'), k, F.lit('"}')))
        .when(c("event_type") == "error", F.concat(F.lit('{"keyword": "w'), k, F.lit('"}'))).when(c("event_type") == "task_end", F.concat(F.lit('{"filename": "f'), k, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"graphName": "g'), k, F.lit('"}')))
    )
    status = F.when(c("k") % 5 == 0, "pending").when(c("k") % 5 == 1, "completed").when(c("k") % 5 == 2, "failed").when(c("k") % 5 == 3, "")
    return activity(t).select(
        c("pos").alias("history_id"), "user_id", F.when(c("event_type").isin("task_end", "task_start"), "create").otherwise("query").alias("operation_type"),
        content.alias("operation_content"), F.when(c("k") % 2 == 0, F.concat(F.lit("t"), k)).otherwise("").alias("query_text"),
        F.when(c("k") % 3 == 0, "a").alias("answer_text"), status.alias("status"), c("happened").alias("created_at"), "k", "event_type",
    )


HIST = f"""{ACT}, h0 AS (SELECT pos AS history_id, user_id, k, event_type, happened AS created_at, CASE WHEN event_type IN ('task_end', 'task_start') THEN 'create' ELSE 'query' END AS operation_type,
 CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN '' END AS status, k % 11 = 0 AS blank, k % 2 = 0 OR k % 3 = 0 AS texts FROM act),
hist AS (SELECT *, CASE WHEN blank THEN CASE WHEN texts AND operation_type = 'query' THEN 'chat' ELSE '' END WHEN k % 13 = 0 THEN 'search'
 WHEN event_type = 'view' THEN 'chat' WHEN event_type = 'click' THEN 'graph_query' WHEN event_type = 'error' THEN 'search' WHEN event_type = 'task_end' THEN 'upload' ELSE 'graph_build' END AS type FROM h0)"""


@query("db15_history_classes", f"""WITH {HIST} SELECT history_id, type, CASE WHEN status IS NOT NULL AND status NOT IN ('', 'pending') THEN status WHEN type = 'upload' THEN 'pending' ELSE 'completed' END AS shown_status,
 CASE type WHEN 'chat' THEN '聊天: ' || CASE WHEN blank THEN CASE WHEN k % 2 = 0 THEN 't' || k ELSE '未知查询' END ELSE 'q' || k END WHEN 'search' THEN '实体搜索: w' || k
  WHEN 'graph_query' THEN '图谱查询: e' || k WHEN 'graph_build' THEN '图谱构建: g' || k WHEN 'upload' THEN '数据上传: f' || k ELSE '未知记录' END AS title FROM hist""")
def _(t):
    return D.classify_history(history_records(t)).select("history_id", "type", "shown_status", "title")


def graph_catalogue(t):
    status = c("o_orderstatus")
    return t.orders.select(
        c("o_orderkey").cast("string").alias("graph_id"), F.when(status != "P", c("o_custkey").cast("string")).alias("user_id"), c("o_orderpriority").alias("graph_name"),
        (F.floor("o_totalprice") % 1000).alias("entity_count"), (F.floor("o_totalprice") % 700).alias("relation_count"), status.alias("status"),
        c("o_orderdate").alias("created_at"),
    )


CAT = """cat AS (SELECT CAST(o_orderkey AS VARCHAR) AS graph_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS user_id, o_orderpriority AS graph_name,
 CAST(floor(o_totalprice) AS BIGINT) % 1000 AS entity_count, CAST(floor(o_totalprice) AS BIGINT) % 700 AS relation_count, o_orderstatus AS status, o_orderdate AS created_at FROM orders)"""


def sent_records(t):
    k = c("k").cast("string")
    kind = F.when(c("event_type") == "view", "chat").when(c("event_type") == "click", "graph_query").when(c("event_type") == "task_start", "graph_build").when(
        c("event_type") == "task_end", "upload").otherwise("other")
    name = F.when(c("k") % 3 == 0, "2-HIGH").when(c("k") % 3 == 1, "5-LOW").otherwise("nothing")
    content = (
        F.when(kind == "chat", F.concat(F.lit('{"question": "q'), k, F.lit('", "answer": "ans", "entities": [1, {"a": 2}]}')))
        .when(kind == "graph_query", '{"links": [1, 2, 3], "entities": ["x", "y"]}')
        .when(kind == "graph_build", F.concat(F.lit('{"graphName": "'), name, F.lit('", "entities_created": 2, "relations_created": 5}')))
        .otherwise('{"answer": "ans", "entities": ["x", "y"]}')
    )
    return activity(t).select(
        c("pos").alias("history_id"), F.when(c("event_type") == "task_start", F.when(c("k") % 2 == 0, "none").otherwise(k)).alias("graph_id"),
        c("user_id").cast("string").alias("user_id"), kind.alias("type"), F.lit("title").alias("title"), content.alias("content"),
        F.when(c("k") % 4 == 0, 7).otherwise(0).alias("entity_count"), F.lit(0).alias("relation_count"), F.when(c("k") % 5 == 0, "failed").alias("status"),
    )


@query("db16_history_normalize", f"""WITH {ACT}, {CAT}, x AS (SELECT pos, k, CAST(user_id AS VARCHAR) AS user_id, event_type,
 CASE event_type WHEN 'view' THEN 'chat' WHEN 'click' THEN 'graph_query' WHEN 'task_start' THEN 'graph_build' WHEN 'task_end' THEN 'upload' ELSE 'other' END AS type,
 CASE event_type WHEN 'task_start' THEN CASE WHEN k % 2 = 0 THEN 'none' ELSE CAST(k AS VARCHAR) END END AS g, CASE k % 3 WHEN 0 THEN '2-HIGH' WHEN 1 THEN '5-LOW' ELSE 'nothing' END AS name FROM act),
l AS (SELECT x.*, (SELECT max_by(graph_id, (created_at, graph_id)) FROM cat WHERE cat.graph_name = x.name AND (cat.user_id = x.user_id OR cat.user_id IS NULL)) AS latest FROM x)
SELECT pos AS history_id, user_id, CASE WHEN type IN ('upload', 'graph_build') THEN 'create' ELSE 'query' END AS operation_type,
 CASE type WHEN 'chat' THEN 'q' || k WHEN 'graph_query' THEN 'title' WHEN 'graph_build' THEN name WHEN 'upload' THEN 'title' ELSE 'title' END AS query_text,
 CASE WHEN type IN ('chat', 'other') THEN 'ans' ELSE '' END AS answer_text, CASE WHEN type = 'graph_build' AND k % 4 <> 0 THEN 2 WHEN k % 4 = 0 THEN 7 ELSE 2 END AS entity_count,
 CASE type WHEN 'graph_query' THEN 3 WHEN 'graph_build' THEN 5 ELSE 0 END AS relation_count, CASE WHEN k % 5 = 0 THEN 'failed' WHEN type = 'upload' THEN 'pending' ELSE 'completed' END AS status,
 CASE WHEN g IS NULL OR g IN (SELECT graph_id FROM cat) THEN g ELSE coalesce(latest, '{D.DEFAULT_GRAPH_ID}') END AS graph_id FROM l""")
def _(t):
    return D.normalize_history(sent_records(t), graph_catalogue(t)).drop("operation_content")


SENT = """x AS (SELECT pos, k, event_type, CASE event_type WHEN 'view' THEN 'chat' WHEN 'click' THEN 'graph_query' WHEN 'task_start' THEN 'graph_build' WHEN 'task_end' THEN 'upload' ELSE 'other' END AS type,
 CASE k % 3 WHEN 0 THEN '2-HIGH' WHEN 1 THEN '5-LOW' ELSE 'nothing' END AS name FROM act)"""


@query("db16_stored_content", f"""WITH {ACT}, {SENT} SELECT pos AS history_id, type AS record_type, CASE WHEN type = 'chat' THEN 'q' || k END AS question, CASE WHEN type = 'graph_build' THEN name END AS graph_name,
 CASE type WHEN 'chat' THEN '[1,{{"a":2}}]' WHEN 'graph_build' THEN NULL ELSE '["x","y"]' END AS entities, CASE type WHEN 'chat' THEN 4 WHEN 'graph_query' THEN 3 WHEN 'graph_build' THEN 4 ELSE 3 END AS fields FROM x""")
def _(t):
    stored = D.normalize_history(sent_records(t), graph_catalogue(t))
    field = lambda name: F.get_json_object("operation_content", f"$.{name}")
    return stored.select(
        "history_id", field("record_type").alias("record_type"), field("question").alias("question"), field("graphName").alias("graph_name"), field("entities").alias("entities"),
        F.size(F.json_object_keys("operation_content")).alias("fields"))


@query("db16_round_trip", f"""WITH {ACT}, {SENT} SELECT pos AS history_id, type, CASE WHEN k % 5 = 0 THEN 'failed' WHEN type = 'upload' THEN 'pending' ELSE 'completed' END AS shown_status,
 CASE type WHEN 'chat' THEN '聊天: q' || k WHEN 'graph_query' THEN '图谱查询: 知识图谱' WHEN 'graph_build' THEN '图谱构建: ' || name WHEN 'upload' THEN '数据上传: 未知文件' ELSE '未知记录' END AS title FROM x""")
def _(t):
    return D.classify_history(D.normalize_history(sent_records(t), graph_catalogue(t))).select("history_id", "type", "shown_status", "title")


@query("db16_outer_fields", """SELECT o_orderkey AS history_id, CASE WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS entity_count, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 4 ELSE 0 END AS relation_count,
 CASE WHEN o_orderkey % 2 = 0 THEN 'outer' ELSE 'inner' END AS answer_text FROM orders""")
def _(t):
    k = c("o_orderkey")
    content = F.concat(
        F.lit('{"answer": "inner"'), F.when(k % 4 == 1, ', "entities": ["e"]').otherwise(""), F.when(k % 3 == 1, ', "links": "none", "edges": [1, 2, 3, 4]').otherwise(', "edges": [1]'), F.lit("}"))
    kind = F.when(k % 3 == 1, "graph_query").otherwise("other")
    records = t.orders.select(
        k.alias("history_id"), F.lit(None).cast("string").alias("graph_id"), F.lit("u").alias("user_id"), kind.alias("type"), F.lit("title").alias("title"), content.alias("content"),
        F.lit(0).alias("entity_count"), F.lit(0).alias("relation_count"), F.lit(None).cast("string").alias("status"), F.when(k % 2 == 0, "outer").otherwise("").alias("answer_text"),
        F.when(k % 4 == 0, "[1, 2, 3]").alias("entities"), F.when(k % 3 == 0, '[{"a": 1}, {}]').otherwise("no list").alias("relationships"))
    stored = D.normalize_history(records, graph_catalogue(t))
    answer = F.when((k % 3 == 1) & (c("answer_text") == ""), F.when(k % 2 == 0, "outer").otherwise("inner")).otherwise(c("answer_text"))
    return stored.join(t.orders.select(k, k.alias("history_id")), "history_id").select("history_id", c("entity_count").cast("int").alias("entity_count"), c("relation_count").cast("int").alias("relation_count"), answer.alias("answer_text"))


@query("gr27_listing", f"""WITH {CAT}, w AS (SELECT user_id AS u FROM cat WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
a AS (SELECT 'user' AS kind, * FROM cat WHERE user_id IN (SELECT u FROM w) ORDER BY created_at DESC, graph_id LIMIT 100), b AS (SELECT 'default' AS kind, * FROM cat WHERE user_id IS NULL ORDER BY created_at DESC, graph_id LIMIT 50),
d AS (SELECT 'status' AS kind, * FROM cat WHERE status = 'O' ORDER BY created_at DESC, graph_id LIMIT 20 OFFSET 5)
SELECT kind, graph_id, '- ' || graph_id || chr(9) || graph_name || chr(9) || '节点' || entity_count || ' 关系' || relation_count AS line FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d)""")
def _(t):
    from loomwright.operators import graph as G

    rows = graph_catalogue(t)
    busiest = rows.filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()["user_id"]
    lists = [("user", G.list_graphs(rows, user=busiest)), ("default", G.list_graphs(rows, defaults=True, limit=50)), ("status", G.list_graphs(rows, status="O", limit=20, offset=5))]
    parts = [df.select(F.lit(kind).alias("kind"), "graph_id", G.listing_line().alias("line")) for kind, df in lists]
    return parts[0].union(parts[1]).union(parts[2])


@query("db17_history_stats", f"""WITH {HIST} SELECT operation_type, count(*) AS total, count(*) FILTER (status = 'completed') AS success, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-30') AS today FROM hist GROUP BY ROLLUP (operation_type)""")
def _(t):
    return D.history_stats(history_records(t), "2024-01-30")


@query("db18_history_search", "SELECT page_id AS file_id, url AS file_name, created_at FROM (SELECT page_id, url, 20000 - page_id AS created_at FROM pages) WHERE contains(url, '/en/') OR contains(CAST(page_id AS VARCHAR), '/en/')")
def _(t):
    rows = t.pages.select(c("page_id").alias("file_id"), c("url").alias("file_name"), (20000 - c("page_id")).alias("created_at"))
    return D.search_history(rows, keyword="/en/")


@query("db19_home_overview", f"""WITH {HIST}, {CAT}, o AS (SELECT DISTINCT user_id FROM act),
own AS (SELECT user_id, count(*) AS graphs, sum(entity_count) AS entities, sum(relation_count) AS relations FROM cat WHERE user_id IS NOT NULL GROUP BY ALL),
shared AS (SELECT count(*) AS graphs, sum(entity_count) AS entities, sum(relation_count) AS relations FROM cat WHERE user_id IS NULL),
d AS (SELECT doc_id % 100 AS user_id, count(DISTINCT doc_id) AS documents FROM documents GROUP BY ALL),
h AS (SELECT user_id, count(*) FILTER (type = 'chat' AND created_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS answered, count(*) FILTER (type = 'search') AS searches FROM hist GROUP BY ALL)
SELECT o.user_id, coalesce(own.graphs, shared.graphs) AS graphs, coalesce(own.entities, shared.entities)::BIGINT AS entities, coalesce(own.relations, shared.relations)::BIGINT AS relations,
 coalesce(documents, 0) AS documents, coalesce(answered, 0) AS answered, coalesce(searches, 0) AS searches
FROM o LEFT JOIN own ON CAST(o.user_id AS VARCHAR) = own.user_id LEFT JOIN d ON o.user_id = d.user_id LEFT JOIN h ON o.user_id = h.user_id, shared""")
def _(t):
    users = activity(t).select("user_id").distinct()
    chunks = t.documents.select((c("doc_id") % 100).alias("user_id"), "doc_id")
    graphs = graph_catalogue(t).withColumn("user_id", c("user_id").cast("bigint"))
    return D.home_overview(graphs, chunks, D.classify_history(history_records(t)), users, "2024-01-30")


@query("db19_recent_activity", f"WITH {HIST} SELECT user_id, history_id, type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, history_id) AS INT) AS rank FROM hist QUALIFY rank <= 3")
def _(t):
    return D.recent_activity(D.classify_history(history_records(t))).select("user_id", "history_id", "type", "rank")


@query("db20_last_messages", "SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS age FROM conversations QUALIFY age <= 10")
def _(t):
    return D.last_messages(t.conversations)


@query("db21_owner_overview", f"""WITH {CAT}, s AS (SELECT count(*) AS g, sum(entity_count) AS e, sum(relation_count) AS r FROM cat WHERE user_id IS NULL)
SELECT CAST(c_custkey AS VARCHAR) AS user_id, count(graph_id) + any_value(g) AS graphs, (coalesce(sum(entity_count), 0) + any_value(e))::BIGINT AS entities,
 (coalesce(sum(relation_count), 0) + any_value(r))::BIGINT AS relations FROM s, customer LEFT JOIN cat ON cat.user_id = CAST(c_custkey AS VARCHAR) GROUP BY ALL""")
def _(t):
    owners = t.customer.select(c("c_custkey").cast("string").alias("user_id"))
    return D.owner_overview(graph_catalogue(t).na.fill("default", ["user_id"]), owners)


@query("gr27_catalogue_page", f"WITH {CAT} SELECT graph_id, graph_name, created_at, (SELECT count(*) FROM cat WHERE status = 'F') AS total FROM cat WHERE status = 'F' ORDER BY created_at DESC, graph_id LIMIT 50 OFFSET 10")
def _(t):
    from loomwright.operators.ranking import page

    done = graph_catalogue(t).filter("status = 'F'")
    return page(done, [F.desc("created_at"), c("graph_id")], 50, 10).select("graph_id", "graph_name", "created_at", "total")


@query("gr28_latest_by_name", f"WITH {CAT} SELECT user_id, graph_name, max_by(graph_id, (created_at, graph_id)) AS graph_id, max(created_at) AS created_at FROM cat GROUP BY ALL")
def _(t):
    return D.latest_graph_by_name(graph_catalogue(t))
