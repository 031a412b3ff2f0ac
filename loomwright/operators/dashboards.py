"""Dashboards over events, questionnaires, sessions, graphs and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.ranking import first_n, page, range_positions

c = F.col


def source_name() -> Column:
    return F.coalesce(F.nullif(c("source"), F.lit("")), F.lit("unknown"))


def started_task() -> Column:
    return F.when(c("event_type") == "task_start", c("task_id"))


def overview(events: DataFrame, questionnaires: DataFrame) -> DataFrame:
    """Totals in one row; ``ts`` is epoch milliseconds."""
    n_questionnaires = questionnaires.select(F.count("*")).scalar()
    return events.agg(
        F.count("*").alias("total_events"), F.count_distinct("user_id").alias("total_users"),
        F.count_distinct(started_task()).alias("total_tasks"),
        F.count_distinct(F.to_date(F.timestamp_millis("ts"))).alias("active_days"),
    ).withColumn("total_questionnaires", n_questionnaires)


def events_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy(source_name().alias("source")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "source")


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "event_type")


def daily_activity(events: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    start = F.unix_millis(F.lit(as_of).cast("date").cast("timestamp")) - days * 86_400_000
    day = F.to_date(F.timestamp_millis("ts")).alias("day")
    recent = events.filter(c("ts") >= start)
    return recent.groupBy(day).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users")).orderBy("day")


def _answers(questionnaires: DataFrame) -> DataFrame:
    parsed = F.from_json("answers", "array<struct<qid: string, value: string>>")
    return questionnaires.select(source_name().alias("source"), F.explode(parsed).alias("a")).select(
        "source", c("a.value").try_cast("double").alias("value")
    )


def mean_answers(questionnaires: DataFrame) -> DataFrame:
    """Mean numeric answer and their number per source."""
    numeric = _answers(questionnaires).filter("value is not null")
    return numeric.groupBy("source").agg(F.round(F.avg("value"), 2).alias("avg_score"), F.count("*").alias("count"))


def mean_answers_rollup(questionnaires: DataFrame) -> DataFrame:
    """Per source and overall (``source`` null) in one pass."""
    numeric = _answers(questionnaires).filter("value is not null")
    return numeric.rollup("source").agg(F.avg("value").alias("avg_score"), F.count("*").alias("count"))


def _param(name: str) -> Column:
    return F.get_json_object("params", f"$.{name}")


def mean_durations(events: DataFrame) -> DataFrame:
    duration = _param("duration_ms").try_cast("double")
    ended = events.filter(c("event_type") == "task_end").withColumn("_d", duration).filter(c("_d") > 0)
    return ended.groupBy(source_name().alias("source")).agg(
        F.rint(F.avg("_d")).cast("bigint").alias("avg_duration_ms"), F.count("*").alias("count")
    )


def top_users(events: DataFrame, n: int = 10) -> DataFrame:
    counted = events.groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct(started_task()).alias("tasks"))
    return counted.orderBy(F.desc("events"), "user_id").limit(n)


def duration_buckets(events: DataFrame, since_ms: int) -> DataFrame:
    """Mean task duration by source, view mode and answer style since a point in time."""
    ended = events.filter((c("event_type") == "task_end") & (c("ts") >= since_ms))

    def present(name: str) -> Column:
        return F.coalesce(_param(name), F.lit("")).isin("", "0", "false", "null", "0.0") == False  # noqa: E712

    duration = F.when(present("duration_ms"), _param("duration_ms")).when(present("duration"), _param("duration"))
    concise = (F.coalesce(_param("answer_style"), F.lit("")) == "concise") | present("concise")
    rows = ended.select(
        F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("source"),
        F.coalesce(F.nullif(_param("view_mode"), F.lit("")), F.lit("unknown")).alias("view_mode"),
        F.when(concise, "concise").otherwise("normal").alias("style"), duration.try_cast("double").alias("_d"),
    ).filter(c("_d") > 0)
    return rows.groupBy("source", "view_mode", "style").agg(F.count("*").alias("n"), F.avg("_d").alias("avg_ms"))


# --- recording sessions --------------------------------------------------------------------------------------------


def session_page(sessions: DataFrame, subjects: DataFrame, start: str | None = None, end: str | None = None,
                 limit: int = 200, offset: int = 0) -> DataFrame:
    """Newest sessions first with their subject; ``total`` counts the rows of all pages."""
    rows = sessions
    if start:
        rows = rows.filter(c("start_time") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.filter(c("start_time") <= F.lit(end).cast("timestamp"))
    chosen = page(rows, [F.desc("start_time"), c("id")], limit, offset)
    names = subjects.select(c("id").alias("subject_id"), "subject_code", c("name").alias("subject_name"))
    return chosen.join(names, "subject_id", "left")


def subject_page(subjects: DataFrame, keyword: str, limit: int = 50, offset: int = 0) -> DataFrame:
    found = subjects.filter(c("subject_code").contains(keyword) | c("name").contains(keyword))
    return page(found, [c("id")], limit, offset)


def session_summary(sessions: DataFrame) -> DataFrame:
    high = F.count_if(c("cognitive_level") == "high")
    return sessions.agg(
        F.count("*").alias("total_sessions"), F.count_distinct("subject_id").alias("total_subjects"),
        F.coalesce(F.round(F.avg("avg_score"), 1), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.round(F.try_divide(high, F.count("*")), 4), F.lit(0.0)).alias("high_risk_ratio"),
    )


def session_breakdowns(sessions: DataFrame, subjects: DataFrame) -> DataFrame:
    """By subject, by level and by day in one grouping-sets pass; ``kind`` names the breakdown."""
    rows = sessions.select(
        "subject_id", "cognitive_level", F.to_date("start_time").alias("day"), "avg_score", "duration_seconds"
    )
    sets = [[c("subject_id")], [c("cognitive_level")], [c("day")]]
    grouped = rows.groupingSets(sets, c("subject_id"), c("cognitive_level"), c("day")).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg("avg_score").alias("mean_score"),
        F.min("avg_score").alias("min_score"), F.max("avg_score").alias("max_score"), F.avg("duration_seconds").alias("mean_duration"),
    )
    kind = F.when(c("_g") == 3, "subject").when(c("_g") == 5, "level").otherwise("date")
    named = grouped.withColumn("kind", kind).filter("kind <> 'level' or cognitive_level is not null")
    codes = subjects.select(c("id").alias("subject_id"), "subject_code")
    return named.drop("_g").join(codes, "subject_id", "left")


def _answer_total(note: str, field: str) -> Column:
    """Sum of the numbers in ``$.field``, given as an object of numbers or a list of {value}."""
    raw = F.get_json_object(note, f"$.{field}")
    as_object = F.map_values(F.from_json(raw, "map<string, string>"))
    as_list = F.transform(F.from_json(raw, "array<struct<value: string>>"), lambda x: x["value"])
    values = F.when(raw.startswith("["), as_list).otherwise(as_object)
    numbers = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0)))
    return F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)


# Labels of the experiment sheet.
GENDERS = {"male": "男", "female": "女"}
STATUSES = {"normal": "正常", "mci": "轻度障碍", "dementia": "中重度障碍"}
LEVELS = {"low": "低", "medium": "中", "high": "高"}


def _label(name: str, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(T.mapping(table), F.coalesce(c(name), F.lit(""))), c(name), F.lit(""))


def experiment_sheet(sessions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Completed sessions in time order with a running number, questionnaire totals and their difference."""
    people = subjects.select(c("id").alias("subject_id"), "subject_code", "name", "age", "gender", "cognitive_status")
    done = range_positions(sessions.filter(c("status") == "completed"), [], [c("start_time"), c("id")])
    rows = done.join(people, "subject_id", "left")
    before, after = _answer_total("session_note", "baseline"), _answer_total("session_note", "post")
    display = F.nullif(F.get_json_object("session_note", "$.subject_display_name"), F.lit(""))
    return rows.select(
        c("position").alias("number"), F.coalesce("subject_code", F.lit("")).alias("code"), F.coalesce(display, c("name"), F.lit("")).alias("display_name"),
        F.coalesce(F.get_json_object("session_note", "$.subject_info.age"), c("age").cast("string"), F.lit("")).alias("age"),
        _label("gender", GENDERS).alias("gender"), _label("cognitive_status", STATUSES).alias("cognitive_status"),
        F.when(before != 0, before).alias("baseline_total"), F.when(after != 0, after).alias("post_total"),
        F.when((before != 0) & (after != 0), after - before).alias("delta"), _label("cognitive_level", LEVELS).alias("level"),
        F.when(c("duration_seconds") != 0, c("duration_seconds").cast("string")).otherwise("").alias("duration"),
        F.date_format("start_time", "yyyy-MM-dd HH:mm").alias("start"),
    )


# --- history -------------------------------------------------------------------------------------------------------


def classify_history(records: DataFrame) -> DataFrame:
    """Record type, status and title of stored operations, from their JSON content."""
    keys = F.json_object_keys("operation_content")
    empty = keys.isNull() | (F.size(keys) == 0)
    query_text, answer_text = F.coalesce("query_text", F.lit("")), F.coalesce("answer_text", F.lit(""))
    rebuilt = empty & ((query_text != "") | (answer_text != ""))
    names = F.when(rebuilt, F.array(F.lit("question"))).otherwise(F.coalesce(keys, F.array().cast("array<string>")))
    rows = records.withColumn("_keys", names)

    def has(*wanted: str) -> Column:
        return F.arrays_overlap("_keys", F.array(*[F.lit(w) for w in wanted]))

    def value(name: str, default: Column | str) -> Column:
        stored = F.coalesce(F.get_json_object("operation_content", f"$.{name}"), F.lit("None"))
        return F.when(has(name), stored).otherwise(default if isinstance(default, Column) else F.lit(default))

    question = F.when(rebuilt, F.when(query_text != "", query_text).otherwise("未知查询")).otherwise(value("question", "新对话"))
    op = c("operation_type")
    kind = (
        F.when(has("record_type"), F.coalesce(F.get_json_object("operation_content", "$.record_type"), F.lit("")))
        .when((op == "query") & has("entity"), "graph_query").when((op == "query") & has("question"), "chat")
        .when((op == "query") & has("query", "keyword", "searchType"), "search")
        .when((op == "query") & has("graphId", "graphName"), "graph_build")
        .when((op == "create") & has("filename"), "upload").when((op == "create") & has("graphId", "graphName"), "graph_build").otherwise("")
    )
    status = F.coalesce("status", F.lit(""))
    shown = F.when(~status.isin("", "pending"), status).when(c("type") == "upload", "pending").otherwise("completed")
    title = (
        F.when(c("type") == "chat", F.concat(F.lit("聊天: "), question))
        .when(c("type") == "search", F.concat(F.lit("实体搜索: "), value("query", value("keyword", "搜索"))))
        .when(c("type") == "graph_query", F.concat(F.lit("图谱查询: "), value("entity", "知识图谱")))
        .when(c("type") == "graph_build", F.concat(F.lit("图谱构建: "), value("graphName", value("graphId", "新图谱"))))
        .when(c("type") == "upload", F.concat(F.lit("数据上传: "), value("filename", "未知文件"))).otherwise("未知记录")
    )
    return rows.withColumn("type", kind).withColumn("title", title).withColumn("shown_status", shown).drop("_keys")


DEFAULT_GRAPH_ID = "00000000-0000-0000-0000-000000000001"


def latest_graph_by_name(graphs: DataFrame) -> DataFrame:
    """Newest graph per (owner, name); an ownerless graph has the owner null."""
    newest = F.max_by("graph_id", F.struct("created_at", "graph_id")).alias("graph_id")
    return graphs.groupBy("user_id", "graph_name").agg(newest, F.max("created_at").alias("created_at"))


def _with_record_type(content: Column, kind: Column) -> Column:
    """The content object as JSON with ``record_type`` set; anything but an object counts as an empty one."""
    fields = F.coalesce(F.from_json(content, "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    own = F.create_map(F.lit("record_type"), F.parse_json(F.to_json(F.struct(kind.alias("v")))))
    typed = F.transform_values(own, lambda _, v: F.variant_get(v, "$.v", "variant"))
    return F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != "record_type"), typed))


def normalize_history(records: DataFrame, graphs: DataFrame, default_graph: str = DEFAULT_GRAPH_ID) -> DataFrame:
    """Records as sent by clients (type, title, content JSON, counts) to the stored form.

    ``entities`` and ``relationships`` (JSON lists) and ``answer_text`` beside the content count where the records have them.
    """
    def content(name: str) -> Column:
        return F.nullif(F.get_json_object("content", f"$.{name}"), F.lit(""))

    def length(name: str) -> Column:
        raw = F.get_json_object("content", f"$.{name}")
        return F.when(raw.startswith("["), F.json_array_length(raw)).otherwise(0)

    kind = F.coalesce("type", F.lit(""))
    operation = F.when(kind.isin("upload", "graph_build"), "create").otherwise("query")
    title = F.nullif(c("title"), F.lit(""))
    query_text = (
        F.when(kind == "chat", F.coalesce(content("question"), title, F.lit("未知查询")))
        .when(kind.isin("graph", "graph_query"), F.coalesce(content("entity"), title, F.lit("未知查询")))
        .when(kind == "graph_build", F.coalesce(content("graphName"), content("graphId"), title, F.lit("新图谱")))
        .when(kind == "upload", F.coalesce(content("filename"), title, F.lit("未知文件")))
        .otherwise(F.coalesce(title, content("query"), F.lit("未知查询")))
    )
    answer = F.when(kind.isin("graph", "graph_query", "graph_build", "upload"), "").when(kind == "chat", F.coalesce(content("answer"), F.lit(""))).otherwise(
        F.coalesce(F.nullif(c("answer_text"), F.lit("")) if "answer_text" in records.columns else F.lit(None).cast("string"), content("answer"), F.lit("")))

    def first_positive(*options: Column) -> Column:
        return F.coalesce(*[F.when(o > 0, o) for o in options], F.lit(0))

    def created(name: str) -> Column:
        return F.when(kind == "graph_build", F.coalesce(content(name).try_cast("int"), F.lit(0))).otherwise(0)

    outer = lambda name: F.coalesce(F.json_array_length(name), F.lit(0)) if name in records.columns else F.lit(0)
    link_list = F.get_json_object("content", "$.links")
    # edges count only where links is there and no list
    links = F.when(kind.isin("graph", "graph_query"), F.when(link_list.isNull() | link_list.startswith("["), length("links")).otherwise(length("edges"))).otherwise(0)
    rows = records.select(
        "history_id", F.coalesce(F.nullif(c("graph_id"), F.lit("")), content("graphId")).alias("_graph"),
        F.coalesce(F.nullif(c("user_id"), F.lit("")), content("userId"), F.lit("default_user")).alias("user_id"),
        operation.alias("operation_type"), query_text.alias("query_text"), answer.alias("answer_text"),
        first_positive(F.coalesce("entity_count", F.lit(0)), outer("entities"), length("entities"), created("entities_created")).alias("entity_count"),
        first_positive(F.coalesce("relation_count", F.lit(0)), outer("relationships"), length("relationships"), links, created("relations_created")).alias("relation_count"),
        F.coalesce("status", F.when(kind == "upload", "pending").otherwise("completed")).alias("status"),
        F.coalesce(content("graphName"), content("graphId"), F.lit("")).alias("_name"), _with_record_type(c("content"), kind).alias("operation_content"),
    )
    known = graphs.select(c("graph_id").alias("_graph")).distinct().withColumn("_known", F.lit(True))
    latest = latest_graph_by_name(graphs)
    own = latest.filter("user_id is not null").select("user_id", c("graph_name").alias("_name"), c("graph_id").alias("_own"), c("created_at").alias("_own_at"))
    shared = latest.filter("user_id is null").select(c("graph_name").alias("_name"), c("graph_id").alias("_shared"), c("created_at").alias("_shared_at"))
    joined = rows.join(known, "_graph", "left").join(own, ["user_id", "_name"], "left").join(shared, "_name", "left")
    later = F.struct("_shared_at", "_shared") > F.struct("_own_at", "_own")
    newest = F.when(c("_own").isNull() | (c("_shared").isNotNull() & later), c("_shared")).otherwise(c("_own"))
    unknown = c("_graph").isNotNull() & c("_known").isNull() & (c("operation_type") == "create")
    resolved = F.when(unknown, F.coalesce(newest, F.lit(default_graph))).otherwise(c("_graph"))
    return joined.withColumn("graph_id", resolved).drop("_graph", "_known", "_name", "_own", "_own_at", "_shared", "_shared_at")


def history_stats(records: DataFrame, today: str) -> DataFrame:
    """Totals (``operation_type`` null) and counts per type in one pass."""
    status = c("status")
    return records.rollup("operation_type").agg(
        F.count("*").alias("total"), F.count_if(status.isin("completed", "success")).alias("success"),
        F.count_if(status.isin("failed", "error")).alias("failed"), F.count_if(status.isin("pending", "processing")).alias("pending"),
        F.count_if(F.to_date("created_at") == F.lit(today).cast("date")).alias("today"),
    )


def search_history(records: DataFrame, keyword: str | None = None, kind: str | None = None, status: str | None = None) -> DataFrame:
    rows = records
    if keyword:
        rows = rows.filter(c("file_name").contains(keyword) | c("file_id").contains(keyword))
    if kind:
        rows = rows.filter(c("file_type") == kind)
    if status:
        rows = rows.filter(c("status") == status)
    return rows.orderBy(F.desc("created_at"), "file_id")


def graph_totals(graphs: DataFrame, owners: DataFrame) -> DataFrame:
    """Graphs, entities and relations per owner; owners without a graph get the totals of the ownerless graphs."""
    sums = [F.count("*").alias("graphs"), F.sum("entity_count").alias("entities"), F.sum("relation_count").alias("relations")]
    own = graphs.filter("user_id is not null").groupBy("user_id").agg(*sums)
    shared = graphs.filter("user_id is null").agg(*sums)
    joined = owners.select("user_id").distinct().join(own, "user_id", "left")
    return joined.select("user_id", *[
        F.coalesce(c(n), F.when(c("graphs").isNull(), shared.select(n).scalar()), F.lit(0)).alias(n) for n in ("graphs", "entities", "relations")
    ])


def home_overview(graphs: DataFrame, chunks: DataFrame, records: DataFrame, owners: DataFrame, as_of: str) -> DataFrame:
    """Front-page numbers of every owner: graphs, documents, answers of the last week, searches."""
    documents = chunks.groupBy("user_id").agg(F.count_distinct("doc_id").alias("documents"))
    recent = c("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("interval 7 days")
    activity = records.groupBy("user_id").agg(
        F.count_if((c("type") == "chat") & recent).alias("answered"), F.count_if(c("type") == "search").alias("searches")
    )
    out = graph_totals(graphs, owners).join(documents, "user_id", "left").join(activity, "user_id", "left")
    return out.na.fill(0, ["documents", "answered", "searches"])


def recent_activity(records: DataFrame, n: int = 3) -> DataFrame:
    return first_n(records, ["user_id"], [F.desc("created_at"), c("history_id")], n)


def owner_overview(graphs: DataFrame, owners: DataFrame | None = None, default_owner: str = "default") -> DataFrame:
    """Per owner: its own graphs plus those of the default owner, counted without repeating the default ones per row.

    With ``owners(user_id)`` every one of them gets a row; one without own graphs has the totals of the default owner.
    """
    names = ("graphs", "entities", "relations")
    sums = [F.count("*").alias("graphs"), F.sum("entity_count").alias("entities"), F.sum("relation_count").alias("relations")]
    shared = graphs.filter(c("user_id") == default_owner).agg(*sums)
    own = graphs.filter(c("user_id") != default_owner).groupBy("user_id").agg(*sums)
    if owners is not None:
        own = owners.select("user_id").filter(c("user_id") != default_owner).distinct().join(own, "user_id", "left")
    return own.select("user_id", *[(F.coalesce(n, F.lit(0)) + F.coalesce(shared.select(n).scalar(), F.lit(0))).alias(n) for n in names])


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of every conversation, numbered from the newest."""
    return first_n(messages, ["conv_id"], [F.desc("turn")], n, name="age")
