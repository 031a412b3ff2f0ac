"""EEG and evaluation queries: orders as samples of a recording, line items as gold and predicted sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.operators import eeg as E
from loomwright.operators import evaluation as EV
from loomwright.plans.registry import query
from loomwright.session import tasks_for

c = F.col
LENGTH = 6000
CHANNELS = ["T3", "F7", "F8", "T4", "Cz"]


def samples(t):
    """Consecutive orders are consecutive samples; five channels follow from the order's numbers."""
    values = [f"cast((o_custkey * {7 + i} + o_orderkey * {13 + 2 * i}) % {204 + i} - 102 as double)" for i in range(len(CHANNELS))]
    pairs = ", ".join(f"struct('{n}' as channel, {v} as uv)" for n, v in zip(CHANNELS, values))
    base = t.orders.select(F.expr(f"'rec' || (o_orderkey div {LENGTH})").alias("recording_id"), F.expr(f"o_orderkey % {LENGTH}").alias("sample_idx"), F.expr(f"array({pairs})").alias("p"))
    return base.select("recording_id", "sample_idx", F.inline("p"))


SAMPLES = "samples AS (" + " UNION ALL ".join(
    f"SELECT 'rec' || (o_orderkey // {LENGTH}) AS recording_id, o_orderkey % {LENGTH} AS sample_idx, '{n}' AS channel, ((o_custkey * {7 + i} + o_orderkey * {13 + 2 * i}) % {204 + i} - 102)::DOUBLE AS uv FROM orders"
    for i, n in enumerate(CHANNELS)) + ")"


@query("ee1_channels", f"WITH {SAMPLES} SELECT recording_id, sample_idx, CASE channel WHEN 'T3' THEN 'TP9' WHEN 'F7' THEN 'AF7' WHEN 'F8' THEN 'AF8' ELSE 'TP10' END AS channel, uv FROM samples WHERE channel <> 'Cz'")
def _(t):
    return E.select_channels(samples(t))


PEAKS = "peaks AS (SELECT recording_id, sample_idx, max(abs(uv)) AS peak FROM samples GROUP BY ALL)"


@query("ee2_artifacts", f"WITH {SAMPLES}, {PEAKS} SELECT s.* FROM samples s JOIN peaks USING (recording_id, sample_idx) WHERE peak < 100")
def _(t):
    return E.remove_artifacts(samples(t))


@query("ee2_artifact_share", f"WITH {SAMPLES}, {PEAKS} SELECT recording_id, count(*) FILTER (peak >= 100) AS removed, count(*) AS samples, count(*) FILTER (peak >= 100) / count(*) AS share FROM peaks GROUP BY ALL")
def _(t):
    return E.artifact_share(samples(t))


EPOCHS = f"""ep AS (SELECT s.*, CAST(sample_idx // 1280 AS INT) AS epoch FROM samples s JOIN (SELECT recording_id, max(sample_idx) + 1 AS n FROM samples GROUP BY ALL) USING (recording_id) WHERE sample_idx // 1280 < n // 1280)"""


@query("ee3_epochs", f"WITH {SAMPLES}, {EPOCHS} SELECT recording_id, epoch, count(*) AS n, sum(uv) AS total FROM ep GROUP BY ALL")
def _(t):
    return E.epochs(samples(t), 256, 5.0).groupBy("recording_id", "epoch").agg(F.count("*").alias("n"), F.sum("uv").alias("total"))


def features(t, headset=False):
    chosen = E.select_channels(samples(t))
    return E.spectral_features(E.epochs(E.remove_artifacts(chosen) if headset else chosen, 256, 5.0), 256, headset)


@query("ee4_spectra_file")
def _(t):
    return features(t)


@query("ee4_spectra_headset")
def _(t):
    return features(t, headset=True)


# ratio and power columns straight from the line items, for the scores
RAW = """raw AS (SELECT l_orderkey AS id, l_suppkey AS subject, l_linenumber AS seg, l_quantity AS delta_power, l_discount * 100 AS theta_power, l_tax * 100 + 1 AS alpha_power, l_quantity / 4 AS beta_power, l_linenumber::DOUBLE AS gamma_power,
 l_discount * 40 AS tb, l_tax * 25 AS ta, l_quantity / 20 AS ab FROM lineitem)"""


def rows(t):
    return t.lineitem.select(
        c("l_orderkey").alias("id"), c("l_suppkey").alias("subject"), c("l_linenumber").alias("seg"), c("l_quantity").alias("delta_power"), (c("l_discount") * 100).alias("theta_power"),
        (c("l_tax") * 100 + 1).alias("alpha_power"), (c("l_quantity") / 4).alias("beta_power"), c("l_linenumber").cast("double").alias("gamma_power"),
        (c("l_discount") * 40).alias("theta_beta_ratio"), (c("l_tax") * 25).alias("theta_alpha_ratio"), (c("l_quantity") / 20).alias("alpha_beta_ratio"))


def sql_score(headset):
    ta = "least(coalesce(nullif(ta, 0), 1.0) / 2.5, 1)" if headset else "coalesce(nullif(ta, 0), 1.0) / 2.5"
    return f"least(greatest(0.5 * least(coalesce(nullif(tb, 0), 1.5) / 3, 1) + 0.3 * (1 - least(ab / 2.5, 1)) + 0.2 * {ta}, 0), 1)"


@query("ee5_scores", f"WITH {RAW} SELECT id, seg, subject, round({sql_score(False)}, 8) AS file_score, round({sql_score(True)}, 8) AS headset_score FROM raw")
def _(t):
    both = E.scores(rows(t)).withColumnRenamed("eeg_score", "file_score")
    both = E.scores(both, headset=True)
    return both.select("id", "seg", "subject", F.round("file_score", 8).alias("file_score"), F.round("eeg_score", 8).alias("headset_score"))


def baselines(t):
    means = rows(t).groupBy("subject").agg(*[F.avg(n).alias(n) for n in E.POWERS])
    return means.filter("subject % 3 <> 0")


BASE = "base AS (SELECT subject, avg(delta_power) AS bd, avg(theta_power) AS bt, avg(alpha_power) AS ba, avg(beta_power) AS bb, avg(gamma_power) AS bg FROM raw WHERE subject % 3 <> 0 GROUP BY ALL)"


@query("ee6_scores_with_baseline", f"""WITH {RAW}, {BASE} SELECT id, seg, subject, round(CASE WHEN bt IS NULL THEN {sql_score(False)} ELSE
 1 / (1 + exp(-3 * (0.4 * greatest(0, coalesce(nullif(theta_power, 0), bt) / bt - 1) + 0.3 * greatest(0, 1 - alpha_power / ba) + 0.3 * greatest(0, coalesce(nullif(tb, 0), 1.5) / (bt / bb) - 1) - 0.5))) END, 8) AS eeg_score
FROM raw LEFT JOIN base USING (subject)""")
def _(t):
    scored = E.scores_with_baseline(rows(t), baselines(t), "subject")
    return scored.select("id", "seg", "subject", F.round("eeg_score", 8).alias("eeg_score"))


QUALITY = f"""q AS (SELECT recording_id, channel, count(*) AS n, stddev_pop(uv) AS std, max(abs(uv)) AS m FROM samples GROUP BY ALL),
cq AS (SELECT *, CASE WHEN n < 256 THEN 'unknown' WHEN m > 200 THEN 'poor' WHEN m > 100 THEN 'fair' WHEN std > 20 THEN 'fair' ELSE 'good' END AS quality FROM q)"""


@query("ee7_channel_quality", f"WITH {SAMPLES}, {QUALITY} SELECT recording_id, channel, n, round(std, 2) AS std, round(m, 2) AS max_amplitude, quality FROM cq")
def _(t):
    return E.channel_quality(samples(t))


@query("ee7_signal_quality", f"WITH {SAMPLES}, {QUALITY} SELECT recording_id, CASE WHEN count(*) FILTER (quality = 'poor') >= 2 THEN 'poor' WHEN count(*) FILTER (quality = 'poor') >= 1 OR count(*) FILTER (quality = 'fair') >= 3 THEN 'fair' ELSE 'good' END AS overall FROM cq GROUP BY ALL")
def _(t):
    return E.signal_quality(E.channel_quality(samples(t)))


@query("ee8_session_averages", f"""WITH {RAW}, m AS (SELECT subject, count(*) AS segments, {', '.join(f"round(sum(coalesce({n}, 0)) / count(*), 3) AS {n}" for n in E.POWERS)} FROM (SELECT subject, delta_power, nullif(theta_power, 0) AS theta_power, alpha_power, beta_power, gamma_power FROM raw) GROUP BY ALL)
SELECT *, round(theta_power / beta_power, 3) AS theta_beta_ratio, round(theta_power / alpha_power, 3) AS theta_alpha_ratio, round(alpha_power / beta_power, 3) AS alpha_beta_ratio FROM m""")
def _(t):
    withheld = rows(t).withColumn("theta_power", F.nullif(c("theta_power"), F.lit(0.0)))
    return E.session_averages(withheld, ["subject"])


@query("ee9_subject_scores", f"WITH {RAW}, s AS (SELECT subject, {sql_score(False)} AS s FROM raw) SELECT subject, count(*) AS epochs, round(avg(s), 8) AS mean_score, round(stddev_pop(s), 8) AS std_score FROM s GROUP BY ALL")
def _(t):
    out = E.subject_scores(E.scores(rows(t)), "subject")
    return out.withColumns({n: F.round(n, 8) for n in ("mean_score", "std_score")})


@query("ee10_resample", f"""WITH {SAMPLES}, s AS (SELECT * FROM samples WHERE channel IN ('T3', 'Cz')), n AS (SELECT recording_id, channel, max(sample_idx) AS m FROM s GROUP BY ALL),
j AS (SELECT recording_id, channel, m, unnest(range(0, CAST(floor(m / 1.953125) AS BIGINT) + 1)) AS j FROM n)
SELECT j.recording_id, j.channel, j AS sample_idx, a.uv + (j * 1.953125 - floor(j * 1.953125)) * (coalesce(b.uv, a.uv) - a.uv) AS uv
FROM j JOIN s a ON a.recording_id = j.recording_id AND a.channel = j.channel AND a.sample_idx = floor(j * 1.953125) LEFT JOIN s b ON b.recording_id = j.recording_id AND b.channel = j.channel AND b.sample_idx = floor(j * 1.953125) + 1""")
def _(t):
    return E.resample(samples(t).filter("channel in ('T3', 'Cz')"), 500.0)


@query("ee10_resample_channels", f"""WITH {SAMPLES}, n AS (SELECT recording_id, channel, max(sample_idx) AS m FROM samples GROUP BY ALL),
j AS (SELECT recording_id, channel, m, unnest(range(0, CAST(floor(m / 1.953125) AS BIGINT) + 1)) AS j FROM n)
SELECT j.recording_id, j.channel, j AS sample_idx, a.uv + (j * 1.953125 - floor(j * 1.953125)) * (coalesce(b.uv, a.uv) - a.uv) AS uv
FROM j JOIN samples a ON a.recording_id = j.recording_id AND a.channel = j.channel AND a.sample_idx = floor(j * 1.953125) LEFT JOIN samples b ON b.recording_id = j.recording_id AND b.channel = j.channel AND b.sample_idx = floor(j * 1.953125) + 1""")
def _(t):
    return E.resample(samples(t), 500.0)


@query("ee11_relative_powers", f"WITH {RAW}, {BASE} SELECT id, seg, subject, round(CASE WHEN bt IS NULL OR bt = 0 THEN theta_power ELSE theta_power / bt END, 8) AS theta_power, round(CASE WHEN bg IS NULL OR bg = 0 THEN gamma_power ELSE gamma_power / bg END, 8) AS gamma_power FROM raw LEFT JOIN base USING (subject)")
def _(t):
    out = E.relative_powers(rows(t), baselines(t), "subject")
    return out.select("id", "seg", "subject", F.round("theta_power", 8).alias("theta_power"), F.round("gamma_power", 8).alias("gamma_power"))


# --- evaluation ----------------------------------------------------------------------------------------------------

def item_rows(t):
    kind = F.when(c("p_type") == "ECONOMY", "Disease").when(c("p_type") == "SMALL", "Symptom").when(c("p_type") == "PROMO", "Prognosis").otherwise("Other")
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        c("l_orderkey").alias("sample_id"), "l_linenumber", "l_returnflag", "l_linestatus", "l_tax", c("p_name").alias("name"), kind.alias("type"))


LI = """li AS (SELECT l_orderkey AS sample_id, l_returnflag, l_linestatus, l_tax, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'DISEASE' WHEN 'SMALL' THEN 'SYMPTOM' WHEN 'PROMO' THEN 'PROGNOSIS' ELSE 'OTHER' END AS type
 FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT DISTINCT sample_id, name, type FROM li WHERE l_returnflag <> 'R'), p AS (SELECT DISTINCT sample_id, name, CASE WHEN l_tax > 0.06 THEN 'DISEASE' ELSE type END AS type FROM li WHERE l_linestatus = 'F'),
cells AS (SELECT coalesce(g.type, p.type) AS type, g.name IS NOT NULL AS ing, p.name IS NOT NULL AS inp FROM g FULL JOIN p USING (sample_id, name, type))"""
PRF = """SELECT type, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS recall,
 CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 10) ELSE 0 END::DOUBLE AS f1 FROM n"""
COUNTS = "SELECT type, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing AND inp) AS fp, count(*) FILTER (ing AND NOT inp) AS fn"


def sets(t):
    rows_ = item_rows(t).repartition(tasks_for(t.lineitem), "sample_id")  # both sides are made distinct and counted where they lie
    gold = EV.predicted_entities(rows_.filter("l_returnflag <> 'R'"))
    kind = F.when(c("l_tax") > 0.06, "disease").otherwise(c("type"))
    wide = F.translate("name", "abc", "ａｂｃ")
    return gold, EV.predicted_entities(rows_.filter("l_linestatus = 'F'").withColumn("type", kind).withColumn("name", wide))


@query("ev1_2_entity_scores", f"WITH {LI}, n AS ({COUNTS} FROM cells GROUP BY ROLLUP (type)) {PRF}")
def _(t):
    return EV.score_sets(*sets(t)).withColumn("f1", F.round("f1", 10))


@query("ev3_core_scores", f"WITH {LI}, n AS ({COUNTS} FROM cells WHERE type IN ({', '.join(repr(x) for x in V.CORE_ENTITY_TYPES)}) GROUP BY ROLLUP (type)) {PRF}")
def _(t):
    return EV.score_sets(*sets(t), types=V.CORE_ENTITY_TYPES).withColumn("f1", F.round("f1", 10))


def gold_samples(t):
    """Orders as nested samples: lines are entities, each linked to the first line."""
    lines = item_rows(t).groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "name", "type"))).alias("ls"))
    entities = F.transform("ls", lambda x, i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("id"), x["name"].alias("text"), x["type"].alias("type")))
    relations = F.transform("ls", lambda x, i: F.struct(F.lit("e0").alias("subject"), F.concat(F.lit("e"), (i + 1).cast("string")).alias("object"), F.lit("has_symptom").alias("type")))
    return lines.select(c("sample_id").alias("id"), entities.alias("entities"), relations.alias("relations"))


@query("ev4_gold_relations", """WITH l AS (SELECT DISTINCT l_orderkey AS sample_id, l_linenumber, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'Disease' WHEN 'SMALL' THEN 'Symptom' WHEN 'PROMO' THEN 'Prognosis' ELSE 'Other' END AS type FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY l_linenumber, name, type) AS i FROM l)
SELECT DISTINCT a.sample_id, a.name AS subject, 'HAS_SYMPTOM' AS type, b.name AS object FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.i = 1 AND b.i > 1""")
def _(t):
    return EV.gold_relations(gold_samples(t))


@query("ev4_gold_entities", "SELECT DISTINCT l_orderkey AS sample_id, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'DISEASE' WHEN 'SMALL' THEN 'SYMPTOM' WHEN 'PROMO' THEN 'PROGNOSIS' ELSE 'OTHER' END AS type FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    return EV.gold_entities(gold_samples(t))


def predicted_links(t):
    """Every third link of an order with a wrong type, every fifth with a wrong end, all with wide letters in the names."""
    links = gold_samples(t).select(c("id").alias("sample_id"), F.posexplode("entities").alias("i", "e"), c("entities")[0]["text"].alias("first")).filter("i > 0")
    end = F.when(c("i") % 5 == 0, F.concat(c("e.text"), F.lit(" x"))).otherwise(F.translate(c("e.text"), "abc", "ａｂｃ"))
    kind = F.when(c("i") % 3 == 0, "treated_by").otherwise("Has_Symptom")
    return links.select("sample_id", c("first").alias("subject"), kind.alias("predicate"), end.alias("object"))


@query("ev1_relation_scores", f"""WITH l AS (SELECT DISTINCT l_orderkey AS sample_id, l_linenumber, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'Disease' WHEN 'SMALL' THEN 'Symptom' WHEN 'PROMO' THEN 'Prognosis' ELSE 'Other' END AS type FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY l_linenumber, name, type) - 1 AS i FROM l),
g AS (SELECT DISTINCT a.sample_id, a.name AS s, 'HAS_SYMPTOM' AS type, b.name AS o FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.i = 0 AND b.i > 0),
p AS (SELECT DISTINCT a.sample_id, a.name AS s, CASE WHEN b.i % 3 = 0 THEN 'TREATED_BY' ELSE 'HAS_SYMPTOM' END AS type, CASE WHEN b.i % 5 = 0 THEN b.name || ' x' ELSE b.name END AS o FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.i = 0 AND b.i > 0),
cells AS (SELECT coalesce(g.type, p.type) AS type, g.s IS NOT NULL AS ing, p.s IS NOT NULL AS inp FROM g FULL JOIN p USING (sample_id, s, type, o)), n AS ({COUNTS} FROM cells GROUP BY ROLLUP (type)) {PRF}""")
def _(t):
    return EV.score_sets(EV.gold_relations(gold_samples(t)), EV.predicted_relations(predicted_links(t))).withColumn("f1", F.round("f1", 10))


CATEGORIES = list(V.QA_KEYWORDS)


def answers(t):
    """Events as answers: the category and the keywords mentioned follow from the event number."""
    from loomwright.functions import text as T

    category = F.element_at(T.literals(CATEGORIES), (c("event_id") % len(CATEGORIES) + 1).cast("int"))
    words = F.create_map(*[x for name, keys in V.QA_KEYWORDS.items() for x in (F.lit(name), T.literals(keys))])
    listed = t.events.withColumn("category", category).withColumn("_w", F.element_at(words, c("category")))
    said = F.array_join(F.slice("_w", F.lit(1), (c("user_id") % 3).cast("int")), "和")
    answer = F.when(c("user_id") % 11 == 0, F.concat(said, F.lit("，请咨询专业医生"))).when(c("user_id") % 7 == 0, " ").otherwise(F.concat(F.lit("包括"), said))
    return listed.select("event_id", "category", c("event_type").alias("system"), answer.alias("answer"))


# the third keyword of a list never contains an earlier one, so the number said is the number hit
ANS = f"""ans AS (SELECT event_id, event_type AS system, {CATEGORIES!r}[event_id % {len(CATEGORIES)} + 1] AS category, CASE WHEN user_id % 11 = 0 OR user_id % 7 = 0 THEN 0.0 ELSE [0.0, 0.5, 1.0][user_id % 3 + 1] END::DOUBLE AS score FROM events)"""


@query("ev5_answer_scores", f"WITH {ANS} SELECT event_id, category, system, score FROM ans")
def _(t):
    return answers(t).select("event_id", "category", "system", EV.answer_score(c("answer"), c("category")).alias("score"))


@query("ev6_score_means", f"""WITH {ANS}, kept AS (SELECT * FROM ans WHERE NOT (category = 'cause' AND system = 'click'))
SELECT NULL AS category, system, round(avg(score), 10) AS avg, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT category, system, round(coalesce(avg(score), 0), 10), count(score) FROM (SELECT DISTINCT a.category, b.system FROM kept a, kept b) LEFT JOIN kept USING (category, system) GROUP BY ALL""")
def _(t):
    scored = answers(t).filter("not (category = 'cause' and system = 'click')").withColumn("score", EV.answer_score(c("answer"), c("category")))
    return EV.score_means(scored).withColumn("avg", F.round("avg", 10))
