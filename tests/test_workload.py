"""Known results of the behaviour, questionnaire, fusion and EEG scores."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import scoring as S
from loomwright.operators import eeg as E
from loomwright.operators import evaluation as EV
from loomwright.operators import workload as W

EVENTS = "user_id string, task_id string, event_type string, ts bigint, pos int, total_steps int"


def task(spark, events):
    rows = [("u", "t", kind, ts, i, steps) for i, (kind, ts, steps) in enumerate(events)]
    return W.behaviour_scores(W.behaviour_features(spark.createDataFrame(rows, EVENTS), ["user_id", "task_id"])).first()


def test_clicks_and_duration(spark):
    row = task(spark, [("task_start", 1000, None), ("click", 1100, None), ("click", 1200, None), ("click", 1300, None), ("task_end", 2000, None)])
    assert row["click_count"] == 3 and row["duration_ms"] == 1000


def test_back_rate(spark):
    assert task(spark, [("click", 1, None), ("click", 2, None), ("back", 3, None)])["back_rate"] == pytest.approx(0.333, abs=1e-3)


def test_high_load(spark):
    kinds = [("task_start", 1000)] + [("click", 2000)] * 2 + [("back", 3000)] * 2 + [("error_or_repeat", 4000)] * 2 + [("task_end", 10000)]
    assert task(spark, [(k, ts, None) for k, ts in kinds])["behavior_score"] == pytest.approx(0.55)


def test_empty_features(spark):
    zero = F.lit(0.0)
    assert spark.range(1).select(S.behaviour_score(zero, zero, zero, zero, F.lit(1.0)).alias("s")).first()["s"] == 0.1


def test_completion(spark):
    row = task(spark, [("step_view", 1, 4), ("step_view", 2, 4), ("task_end", 3, None)])
    assert row["completion_rate"] == 0.5


def answers(spark, *values):
    return spark.createDataFrame([values], ", ".join(f"{d} int" for d in V.TLX_DIMENSIONS))


def test_questionnaire(spark):
    def score(*values):
        return W.tlx_scores(answers(spark, *values)).first()["questionnaire_score"]

    assert score(1, 1, 1, 7, 1, 1) == 0.0
    assert score(7, 7, 7, 1, 7, 7) == 1.0
    assert 0.3 < score(4, 3, 4, 4, 4, 3) < 0.7
    assert [spark.range(1).select(S.tlx_unit(F.lit(v)).alias("x")).first()["x"] for v in (1, 4, 7)] == [0.0, 0.5, 1.0]


def test_zero_weights(spark):
    rows = W.tlx_scores(answers(spark, 7, 7, 7, 7, 7, 7), {d: 0.0 for d in V.TLX_DIMENSIONS})
    assert rows.first()["questionnaire_score"] == 0.5


def test_fusion(spark):
    df = spark.createDataFrame([(0.2, 0.8, None), (None, None, 0.9), (None, None, None), (None, 0.8, 0.1)], "behavior double, questionnaire double, eeg double")
    scores = {n: F.col(n) for n in df.columns}
    rows = df.select(S.fused_score(scores).alias("f"), S.fusion_method(scores).alias("m"), S.adjusted_weights(scores).alias("w")).collect()
    assert [r["f"] for r in rows] == pytest.approx([0.56, 0.5, 0.5, 0.8])
    assert [r["m"] for r in rows] == ["weighted", "weighted", "default", "weighted"]
    assert rows[0]["w"] == {"behavior": 0.4, "questionnaire": 0.6} and rows[1]["w"]["eeg"] == 0.0


def test_levels(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.8,)], "s double")
    assert [r[0] for r in df.select(S.level_for(F.col("s"), "fusion")).collect()] == ["low", "medium", "high"]


def test_change_rate_orders(spark):
    rows = [("u", f"t{i}", s, i) for i, s in enumerate([0.2, 0.2, 0.4, 0.4, 0.4])]
    df = spark.createDataFrame(rows, "user_id string, task_id string, final_score double, h int").withColumn(
        "created_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, h)"))
    assert W.change_rates(df).first()["change_rate"] == 1.0
    assert W.change_rates(df, newest_first=True).first()["change_rate"] == pytest.approx(round((0.8 / 3 - 0.4) / 0.4, 3))


def test_prf(spark):
    df = spark.createDataFrame([(30, 26, 1), (11, 9, 1), (0, 0, 0)], "tp int, fp int, fn int")
    rows = [tuple(round(v, 3) for v in r) for r in df.select(*EV.prf(F.col("tp"), F.col("fp"), F.col("fn"))).collect()]
    assert rows == [(0.536, 0.968, 0.690), (0.550, 0.917, 0.687), (0.0, 0.0, 0.0)]


def test_answer_scores(spark):
    df = spark.createDataFrame([("腹痛", "symptom"), ("腹痛和发热", "symptom"), ("增强CT", "examination"), ("腹痛，请咨询专业医生", "symptom"), (" ", "symptom"), ("x", "none")], "a string, c string")
    assert [r[0] for r in df.select(EV.answer_score(F.col("a"), F.col("c"))).collect()] == [0.5, 1.0, 1.0, 0.0, 0.0, 0.0]


def tone(spark, freq, n=7680, amplitude=10.0):
    rows = [("r", ch, i, amplitude * math.sin(2 * math.pi * freq * i / 256)) for ch in ("TP9", "AF7") for i in range(n)]
    return spark.createDataFrame(rows, "recording_id string, channel string, sample_idx long, uv double")


@pytest.mark.parametrize("freq, band", [(6, "theta"), (10, "alpha"), (20, "beta")])
@pytest.mark.parametrize("headset", [False, True])
def test_tones_land_in_their_band(spark, freq, band, headset):
    row = E.spectral_features(E.epochs(tone(spark, freq)), headset=headset).first().asDict()
    assert max(E.POWERS, key=lambda n: row[n]) == f"{band}_power"
    # a sine of amplitude 10 carries power 50; Simpson's alternating weights distort a line spectrum
    assert row[f"{band}_power"] == pytest.approx(50, rel=0.05 if headset else 0.35)


def test_short_epochs_are_null(spark):
    row = E.spectral_features(tone(spark, 6, n=100).withColumn("epoch", F.lit(0))).first()
    assert row["theta_power"] is None


def test_epoch_bounds(spark):
    samples = tone(spark, 6, n=2560)
    count = lambda df: df.select("epoch").distinct().count()
    assert count(E.epochs(samples, 256, 5.0)) == 2
    assert count(E.epochs(samples, 256, 5.0, drop_last=True)) == 1


def test_simpson_is_exact_for_parabolas():
    for n in (3, 4, 5, 6, 71):
        x = np.arange(n, dtype=float)
        assert E.simpson(x**2, 1.0) == pytest.approx((n - 1) ** 3 / 3)


def test_idle_conversations_leave_the_state(spark, tmp_path):
    """Four files, one batch each: the watermark passes conversation 1's last message by more than the idle time before it speaks again."""
    from loomwright.streaming import jobs
    from loomwright.streaming.runner import run_updates

    files = [
        [(1, 0, "2024-01-01 00:00:00"), (2, 0, "2024-01-01 00:00:00")], [(2, 1, "2024-01-01 02:00:00")], [(2, 2, "2024-01-01 02:30:00")],
        [(1, 1, "2024-01-01 02:40:00"), (2, 3, "2024-01-01 02:40:00")]]
    schema = "conv_id long, turn long, role string, text string, event_time timestamp"
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(c, t, "user", f"m{t}", ts) for c, t, ts in rows], "conv_id long, turn long, role string, text string, ts string")
        df.withColumn("event_time", F.col("ts").cast("timestamp")).drop("ts").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        os.utime(next((tmp_path / f"f{i}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
        rows = run_updates(jobs.recent_messages(stream.withWatermark("event_time", "10 minutes"), 10, "1 hour")).collect()
    finally:
        spark.conf.set(store, before)
    last = {}
    for r in rows:
        last.setdefault((r["conv_id"], r["batch"]), []).append((r["age"], r["text"]))
    newest = {conv: sorted(last[conv, max(b for c, b in last if c == conv)]) for conv in (1, 2)}
    assert newest == {1: [(1, "m1")], 2: [(1, "m3"), (2, "m2"), (3, "m1"), (4, "m0")]}
