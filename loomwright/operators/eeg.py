"""EEG jobs on the long table ``(recording_id, channel, sample_idx, uv)``.

Only the spectra need arrays: they are computed per (recording, epoch), a group bounded by the epoch length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import scoring as S
from loomwright.functions import text as T

c = F.col
BANDS = list(V.EEG_BANDS)
POWERS = [f"{b}_power" for b in BANDS]
RATIOS = ["theta_beta_ratio", "theta_alpha_ratio", "alpha_beta_ratio"]


def select_channels(samples: DataFrame) -> DataFrame:
    """The four channels of the headset under their headset names."""
    name = F.element_at(T.mapping(V.EEG_CHANNELS), c("channel"))
    return samples.filter(c("channel").isin(list(V.EEG_CHANNELS))).withColumn("channel", name)


def _sample_peaks(samples: DataFrame) -> DataFrame:
    return samples.groupBy("recording_id", "sample_idx").agg(F.max(F.abs("uv")).alias("peak"))


def remove_artifacts(samples: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Drop a sample index when any channel reaches the threshold."""
    peak = F.max(F.abs("uv")).over(Window.partitionBy("recording_id", "sample_idx"))
    return samples.withColumn("_peak", peak).filter(c("_peak") < threshold).drop("_peak")


def artifact_share(samples: DataFrame, threshold: float = 100.0) -> DataFrame:
    removed = F.count_if(c("peak") >= threshold)
    return _sample_peaks(samples).groupBy("recording_id").agg(
        removed.alias("removed"), F.count("*").alias("samples"), (removed / F.count("*")).alias("share"))


def epochs(samples: DataFrame, fs: int = 256, seconds: float = 30.0, drop_last: bool = False) -> DataFrame:
    """Full windows only; ``drop_last`` leaves out the last one when the length divides exactly."""
    length = int(seconds * fs)
    sizes = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("_n"))
    full = F.ceil((c("_n") - length) / length) if drop_last else F.floor(c("_n") / length)
    limits = sizes.select("recording_id", F.greatest(full, F.lit(0)).alias("_epochs"))
    numbered = samples.withColumn("epoch", F.floor(c("sample_idx") / length).cast("int")).join(limits, "recording_id")
    return numbered.filter(c("epoch") < c("_epochs")).drop("_epochs")


#: Samples of a channel that are handled together.
BLOCK = 4096


def resample(samples: DataFrame, fs: float, target: float = 256.0) -> DataFrame:
    """Linear resampling to ``target`` Hz; a rate within 1 Hz of it stays as it is."""
    if abs(fs - target) < 1:
        return samples
    ratio = fs / target
    block = F.floor(c("sample_idx") / BLOCK)
    # blocks of a channel side by side; the first sample of a block also ends the block before
    both = F.when(c("sample_idx") % BLOCK == 0, F.array(block, block - 1)).otherwise(F.array(block))
    blocked = samples.select("recording_id", "channel", "sample_idx", "uv", F.explode(both).alias("_block"))
    order = Window.partitionBy("recording_id", "channel", "_block").orderBy("sample_idx")
    follows = F.lead("sample_idx").over(order) == c("sample_idx") + 1
    pairs = blocked.withColumn("_next", F.when(follows, F.lead("uv").over(order))).filter(c("_block") == block)
    first = F.ceil(c("sample_idx") / ratio).cast("bigint")
    last = F.when(c("_next").isNull(), F.floor(c("sample_idx") / ratio)).otherwise(F.ceil((c("sample_idx") + 1) / ratio) - 1).cast("bigint")
    targets = pairs.filter(first <= last).select("recording_id", "channel", c("sample_idx").alias("_i"), "uv", "_next", F.explode(F.sequence(first, last)).alias("sample_idx"))
    share = c("sample_idx") * ratio - c("_i")
    value = c("uv") + share * (F.coalesce("_next", c("uv")) - c("uv"))
    return targets.select("recording_id", "channel", "sample_idx", value.alias("uv"))


# --- spectra -------------------------------------------------------------------------------------------------------


def welch(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density by averaged Hann segments, half overlapping, each without its mean."""
    n = min(256, len(x))
    step = n - n // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segments = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    spectra = np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * window, axis=1)
    density = (np.abs(spectra) ** 2).mean(axis=0) / (fs * (window**2).sum())
    density[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), density


def simpson(y: np.ndarray, h: float) -> float:
    """Composite Simpson rule on an even grid; an odd number of intervals ends with the three-point correction."""
    n = len(y)
    if n < 3:
        return float(h * (y[0] + y[1]) / 2) if n == 2 else 0.0
    tail = h * (5 * y[-1] + 8 * y[-2] - y[-3]) / 12 if n % 2 == 0 else 0.0
    body = y[: n - 1] if n % 2 == 0 else y
    return float(h / 3 * (body[0] + body[-1] + 4 * body[1::2].sum() + 2 * body[2:-1:2].sum()) + tail)


def band_pass(x: np.ndarray, low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band pass: the squared magnitude response applied to the spectrum."""
    w = np.tan(np.pi * np.fft.rfftfreq(len(x), 1 / fs) / fs)
    a, b = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
    with np.errstate(divide="ignore", over="ignore"):
        gain = 1 / (1 + ((w**2 - a * b) / ((b - a) * w)) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x) * np.nan_to_num(gain), len(x))


def band_powers(signals: np.ndarray, fs: float, headset: bool) -> dict[str, float]:
    """Power per band, averaged over channels (rows)."""
    bands = V.EEG_BANDS_HEADSET if headset else V.EEG_BANDS
    totals = dict.fromkeys(bands, 0.0)
    for x in signals:
        freqs, density = welch(band_pass(x, 1, 50, fs) if headset else x, fs)
        for name, (low, high) in bands.items():
            part = density[(freqs >= low) & (freqs <= high)]
            totals[name] += float(np.trapezoid(part, dx=freqs[1])) if headset else simpson(part, freqs[1])
    return {name: total / len(signals) for name, total in totals.items()}


def spectral_features(samples: DataFrame, fs: int = 256, headset: bool = False) -> DataFrame:
    """Band powers and ratios per (recording, epoch).

    ``headset`` filters 1-50 Hz, integrates by trapezoids with gamma up to 50 Hz and rounds to three decimals; otherwise
    no filter, Simpson's rule and gamma up to 100 Hz. Fewer than 256 samples give nulls.
    """
    schema = "recording_id string, epoch int, " + ", ".join(f"{n} double" for n in POWERS + RATIOS)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        signals = frame.pivot(index="channel", columns="sample_idx", values="uv").sort_index().to_numpy(dtype=float)
        row = {"recording_id": str(key[0]), "epoch": int(key[1])}
        if signals.shape[1] < 256:
            return pd.DataFrame([row | dict.fromkeys(POWERS + RATIOS)]).astype(dict.fromkeys(POWERS + RATIOS, "float64"))
        p = band_powers(signals, fs, headset)

        def ratio(a: str, b: str) -> float:
            return p[a] / p[b] if p[b] > 0 else 0.0

        row |= {f"{n}_power": v for n, v in p.items()}
        row |= {"theta_beta_ratio": ratio("theta", "beta"), "theta_alpha_ratio": ratio("theta", "alpha"), "alpha_beta_ratio": ratio("alpha", "beta")}
        if headset:
            row = {n: round(v, 3) if isinstance(v, float) else v for n, v in row.items()}
        return pd.DataFrame([row])

    return samples.groupBy(c("recording_id").cast("string").alias("recording_id"), "epoch").applyInPandas(run, schema)


# --- scores --------------------------------------------------------------------------------------------------------


def _any_power() -> Column:
    out = F.lit(False)
    for name in POWERS:
        out = out | (F.coalesce(c(name), F.lit(0.0)) != 0)
    return out


def scores(features: DataFrame, headset: bool = False) -> DataFrame:
    score = S.eeg_score(c("theta_beta_ratio"), c("alpha_beta_ratio"), c("theta_alpha_ratio"), _any_power(), headset)
    return features.withColumn("eeg_score", score)


def _safe_divide(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (b == 0), 1.0).otherwise(a / b)


def scores_with_baseline(features: DataFrame, baselines: DataFrame, key: str, headset: bool = False) -> DataFrame:
    """Scores against each person's baseline powers; rows without a baseline use the absolute score."""
    base = baselines.select(key, *[c(n).alias(f"_b_{n}") for n in POWERS], F.lit(True).alias("_has"))
    rows = features.join(base, key, "left")

    def power(name: str, default: float) -> tuple[Column, Column]:
        mine, theirs = F.nullif(c(f"{name}_power"), F.lit(0.0)), c(f"_b_{name}_power")
        if headset:
            return F.coalesce(mine, F.lit(default)), F.coalesce(F.nullif(theirs, F.lit(0.0)), F.lit(default))
        return F.coalesce(mine, theirs), theirs

    theta, theta_base = power("theta", 8.0)
    alpha, alpha_base = power("alpha", 12.0)
    beta_base = power("beta", 6.0)[1]
    usual = _safe_divide(theta_base, beta_base)
    if not headset:
        usual = F.when(F.coalesce(beta_base, F.lit(0.0)) == 0, 1.5).otherwise(usual)
    ratio = F.coalesce(F.nullif(c("theta_beta_ratio"), F.lit(0.0)), F.lit(1.5))
    relative = S.eeg_score_with_baseline(_safe_divide(theta, theta_base), _safe_divide(alpha, alpha_base), _safe_divide(ratio, usual))
    absolute = S.eeg_score(c("theta_beta_ratio"), c("alpha_beta_ratio"), c("theta_alpha_ratio"), F.lit(True), headset)
    chosen = F.when(~_any_power(), 0.5).when(c("_has"), S.clamp(relative)).otherwise(absolute)
    return rows.withColumn("eeg_score", chosen).drop("_has", *[f"_b_{n}" for n in POWERS])


def channel_quality(samples: DataFrame) -> DataFrame:
    rows = samples.groupBy("recording_id", "channel").agg(
        F.count("*").alias("n"), F.stddev_pop("uv").alias("std"), F.max(F.abs("uv")).alias("max_amplitude"))
    quality = (
        F.when(c("n") < 256, "unknown").when(c("max_amplitude") > 200, "poor").when(c("max_amplitude") > 100, "fair")
        .when(c("std") > 20, "fair").otherwise("good")
    )
    return rows.withColumn("quality", quality).withColumns({n: F.round(n, 2) for n in ("std", "max_amplitude")})


def signal_quality(channels: DataFrame) -> DataFrame:
    poor, fair = F.count_if(c("quality") == "poor"), F.count_if(c("quality") == "fair")
    overall = F.when(F.count_if(c("quality") == "unknown") > 0, "unknown").when(poor >= 2, "poor").when((poor >= 1) | (fair >= 3), "fair").otherwise("good")
    return channels.groupBy("recording_id").agg(overall.alias("overall"))


def session_averages(features: DataFrame, keys: list[str]) -> DataFrame:
    """Mean powers over the segments of a session (a null counts as 0), ratios from the rounded means."""
    means = features.groupBy(*keys).agg(F.count("*").alias("segments"), *[
        F.round(F.sum(F.coalesce(c(n), F.lit(0.0))) / F.count("*"), 3).alias(n) for n in POWERS])

    def ratio(a: str, b: str) -> Column:
        return F.round(_safe_divide(c(f"{a}_power"), c(f"{b}_power")), 3)

    return means.withColumns({
        "theta_beta_ratio": ratio("theta", "beta"), "theta_alpha_ratio": ratio("theta", "alpha"), "alpha_beta_ratio": ratio("alpha", "beta")})


def subject_scores(scored: DataFrame, key: str = "recording_id") -> DataFrame:
    return scored.groupBy(key).agg(
        F.count("*").alias("epochs"), F.avg("eeg_score").alias("mean_score"), F.stddev_pop("eeg_score").alias("std_score"))


def relative_powers(features: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Powers divided by the person's baseline, band by band, where that is not zero."""
    base = baselines.select(key, *[c(n).alias(f"_b_{n}") for n in POWERS])
    rows = features.join(base, key, "left")
    divided = {n: F.when(F.coalesce(c(f"_b_{n}"), F.lit(0.0)) != 0, c(n) / c(f"_b_{n}")).otherwise(c(n)) for n in POWERS}
    return rows.withColumns(divided).drop(*[f"_b_{n}" for n in POWERS])
