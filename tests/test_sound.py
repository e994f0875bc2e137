"""Onset strength and pitch against plain forms, and windows across the seams of chunks."""

import math
import wave

import numpy as np
import pytest

from crestline.operators import audio
from crestline.operators.audio import PitchTrack, frame_features, lag_differences, mel_filters, pitch_variance, window_features
from crestline.sources import tables

RATE = 11025


def tone(seconds, hz, rate=RATE):
    return np.sin(2 * np.pi * np.cumsum(np.broadcast_to(hz, int(seconds * rate)) / rate))


def plain_onset(y, rate, length=2048, hop=512, bands=128):
    """Decibels of mel bands frame by frame, by the definitions."""
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / (math.log(6.4) / 27)
    back = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)
    edges = [back(i * mel(rate / 2) / (bands + 1)) for i in range(bands + 2)]
    y = np.concatenate([np.zeros(length // 2), y, np.zeros(length // 2)])
    shape = [0.5 - 0.5 * math.cos(2 * math.pi * i / length) for i in range(length)]
    rows = []
    for at in range(0, len(y) - length + 1, hop):
        power = np.abs(np.fft.fft(y[at : at + length] * shape)[: length // 2 + 1]) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
            total = 0.0
            for k in range(math.floor(lo * length / rate), min(length // 2, math.ceil(hi * length / rate)) + 1):
                f = k * rate / length
                total += power[k] * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo)
            row.append(10 * math.log10(max(1e-10, total)))
        rows.append(row)
    floor = max(map(max, rows)) - 80
    rows = [[max(v, floor) for v in r] for r in rows]
    rise = [sum(max(0.0, b - a) for a, b in zip(x, z, strict=True)) / bands for x, z in zip(rows, rows[1:], strict=False)]
    return ([0.0] * 3 + rise)[: len(rows)]


def plain_pitch(track, y):
    """Lag differences by sums, and the best of all paths over a dense table of moves."""
    n, w, tiny = track.steps, track.length // 2, np.finfo(float).tiny
    y = np.concatenate([np.zeros(w), y, np.zeros(w)])
    first, last = int(track.rate / track.high), min(math.ceil(track.rate / track.low), track.length - w - 1)
    levels = np.linspace(0, 1, track.thresholds + 1)
    cdf = [1 - (1 - x) ** 18 * (1 + 18 * x) for x in levels]
    seen = []
    for at in range(0, len(y) - track.length + 1, track.hop):
        x = y[at : at + track.length]
        d = [sum((x[1 : w + 1] - x[1 + lag : w + 1 + lag]) ** 2) for lag in range(last + 1)]
        d = [d[lag] / (sum(d[1 : lag + 1]) / lag + tiny) for lag in range(first, last + 1)]
        dips = [i for i in range(len(d)) if (i == 0 or d[i] < d[i - 1]) and (d[i] < d[i + 1] if i == 0 else i + 1 == len(d) or d[i] <= d[i + 1])]
        chance = dict.fromkeys(dips, 0.0)
        for k, level in enumerate(levels[1:]):
            under, share = [i for i in dips if d[i] < level], cdf[k + 1] - cdf[k]
            weights = [math.exp(-2 * j) for j in range(len(under))]
            for i, v in zip(under, weights, strict=True):
                chance[i] += share * v / sum(weights)
            if dips:
                deepest = min(dips, key=lambda i: d[i])
                chance[deepest] += 0.01 * share * (d[deepest] >= level)
        row = np.zeros(n)
        for i in dips:
            a, b = (d[i + 1] + d[i - 1] - 2 * d[i], (d[i + 1] - d[i - 1]) / 2) if 0 < i < len(d) - 1 else (0, 0)
            period = first + i + (-b / a if abs(b) < abs(a) else 0)
            row[min(n - 1, max(0, round(12 * track.per_semitone * math.log2(track.rate / period / track.low))))] = chance[i]
        seen.append(np.concatenate([row, np.full(n, (1 - min(1, row.sum())) / n)]))
    reach = round(track.octaves_a_second * 12 * track.hop / track.rate) * track.per_semitone // 2
    move = np.maximum(0, 1 - np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / (reach + 1))
    move /= move.sum(axis=1, keepdims=True)
    move = np.log(np.kron([[0.99, 0.01], [0.01, 0.99]], move) + tiny)
    score, back = np.log(np.concatenate([np.zeros(n), np.full(n, 1 / n)]) + tiny) + np.log(seen[0] + tiny), []
    for row in seen[1:]:
        via = score[:, None] + move
        back.append(via.argmax(axis=0))
        score = via.max(axis=0) + np.log(row + tiny)
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return [track.low * 2 ** (s / (12 * track.per_semitone)) if s < n else math.nan for s in reversed(states)]


def test_onset_strength_against_a_plain_form(monkeypatch):
    monkeypatch.setattr(audio, "_FRAMES", 7)  # blocks of frames leave no seam
    rng = np.random.default_rng(0)
    clicks = np.zeros(RATE * 2)
    clicks[[4000, 12000, 12300]] = 1.0
    for y in (clicks, tone(1, 330) * np.linspace(0, 1, RATE), rng.standard_normal(RATE) * 0.1, np.zeros(3000)):
        y = y.astype(np.float32)
        found = frame_features(y, RATE)
        assert np.allclose(found["onset"], plain_onset(y.astype(float), RATE), atol=2e-3)
        whole = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(np.pad(y.astype(float), 1024), 2048)[::512] * np.hanning(2049)[:-1], axis=1))
        assert np.allclose(found["flux"], [0, *np.sqrt((np.diff(whole, axis=0) ** 2).sum(axis=1))])
    clicks[5000:] = 0
    onset = frame_features(clicks.astype(np.float32), RATE)["onset"]
    assert abs(int(onset.argmax()) - 4000 / 512) <= 1 and not onset[20:].any()


def test_mel_filters_have_equal_area():
    m = mel_filters(RATE, 2048)
    assert m.shape == (128, 1025) and (m >= 0).all()
    wide = m[-20:]
    assert np.allclose(wide.sum(axis=1) * RATE / 2048, 1, rtol=0.05)


def test_lag_differences_against_sums():
    rng = np.random.default_rng(1)
    frames = rng.standard_normal((3, 64))
    got = lag_differences(frames, 32, 3, 20)
    for x, row in zip(frames, got, strict=True):
        d = [((x[1:33] - x[1 + t : 33 + t]) ** 2).sum() for t in range(21)]
        assert np.allclose(row, [d[t] / np.mean(d[1 : t + 1]) for t in range(3, 21)])


@pytest.mark.parametrize("kind", ["tone", "glide", "gap", "noise"])
def test_pitch_against_a_plain_form(kind):
    rng = np.random.default_rng(2)
    track = PitchTrack(4000, low=100.0, high=500.0, length=512, hop=128, per_semitone=3)
    y = {
        "tone": tone(0.5, 220.0, 4000),
        "glide": tone(0.6, np.linspace(150, 400, 2400), 4000),
        "gap": np.concatenate([tone(0.3, 200.0, 4000), np.zeros(800), tone(0.3, 310.0, 4000)]),
        "noise": rng.standard_normal(1600),
    }[kind] + 1e-3 * rng.standard_normal({"tone": 2000, "glide": 2400, "gap": 3200, "noise": 1600}[kind])
    got = track.of(y)
    assert np.allclose(got, plain_pitch(track, y), equal_nan=True)
    if kind == "tone":
        assert np.nanmax(np.abs(got[3:-3] - 220)) < 8


def test_pitch_variance_of_known_sounds():
    steady, wobble = tone(5, 220.0), tone(5, 220 + 30 * np.sin(2 * np.pi * 3 * np.arange(5 * RATE) / RATE))
    assert pitch_variance(steady, RATE) < 1
    assert pitch_variance(wobble, RATE) == pytest.approx(450, rel=0.25)  # 30 squared over 2
    assert pitch_variance(np.zeros(5 * RATE), RATE) == 0.0 and pitch_variance(np.zeros(0), RATE) == 0.0


def test_no_window_is_lost_at_a_seam(spark, tmp_path):
    """Chunks of 10 s and an overlap of 5: the windows of a loop that cuts, reads on and drops what it has had."""
    rng = np.random.default_rng(5)
    y = (rng.standard_normal(RATE * 33) * np.linspace(0.01, 0.2, RATE * 33) * 32767).clip(-32768, 32767).astype("<i2")
    for name, samples in (("a", y), ("b", y[: RATE * 12]), ("c", y[: RATE * 3]), ("d", y[:0])):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(RATE)
            f.writeframes(samples.tobytes())
    got = {}
    for r in audio.sound_windows(tables.read_wav(spark, str(tmp_path), 10, 5.0)).orderBy("time").collect():
        got.setdefault(r["path"][-5], []).append(r)
    for name, samples in (("a", y), ("b", y[: RATE * 12])):
        x, want = (samples / 32768).astype(np.float32), []
        for offset in range(0, -(-len(x) // RATE), 10):
            found = window_features(x[offset * RATE : (offset + 15) * RATE], RATE)
            rows = [(offset + at * 512 / RATE, *(found[n][i] for n in ("rms", "onset", "flux", "pitch_var"))) for i, at in enumerate(found["start"])]
            want += [r for r in rows if not want or r[0] > last]
            last = want[-1][0] if want else 0.0
        mine = [(r["time"], r["rms"], r["onset"], r["flux"], r["pitch_var"]) for r in got[name]]
        assert len(mine) == len(want) and np.allclose(mine, want, rtol=1e-6, atol=1e-9)
    assert "c" not in got and "d" not in got
