"""Features of audio: from class probabilities and from raw samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class indices and weights of the tagging model's output.  Fixed values.
SPEECH = (0, 1, 2)
EXCITEMENT = {8: 1.0, 10: 0.8, 11: 1.0, 12: 1.0, 14: 1.0, 16: 1.0, 18: 0.8, 20: 1.0, 44: 0.7, 66: 0.9}
GAME = {137: 0.8, 287: 0.6, 426: 1.0, 427: 1.0, 428: 0.9, 436: 0.8, 469: 0.7}


def weighted_classes(probs: Column, weights: Mapping[int, float]) -> Column:
    """Weighted sum of class probabilities by index; classes that are absent count 0."""
    total = F.lit(0.0)
    for i, w in weights.items():
        total = total + F.coalesce(F.get(probs, F.lit(i)).cast("double"), F.lit(0.0)) * w
    return total


def class_scores(
    df: DataFrame, probs: str, speech: Sequence[int] = SPEECH, excitement: Mapping[int, float] = EXCITEMENT, game: Mapping[int, float] = GAME
) -> DataFrame:
    """Add ``speech_presence`` (largest speech class), ``vocal_excitement`` and ``game_audio``."""
    p = F.col(probs)
    present = F.greatest(*[F.coalesce(F.get(p, F.lit(i)).cast("double"), F.lit(0.0)) for i in speech])
    return df.withColumns({"speech_presence": present, "vocal_excitement": weighted_classes(p, excitement), "game_audio": weighted_classes(p, game)})


#: Frames whose spectra are held at a time, and decibels below the loudest that count as silence.
_FRAMES, _RANGE_DB = 4096, 80.0


@lru_cache(maxsize=8)
def mel_filters(rate: int, length: int, bands: int = 128) -> np.ndarray:
    """Triangles of equal area over a spectrum, evenly spaced in mel from 0 to half the rate: a row a band.

    Mel is linear up to 1,000 Hz, at 15 there, and a factor of 6.4 for every 27 above.
    """
    top = rate / 2
    most = top * 3 / 200 if top < 1000 else 15 + 27 * np.log(top / 1000) / np.log(6.4)
    mel = np.linspace(0, most, bands + 2)
    edges = np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))
    bins, left, peak, right = np.fft.rfftfreq(length, 1 / rate), edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - left) / (peak - left), (right - bins) / (right - peak))) * (2 / (right - left))


def frame_features(samples: np.ndarray, rate: int, length: int = 2048, hop: int = 512) -> dict[str, np.ndarray]:
    """Loudness, crossings, spectral centroid, flux and onset strength of each frame, centred, the ends zero-padded.

    Onset strength is the mean rise of the decibels of mel bands, with 80 dB of range below the loudest, and
    falls on the frame half a frame length after the rise.  Spectra are made and dropped a block of frames at a time.
    """
    y = np.pad(np.asarray(samples, dtype=np.float32), length // 2)
    frames = np.lib.stride_tricks.sliding_window_view(y, length)[::hop] if len(y) >= length else np.zeros((1, length), dtype=np.float32)
    n, bins, window, mels = len(frames), np.fft.rfftfreq(length, 1 / rate), np.hanning(length + 1)[:-1], mel_filters(rate, length)
    out = {k: np.zeros(n) for k in ("rms", "zcr", "centroid", "flux", "onset")}
    bands, last = np.zeros((n, len(mels)), dtype=np.float32), None
    for lo in range(0, n, _FRAMES):
        block = frames[lo : lo + _FRAMES].astype(float)
        at = slice(lo, lo + len(block))
        spectrum = np.abs(np.fft.rfft(block * window, axis=1))
        total = spectrum.sum(axis=1)
        out["rms"][at] = np.sqrt((block**2).mean(axis=1))
        out["zcr"][at] = (np.diff(np.signbit(block), axis=1) != 0).mean(axis=1)
        out["centroid"][at] = np.divide(spectrum @ bins, total, out=np.zeros(len(block)), where=total > 0)
        before = spectrum[:1] if last is None else last
        out["flux"][at] = np.sqrt((np.diff(np.vstack([before, spectrum]), axis=0) ** 2).sum(axis=1))
        bands[at], last = 10 * np.log10(np.maximum(1e-10, spectrum**2 @ mels.T)), spectrum[-1:]
    np.maximum(bands, bands.max() - _RANGE_DB, out=bands)
    rise, late = np.maximum(0, np.diff(bands, axis=0)).mean(axis=1), 1 + length // (2 * hop)
    out["onset"][late:] = rise[: max(0, n - late)]
    return out


def lag_differences(frames: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """Differences of frames to themselves ``first`` to ``last`` samples later, over their mean up to that lag, by FFT.

    The difference at a lag is the sum of squares over the ``width`` samples from the second on.
    """
    own, size = frames[:, 1 : width + 1], 2 * frames.shape[1]
    product = np.fft.irfft(np.fft.rfft(frames, size, axis=1) * np.conj(np.fft.rfft(own, size, axis=1)), axis=1)
    lags = np.arange(last + 1)
    energy = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    shifted = energy[:, lags + width + 1] - energy[:, lags + 1]
    apart = np.maximum(0, shifted[:, :1] + shifted - 2 * product[:, 1 : last + 2])
    mean = np.cumsum(apart[:, 1:], axis=1) / lags[1:]
    return apart[:, first : last + 1] / (mean[:, first - 1 : last] + np.finfo(float).tiny)


@dataclass(frozen=True)
class PitchTrack:
    """Probabilistic pitch: candidates under many thresholds, and the likeliest path through them.

    Every dip of a frame's lag differences is a pitch, as likely as the thresholds are (beta distributed) under which it is
    chosen, mostly as the first.  Voiced and unvoiced states of ``per_semitone`` steps a semitone form a hidden Markov chain; its
    likeliest path gives the pitch of the voiced frames.
    """

    rate: int
    low: float = 440 * 2 ** (-33 / 12)  # the notes C2 and C7
    high: float = 440 * 2 ** (27 / 12)
    length: int = 2048
    hop: int = 512
    thresholds: int = 100
    decay: float = 2.0
    no_dip: float = 0.01
    per_semitone: int = 10
    octaves_a_second: float = 35.92
    switch: float = 0.01

    @property
    def steps(self) -> int:
        return int(np.floor(12 * self.per_semitone * np.log2(self.high / self.low))) + 1

    @cached_property
    def moves(self) -> np.ndarray:
        """Log probability that the step ``k - reach`` places on moves to each step: a triangle around a step, whole at the ends."""
        reach = round(self.octaves_a_second * 12 * self.hop / self.rate) * self.per_semitone // 2
        shape = 1 - np.abs(np.arange(-reach, reach + 1)) / (reach + 1)
        ones = np.pad(np.ones(self.steps), reach)
        total = np.lib.stride_tricks.sliding_window_view(ones, 2 * reach + 1) @ shape
        padded = np.pad(total, reach, constant_values=np.inf)
        with np.errstate(divide="ignore"):
            return np.log(shape / np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1))

    def candidates(self, samples: np.ndarray) -> np.ndarray:
        """Probability of each voiced step in each frame."""
        y = np.pad(np.asarray(samples, dtype=float), self.length // 2)
        frames = np.lib.stride_tricks.sliding_window_view(y, self.length)[:: self.hop]
        width = self.length // 2
        first = int(np.floor(self.rate / self.high))
        last = min(int(np.ceil(self.rate / self.low)), self.length - width - 1)
        dips = lag_differences(frames, width, first, last)
        a, b = dips[:, :-2] + dips[:, 2:] - 2 * dips[:, 1:-1], (dips[:, 2:] - dips[:, :-2]) / 2
        shift = np.zeros_like(dips)
        shift[:, 1:-1] = np.where(np.abs(b) < np.abs(a), -b / np.where(a == 0, 1, a), 0)
        low = np.zeros(dips.shape, dtype=bool)
        low[:, 1:-1] = (dips[:, 1:-1] < dips[:, :-2]) & (dips[:, 1:-1] <= dips[:, 2:])
        low[:, 0], low[:, -1] = dips[:, 0] < dips[:, 1], dips[:, -1] < dips[:, -2]
        levels = np.linspace(0, 1, self.thresholds + 1)
        share = np.diff(1 - (1 - levels) ** 18 * (1 + 18 * levels))  # of the beta distribution with 2 and 18
        out = np.zeros((len(frames), self.steps))
        for i, (row, dip) in enumerate(zip(dips, low, strict=True)):
            at = np.flatnonzero(dip)
            if not len(at):
                continue
            under = row[at, None] < levels[None, 1:]
            place, many = np.cumsum(under, axis=0) - 1, under.sum(axis=0)
            weight = np.exp(-self.decay * place) * -np.expm1(-self.decay) / -np.expm1(-self.decay * np.maximum(many, 1))
            chance = np.where(under, weight, 0) @ share
            deepest = int(np.argmin(row[at]))
            chance[deepest] += self.no_dip * share[: int((~under[deepest]).sum())].sum()
            pitch = self.rate / (first + at + shift[i, at])
            out[i, np.clip(np.rint(12 * self.per_semitone * np.log2(pitch / self.low)), 0, self.steps - 1).astype(int)] = chance
        return out

    def path(self, voiced: np.ndarray) -> np.ndarray:
        """Step of each frame on the likeliest path, -1 where it is unvoiced."""
        n, (frames, steps), least = self.moves.shape[1] // 2, voiced.shape, np.log(np.finfo(float).tiny)
        silent = (1 - np.clip(voiced.sum(axis=1), 0, 1)) / steps
        with np.errstate(divide="ignore"):
            seen = [np.log(voiced + np.finfo(float).tiny), np.log(silent + np.finfo(float).tiny)[:, None]]
        stay, turn = np.log(1 - self.switch), np.log(self.switch)
        score = [np.full(steps, least) + seen[0][0], np.full(steps, -np.log(steps)) + seen[1][0]]
        back = np.zeros((frames, 2, steps), dtype=np.int32)
        for t in range(1, frames):
            best, origin = [], []
            for s in score:
                near = np.lib.stride_tricks.sliding_window_view(np.pad(s, n, constant_values=-np.inf), 2 * n + 1) + self.moves
                k = near.argmax(axis=1)
                value, place = near[np.arange(steps), k], np.arange(steps) + k - n
                far = int(s.argmax())  # moves beyond the triangle are all but impossible, and all equally so
                jump = s[far] + least > value
                best.append(np.where(jump, s[far] + least, value))
                origin.append(np.where(jump, far, place))
            fresh = []
            for to in (0, 1):
                via = [best[0] + (stay if to == 0 else turn), best[1] + (stay if to == 1 else turn)]
                silent_before = via[1] > via[0]
                back[t, to] = np.where(silent_before, origin[1] + steps, origin[0])
                fresh.append(np.where(silent_before, via[1], via[0]) + seen[to][t])
            score = fresh
        state = int(np.argmax(np.concatenate(score)))
        out = np.zeros(frames, dtype=int)
        for t in range(frames - 1, -1, -1):
            out[t] = state if state < steps else -1
            state = int(back[t, state // steps, state % steps])
        return out

    def of(self, samples: np.ndarray) -> np.ndarray:
        """Pitch of each frame in Hz, NaN where unvoiced."""
        step = self.path(self.candidates(samples))
        return np.where(step < 0, np.nan, self.low * 2 ** (step / (12 * self.per_semitone)))


def pitch_variance(samples: np.ndarray, rate: int) -> float:
    """Variance of the pitch of the voiced frames, in Hz squared; 0 where none is voiced."""
    if not len(samples):
        return 0.0
    pitch = _track(rate).of(samples)
    heard = pitch[~np.isnan(pitch)]
    return float(heard.var()) if len(heard) else 0.0


@lru_cache(maxsize=8)
def _track(rate: int) -> PitchTrack:
    return PitchTrack(rate)


def window_features(samples: np.ndarray, rate: int, window: float = 5.0, hop: float = 2.5, pitch_every: int = 5) -> dict[str, np.ndarray]:
    """Means of the frame features in each window, and ``start``, its first frame.

    The variance of pitch is measured in every ``pitch_every``-th window and lies on a line between;
    after the last measured one it is 0.
    """
    found, y = frame_features(samples, rate), np.asarray(samples)
    wide, step = int(window * rate / 512), max(1, int(hop * rate / 512))
    starts = np.arange(0, max(0, len(found["rms"]) - wide + 1), step)
    sums = {n: np.concatenate([[0.0], np.cumsum(v)]) for n, v in found.items()}
    out = {n: (s[starts + wide] - s[starts]) / wide for n, s in sums.items()}
    asked = np.arange(0, len(starts), pitch_every)
    told = [pitch_variance(y[starts[k] * 512 : starts[k] * 512 + int(window * rate)], rate) for k in asked]
    pitch = np.interp(np.arange(len(starts)), asked, told) if len(asked) else np.zeros(0)
    if len(asked):
        pitch[asked[-1] + 1 :] = 0.0
    return out | {"pitch_var": pitch, "start": starts}


def sound_windows(recordings: DataFrame, window: float = 5.0, hop: float = 2.5, pitch_every: int = 5) -> DataFrame:
    """``path, chunk, k, time`` and the means of frame features for every window of recordings.

    ``recordings`` is as :func:`crestline.sources.tables.read_wav` gives it: chunks that go on for a window's length into
    the next one, so that no window is lost at a seam.  Of windows that two chunks hold the earlier chunk's count; which these are
    follows from the chunks' lengths, so chunks are read apart.
    """
    names = ["rms", "zcr", "centroid", "flux", "onset", "pitch_var"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, chunk, offset, before, rate, samples in batch[["path", "chunk", "offset", "before", "rate", "samples"]].itertuples(index=False):
                found = window_features(np.asarray(samples), rate, window, hop, pitch_every)
                time, last = offset + found["start"] * 512 / rate, -1.0
                wide, step = int(window * rate / 512), max(1, int(hop * rate / 512))
                if chunk and (frames := before // 512 + 1) >= wide:  # `before`: samples of the chunk before
                    last = offset * (chunk - 1) / chunk + (frames - wide) // step * step * 512 / rate
                new = time > last
                rows = {n: found[n][new] for n in names} | {"k": np.arange(len(time))[new], "time": time[new]}
                yield pd.DataFrame({"path": path, "chunk": chunk} | rows)

    schema = "path string, chunk int, k int, time double, " + ", ".join(f"{n} double" for n in names)
    return recordings.mapInPandas(read, schema)


def decoded_frames(chunks: DataFrame, rate: int = 11025) -> DataFrame:
    """``job_id, chunk, i`` and features for every frame of chunks of samples (``samples array<float>``)."""
    names = ["rms", "zcr", "centroid", "flux", "onset"]
    kind = chunks.schema["job_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job, chunk, samples in batch[["job_id", "chunk", "samples"]].itertuples(index=False):
                found = frame_features(np.asarray(samples), rate)
                yield pd.DataFrame({"job_id": job, "chunk": chunk, "i": np.arange(len(found["rms"]))} | {n: found[n] for n in names})

    return chunks.select("job_id", "chunk", "samples").mapInPandas(read, f"job_id {kind}, chunk int, i long, " + ", ".join(f"{n} double" for n in names))
