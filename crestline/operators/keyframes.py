"""Keyframes and animations of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.scalars import eased, eased_by, lerp


def resolve_keyframes(frames: Column, t: Column, properties: Sequence[str]) -> Column:
    """Struct of the properties at time ``t`` from an array of keyframes (``time, easing, ...``).

    Keyframes are taken in time order; before the first and after the last their values hold;
    between two, the easing of the later one shapes the way.  Null without keyframes.
    """
    ordered = F.array_sort(frames, lambda a, b: F.when(a["time"] < b["time"], -1).when(a["time"] > b["time"], 1).otherwise(0))
    before = F.filter(ordered, lambda k: k["time"] <= t)
    after = F.filter(ordered, lambda k: k["time"] > t)
    lo, hi = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    share = eased_by(hi["easing"], F.try_divide(t - lo["time"], hi["time"] - lo["time"]))
    held = F.coalesce(lo, hi)
    return F.when(
        F.size(frames) > 0,
        F.struct(*[F.when(lo.isNull() | hi.isNull(), held[p]).otherwise(lerp(lo[p], hi[p], share)).alias(p) for p in properties]),
    )


def has_keyframe(frames: Column, t: Column, tolerance: float = 0.15) -> Column:
    """Whether a keyframe is at most ``tolerance`` away."""
    return F.coalesce(F.exists(frames, lambda k: F.abs(k["time"] - t) <= tolerance), F.lit(False))


def find_keyframe(frames: Column, t: Column, tolerance: float = 0.15) -> Column:
    """The first keyframe at most ``tolerance`` away."""
    return F.try_element_at(F.filter(frames, lambda k: F.abs(k["time"] - t) <= tolerance), F.lit(1))


def upsert_keyframe(frames: Column, new: Column, tolerance: float = 0.15) -> Column:
    """Replace the first keyframe less than ``tolerance`` away, else insert; by time."""
    spot = F.array_position(F.transform(frames, lambda k: F.abs(k["time"] - new["time"]) < tolerance), True)
    replaced = F.transform(frames, lambda k, i: F.when(i + 1 == spot, new).otherwise(k))
    return F.array_sort(
        F.when(spot > 0, replaced).otherwise(F.array_append(frames, new)),
        lambda a, b: F.when(a["time"] < b["time"], -1).when(a["time"] > b["time"], 1).otherwise(0),
    )


def compose_animations(animations: Column, t: Column, clip: Column, fades: tuple[Column, Column] | None = None) -> Column:
    """Opacity, scale and shift of a layer at ``t`` from its animations.

    An animation has ``begin, duration, easing`` and, from and to, ``opacity, scale, x`` and ``y``.
    Before it the layer is at its from-state, during it on an eased way, after it at its to-state.
    Opacities and scales multiply, shifts add; ``fades`` are seconds of a plain fade in and out.
    """
    def at(a: Column, name: str) -> Column:
        raw = F.try_divide(t - a["begin"], a["duration"])
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.when(t >= a["begin"], 1.0).otherwise(0.0))))
        return lerp(a[f"{name}_from"], a[f"{name}_to"], eased_by(a["easing"], share))

    start = F.struct(F.lit(1.0).alias("opacity"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    state = F.aggregate(
        animations,
        start,
        lambda s, a: F.struct(
            (s["opacity"] * at(a, "opacity")).alias("opacity"), (s["scale"] * at(a, "scale")).alias("scale"),
            (s["x"] + at(a, "x")).alias("x"), (s["y"] + at(a, "y")).alias("y"),
        ),
    )
    opacity = state["opacity"]
    if fades is not None:
        rise = F.when(fades[0] > 0, F.least(F.lit(1.0), F.try_divide(t, fades[0]))).otherwise(1.0)
        fall = F.when(fades[1] > 0, F.least(F.lit(1.0), F.try_divide(clip - t, fades[1]))).otherwise(1.0)
        opacity = opacity * rise * fall
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), opacity)).alias("opacity"), state["scale"].alias("scale"), state["x"].alias("x"), state["y"].alias("y"))


def easing_table(points: DataFrame, t: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every named curve at every point, which ``keys`` tell apart."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("easing"), eased(n, F.col(t)).alias("value")) for n in names]))
    return points.select(*keys, t, pairs.alias("e")).select(*keys, t, "e.easing", "e.value")
