"""Scalar functions on columns: times, dates, colours, hashes, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(seconds: Column) -> Column:
    return F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")


def thousandths(x: Column) -> Column:
    """``x`` rounded to thousandths, halves away from zero, in plain arithmetic of doubles.

    ``round`` goes through a decimal number for every value, which costs more than all else where a join makes billions of rows.
    """
    scaled = F.abs(x * 1000)
    below = F.floor(scaled).cast("double")
    # From 2^52 on a double has no fraction; NaN and infinity stay too.
    near = F.when(scaled < 2.0**52, below + F.when(scaled - below >= 0.5, 1.0).otherwise(0.0)).otherwise(scaled) / 1000
    return F.when(x < 0, F.lit(0.0) - near).otherwise(near)


def clock(seconds: Column, pad_hours: bool = True) -> Column:
    """``HH:MM:SS`` (or ``H:MM:SS``), fractions cut off."""
    s = _whole(seconds)
    hours = F.floor(s / 3600).cast("long")
    return F.format_string(("%02d" if pad_hours else "%d") + ":%02d:%02d", hours, F.floor((s % 3600) / 60).cast("long"), s % 60)


def clock_centis(seconds: Column) -> Column:
    """``H:MM:SS.cc`` as subtitles write it, cut to hundredths."""
    c = F.floor(F.greatest(seconds, F.lit(0.0)) * 100 + 1e-6).cast("long")
    s = F.floor(c / 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60, c % 100)


def short_duration(seconds: Column) -> Column:
    """``XhMM`` from an hour on, else ``Mmin``."""
    m = F.floor(_whole(seconds) / 60).cast("long")
    return F.when(m >= 60, F.format_string("%dh%02d", F.floor(m / 60).cast("long"), m % 60)).otherwise(F.format_string("%dmin", m))


def minutes_seconds(seconds: Column) -> Column:
    """``m:ss``."""
    s = _whole(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def compact_date(text: Column) -> Column:
    """``YYYYMMDD`` to ``YYYY-MM-DD``; anything else is kept."""
    return F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def percent(share: Column) -> Column:
    """Whole percent."""
    return F.concat(F.round(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank or null text."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long")


def rate(n: Column, seconds: Column) -> Column:
    """``n`` a second, 0 without a duration."""
    return F.when(seconds > 0, F.try_divide(n, seconds)).otherwise(F.lit(0.0))


def slug_ascii(name: Column, ident: Column, most: int = 50) -> Column:
    """Lower-case ASCII slug with underscores and five hex digits of a hash of ``ident``.

    Accents are dropped by compatibility decomposition, for which Spark has no function.
    """

    def strip(names: pd.Series) -> pd.Series:
        return names.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    plain = F.pandas_udf(strip, "string")(name)
    slug = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.rtrim(F.substring(slug, 1, most), F.lit("_"))
    return F.concat_ws("_", F.when(slug == "", F.lit("clip")).otherwise(slug), F.substring(F.md5(ident.cast("string")), 1, 5))


def palette_index(name: Column, colours: int) -> Column:
    """Stable palette slot of a name: polynomial hash to base 31 in unsigned 32 bits."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296))) % colours


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb``."""
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])


def hex_channel(colour: Column, i: int) -> Column:
    """Channel 0, 1 or 2 of ``#rrggbb``."""
    return F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("long")


def tint(colour: Column, share: float) -> Column:
    """A colour mixed with white."""
    return rgb_hex(*[F.round(hex_channel(colour, i) + (255 - hex_channel(colour, i)) * share, 0) for i in range(3)])


def subtitle_colour(colour: Column) -> Column:
    """``#rrggbb`` as subtitle files write it: ``&H00BBGGRR``."""
    return F.concat(F.lit("&H00"), *[F.upper(F.substring(colour, s, 2)) for s in (6, 4, 2)])


def strip_fences(text: Column) -> Column:
    """Text without a surrounding Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def level_name(x: Column, steps: Sequence[tuple[float, str]], top: str) -> Column:
    """The first name whose bound exceeds ``x``."""
    out = F.when(x < steps[0][0], F.lit(steps[0][1]))
    for bound, name in steps[1:]:
        out = out.when(x < bound, F.lit(name))
    return out.otherwise(F.lit(top))


def label(x: Column, names: Mapping[str, str], default: str = "") -> Column:
    """Label of a category from a map."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(table, x), F.lit(default))


def progress(status: Column, order: Sequence[str]) -> Column:
    """Percent of the way through an ordered list of states; 0 for an unknown one."""
    return F.round(F.array_position(F.array(*map(F.lit, order)), status) * 100 / len(order), 0).cast("long")


def video_id(url: Column, site: str = "twitch.tv/videos/") -> Column:
    """Number in a video URL, null if it is none."""
    found = F.regexp_extract(url, site.replace(".", r"\.") + "([0-9]+)", 1)
    return F.when(found != "", found)


def safe_name(text: Column) -> Column:
    """The text without characters that file names must not have."""
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]", "")


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def _clamped(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t.cast("double")))


def _power(kind: str, n: int):
    def ease(t: Column) -> Column:
        if kind == "In":
            return F.pow(t, F.lit(n))
        if kind == "Out":
            return 1 - F.pow(1 - t, F.lit(n))
        return F.when(t < 0.5, F.pow(2 * t, F.lit(n)) / 2).otherwise(1 - F.pow(2 - 2 * t, F.lit(n)) / 2)

    return ease


def _bounce(t: Column) -> Column:
    # Four parabolas of one curvature: where each ends and its centre, in parts of 2.75, and its floor.
    pieces = ((1.0, 0.0, 0.0), (2.0, 1.5, 0.75), (2.5, 2.25, 0.9375), (None, 2.625, 0.984375))
    out = None
    for end, centre, floor in pieces:
        y = 7.5625 * (t - centre / 2.75) * (t - centre / 2.75) + floor
        if end is None:
            return out.otherwise(y)
        out = F.when(t < end / 2.75, y) if out is None else out.when(t < end / 2.75, y)
    return out


def _elastic(t: Column) -> Column:
    wave = -F.pow(F.lit(2.0), 10 * t - 10) * F.sin((10 * t - 10.75) * F.lit(2 * 3.141592653589793 / 3))
    return F.when((t == 0) | (t == 1), t).otherwise(wave)


#: Easing curves by name.
EASINGS = {
    "linear": lambda t: t,
    **{f"ease{k}": _power(k, 2) for k in ("In", "Out", "InOut")},
    **{f"ease{k}.power{n}": _power(k, n) for n in (3, 4) for k in ("In", "Out", "InOut")},
    "bounce": _bounce,
    "elastic": _elastic,
}


def eased(name: str, t: Column) -> Column:
    """The named curve at ``t``, which is clamped to 0..1; an unknown name leaves ``t`` as it is."""
    return EASINGS[name](_clamped(t)) if name in EASINGS else t


def eased_by(column: Column, t: Column) -> Column:
    """The curve that a column names."""
    out = None
    for name in EASINGS:
        out = F.when(column == name, eased(name, t)) if out is None else out.when(column == name, eased(name, t))
    return out.otherwise(t)


def utc_now(at: Column | None = None) -> Column:
    """A moment, by default the query's, as ISO text in UTC."""
    at = F.current_timestamp() if at is None else at
    return utc_stamp(F.unix_seconds(at.cast("timestamp")))


def utc_stamp(seconds: Column) -> Column:
    """Whole seconds since 1970 as ISO text in UTC; years beyond 9999 have more digits and no sign.

    Dates reach further than timestamps, so seconds beyond the last timestamp are told as well.
    """
    day, rest = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    clock = [F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60]
    text = F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", F.year(day), F.month(day), F.day(day), *[x.cast("int") for x in clock])
    return F.when(seconds.isNotNull(), text)


def random_id(length: int = 32) -> Column:
    """A random hexadecimal id; another one at every evaluation, so write it before it is read twice."""
    return F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, length)
