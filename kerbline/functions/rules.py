"""Column functions of ingestion, depth, geometry, estimates and text forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("S1", "S2", "S3", "S4", "S5")
#: A measured depth with less confidence gives way to the proxy.
LEAST_DEPTH_CONFIDENCE = 0.4


# ---------------------------------------------------------------- boxes as JSON, in any of their forms


def _number(box: Column, *paths: str, default: float = 0.0) -> Column:
    """The first of these paths that holds a number other than 0, else the default."""
    return F.coalesce(*(F.nullif(F.try_variant_get(box, p, "double"), F.lit(0.0)) for p in paths), F.lit(default))


def severity_of(box: Column) -> Column:
    """Struct (level, value, confidence) of a variant: `severity` may be an object, a whole number (held to 1..5) or a text; else S1."""
    kind = F.schema_of_variant(F.try_variant_get(box, "$.severity", "variant"))
    text = F.try_variant_get(box, "$.severity", "string")
    inner = F.coalesce(*(F.nullif(F.try_variant_get(box, f"$.severity.{k}", "string"), F.lit("")) for k in ("severity_level", "level", "severity")), F.lit("S1"))
    number = F.concat(F.lit("S"), F.greatest(F.lit(1), F.least(F.lit(5), text.try_cast("int"))).cast("string"))
    raw = F.when(kind.startswith("OBJECT"), inner).when(kind == "BIGINT", number).when(kind == "STRING", F.when(text.startswith("S"), text).otherwise(F.concat(F.lit("S"), text)))
    level = F.when(raw.isin(*LEVELS), raw).otherwise("S1")
    sure = F.when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(box, "$.severity.severity_confidence", "double"), F.lit(1.0))).otherwise(1.0)
    return F.struct(level.alias("level"), F.substring(level, 2, 1).cast("int").alias("value"), sure.alias("confidence"))


def depth_of(box: Column) -> Column:
    """Struct (depth, confidence): from the object `depth`, else from the box itself."""
    inside = F.coalesce(F.schema_of_variant(F.try_variant_get(box, "$.depth", "variant")).startswith("OBJECT"), F.lit(False))

    def pick(inner: str, outer: str, default: float) -> Column:
        return F.coalesce(F.when(inside, F.try_variant_get(box, f"$.depth.{inner}", "double")).otherwise(F.try_variant_get(box, f"$.{outer}", "double")), F.lit(default))

    return F.struct(pick("depth_norm", "depth_estimate_cm", 0.0).alias("depth"), pick("depth_confidence", "depth_confidence", 1.0).alias("confidence"))


def geometry_of(box: Column) -> Column:
    """Struct (area, sharpness, contrast, compactness): zeros without an object `geometry`; the area in pixels goes before that in cm2."""
    return F.struct(
        _number(box, "$.geometry.surface_area_px", "$.geometry.surface_area_cm2").alias("area"),
        *(_number(box, f"$.geometry.{k}").alias(name) for k, name in (("edge_sharpness", "sharpness"), ("interior_contrast", "contrast"), ("mask_compactness", "compactness"))),
    )


# ---------------------------------------------------------------- depth and shape


def depth_confidence(mean: Column, deviation: Column) -> Column:
    return F.round(1 - F.least(F.when(mean > 0, deviation / mean).otherwise(0.0), F.lit(1.0)), 4)


def depth_norm(mean: Column, low: Column, high: Column) -> Column:
    """Place of the mean in the frame's range; a flat frame counts as one wide."""
    return F.round((mean - low) / F.when(high > low, high - low).otherwise(1.0), 4)


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(0.0)


def axis_ratio(compact: Column) -> Column:
    """Short by long axis of the ellipse with c = 4r / (1 + r)^2: the root at most 1; c is held to 0.01..1."""
    c = F.greatest(F.least(compact, F.lit(1.0)), F.lit(0.01))
    return ((4 - 2 * c) - F.sqrt((2 * c - 4) * (2 * c - 4) - 4 * c * c)) / (2 * c)


def depth_proxy(area: Column, compact: Column, frame_area: Column) -> Column:
    share = F.least(area / F.greatest(frame_area, F.lit(1)), F.lit(1.0))
    return F.least(F.greatest(share * (0.5 + 0.5 * compact), F.lit(0.0)), F.lit(1.0))


def depth_choice(lighting: Column, mask: Column, crop: Column, proxy: Column) -> Column:
    """Struct (method, depth, confidence) out of mask and crop, structs (depth, confidence) or null, and the proxy, a number or null.

    Low light leaves the proxy alone. Else the mask goes before the crop, and either gives way to a proxy where it is not sure enough.
    """

    def told(method: str, x: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), x["depth"].alias("depth"), x["confidence"].alias("confidence"))

    guess = F.when(proxy.isNotNull(), F.struct(F.lit("geometry_proxy").alias("method"), proxy.alias("depth"), F.lit(0.0).alias("confidence")))
    best = F.when(mask.isNotNull(), told("mask_region", mask)).otherwise(F.when(crop.isNotNull(), told("central_crop", crop)))
    sure = F.coalesce(best["confidence"] >= LEAST_DEPTH_CONFIDENCE, F.lit(False))
    return F.when(lighting == "low_light", guess).otherwise(F.when(sure, best).otherwise(F.coalesce(guess, best)))


# ---------------------------------------------------------------- estimates

# Seconds of an epoch at 640 pixels with the backbone frozen and in full, and of all that is not epochs.
FROZEN_S, FULL_S, OVERHEAD_S = 357.5, 546.7, 430.0


def gpu_hours(epochs: Column, width: Column, height: Column, frozen: Column, seeds: Column) -> Column:
    """Hours of a training run; one without epochs takes a quarter of an hour."""
    n_frozen = F.least(F.greatest(frozen, F.lit(0)), epochs)
    one = (n_frozen * FROZEN_S + (epochs - n_frozen) * FULL_S) * (width * height / (640 * 640)) + OVERHEAD_S
    return F.when(epochs <= 0, 0.25).otherwise(F.round(one * seeds / 3600.0, 2))


def batch_size(requested: Column, memory_gb: Column, pixels: Column) -> Column:
    """What was asked for, else by memory in steps, less for larger images, two at least."""
    base = F.when(memory_gb < 3.5, 2).when(memory_gb < 6, 4).when(memory_gb < 12, 8).when(memory_gb < 26, 16).when(memory_gb < 48, 24).otherwise(32)
    scale = F.least(F.lit(1.0), F.pow(640 / F.greatest(pixels, F.lit(1)), F.lit(2.0)))
    return F.when(requested > 0, requested).otherwise(F.greatest(F.lit(2), F.floor(base * scale))).cast("int")


def encoded(value: Column, log: bool) -> Column:
    return F.log10(value) if log else value


def decoded(position: Column, low: float, high: float, log: bool) -> Column:
    """The position held to its bounds, and out of logarithms."""
    a, b = (math.log10(low), math.log10(high)) if log else (low, high)
    held = F.least(F.greatest(position, F.lit(a)), F.lit(b))
    return F.pow(F.lit(10.0), held) if log else held


# ---------------------------------------------------------------- text forms


def ago(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    steps = ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"))
    out = F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago"))
    for below, unit, name in reversed(steps):
        out = F.when(s < below, F.concat(F.floor(s / unit).cast("string"), F.lit(f"{name} ago"))).otherwise(out)
    return F.when(seconds.isNull(), "—").otherwise(out)


def duration(seconds: Column) -> Column:
    """Seconds below a minute, else minutes and seconds; a dash for none or a negative time."""
    s = F.round(seconds).cast("long")
    out = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return F.when(seconds >= 0, out).otherwise("—")


def money(amount: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(F.floor(amount + 0.5), 0), F.lit(" RON")), F.lit("—"))


def percent(share: Column, digits: int = 0) -> Column:
    return F.coalesce(F.concat(F.format_string(f"%.{digits}f", share * 100), F.lit("%")), F.lit("—"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def deadline(text: Column, now: Column, hours: Column) -> Column:
    """A date, or a date and a time of day in either form; without one so many hours from now, 72 if none are told."""
    forms = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
    read = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
    later = now + F.make_dt_interval(hours=F.coalesce(hours, F.lit(72)).cast("int"))
    return F.when(text.isNull() | (text == ""), later).otherwise(read)


def host_path(path: Column, inside: str, outside: str) -> Column:
    """A path of the container as one of the host; other paths stay."""
    return F.when((path == inside) | path.startswith(inside + "/"), F.concat(F.lit(outside), F.substring(path, len(inside) + 1, 1 << 30))).otherwise(path)


# Names of countries in paths.
COUNTRIES = {
    "japan": "japan", "usa": "usa", "united states": "usa", "norway": "norway", "china-motorbike": "china", "china_motorbike": "china",
    "china": "china", "india": "india", "czech republic": "czech", "czech_republic": "czech", "czech": "czech",
}


def _country(token: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(token)), "(_train|_valid|_val|_test)$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "_txt$", ""), "^[ _-]+|[ _-]+$", "")
    names = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.coalesce(*(F.try_element_at(names, v) for v in (bare, F.replace(bare, F.lit("-"), F.lit(" ")), F.replace(bare, F.lit("_"), F.lit(" ")))))


def country_of(path: Column) -> Column:
    """The first directory that names a country, else the tag before __ of the file's name, else that name; `unknown` if none does."""
    parts = F.split(path, "/")
    folders = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), _country), lambda c: c.isNotNull())
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    tag = F.when(F.contains(stem, F.lit("__")), _country(F.substring_index(stem, "__", 1)))
    return F.coalesce(F.try_element_at(folders, F.lit(1)), tag, _country(stem), F.lit("unknown"))


def sun_elevation(lat: Column, lon: Column, at: Column) -> Column:
    """Degrees of the sun above the horizon by the NOAA closed form; at is UTC seconds since 1970."""
    day = F.pmod(at / 86400, F.lit(365.2425))
    g = 2 * math.pi / 365 * (F.floor(day) + (F.pmod(at, F.lit(86400)) / 3600 - 12) / 24)
    minutes = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    angle = F.radians((F.pmod(at, F.lit(86400)) / 60 + minutes + 4 * lon) / 4 - 180)
    y = F.radians(lat)
    return F.degrees(F.asin(F.sin(y) * F.sin(decl) + F.cos(y) * F.cos(decl) * F.cos(angle)))
