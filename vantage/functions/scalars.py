"""Scalar functions over columns: hashes and seeds, identifiers and urls, prompts, camera angles, clipping and relevancy."""

from __future__ import annotations

import hashlib
import uuid as _uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- hashes and seeds ---------------------------------------------------------------------------------------------


def sha1_text(x) -> Column:
    return F.sha1(_c(x).cast("binary"))


def sha256_content(x) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def derive_seed(*parts) -> Column:
    """SHA-1 of the joined parts as a 160-bit number modulo 2^32 - 1: as 2^32 = 1 there, the sum of its five words."""
    h = F.sha1(F.concat(*(_c(p).cast("binary") for p in parts)))
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(5)]
    return (words[0] + words[1] + words[2] + words[3] + words[4]) % F.lit(2**32 - 1)


def uniform(seed, key) -> Column:
    """Uniform double in [0, 1) from 52 bits of MD5 of seed|key."""
    text = F.concat_ws("|", _c(seed).cast("string"), _c(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniforms(texts: Iterable[str]) -> np.ndarray:
    """uniform of texts seed|key, within a Python function."""
    digests = b"".join(hashlib.md5(t.encode()).digest() for t in texts)  # noqa: S324
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)) / float(1 << 52)


def rounded(x) -> Column:
    """F.round(x, 6) of doubles, of which only those near a tie, and those of a million or more, are rounded by decimal
    digits; the others are so many millionths, with the same result at a fraction of the time."""
    x = _c(x)
    y = x * F.lit(1e6)
    plain = (F.abs(x) < F.lit(1e6)) & (F.abs(y - F.floor(y) - F.lit(0.5)) > F.lit(1e-4))
    return F.when(plain, F.floor(y + F.lit(0.5)) / F.lit(1e6)).otherwise(F.round(x, 6))


def cache_key(*lists) -> Column:
    """SHA-1 over sorted string lists, each item followed by a zero byte."""
    parts = [F.array_join(F.transform(F.array_sort(_c(x)), lambda s: F.concat(s, F.lit("\0"))), "") for x in lists]
    return F.sha1(F.concat(*parts).cast("binary"))


def uuid5_dns(x) -> Column:
    """Name-based identifier, version 5, in the DNS name space."""
    space = F.unhex(F.lit(_uuid.NAMESPACE_DNS.hex))
    h = F.sha1(F.concat(space, _c(x).cast("binary")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def render_cache_key(model_file, image_file) -> Column:
    return F.concat(stem(model_file), F.lit("_"), stem(image_file))


def prompt_cache_key(text) -> Column:
    return F.concat(F.lit("prompt_"), sha1_text(text))


def stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


# --- names, urls, files -------------------------------------------------------------------------------------------


def display_name(category, name) -> Column:
    return F.coalesce(_c(name), _c(category))


def prompt(category, name=None) -> Column:
    """'a photo of a {name}.' with underscores as spaces."""
    x = display_name(category, name) if name is not None else _c(category)
    return F.concat(F.lit("a photo of a "), F.replace(x, F.lit("_"), F.lit(" ")), F.lit("."))


def frame_name(index, prefix: str = "frame_", suffix: str = ".png") -> Column:
    """One-based number of five digits."""
    n = (_c(index) + 1).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n), F.lit(suffix))


def path_part(url, i: int) -> Column:
    """Part i (from 0) between slashes; null if there is none."""
    return F.get(F.split(_c(url), "/"), i)


def repo_id(url) -> Column:
    """Organisation/repository@commit of a blob url."""
    return F.concat(path_part(url, 3), F.lit("/"), path_part(url, 4), F.lit("@"), path_part(url, 6))


def last_part(url) -> Column:
    return F.element_at(F.split(_c(url), "/"), -1)


def query_value(url, key: str) -> Column:
    return F.regexp_extract(_c(url), rf"[?&]{key}=([^&#]*)", 1)


def replace_prefix(url, old: str, new: str) -> Column:
    u = _c(url)
    return F.when(u.startswith(old), F.concat(F.lit(new), F.substring(u, len(old) + 1, 1 << 30))).otherwise(u)


def strip_suffix(x, suffix: str = ".glb") -> Column:
    x = _c(x)
    return F.when(x.endswith(suffix), F.left(x, F.length(x) - len(suffix))).otherwise(x)


#: Fixed list of file types that hold 3-D objects.
OBJECT_TYPES = (".obj", ".glb", ".gltf", ".usdz", ".usd", ".fbx", ".stl", ".usda", ".dae", ".ply", ".abc", ".blend")


def is_object_file(path, types=OBJECT_TYPES) -> Column:
    low = F.lower(_c(path))
    out = F.lit(False)
    for t in types:
        out = out | low.endswith(t)
    return out


def to_scalar(x) -> Column:
    """The value as a double, null where it is no number."""
    return F.expr(f"try_cast(`{x}` AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")


# --- numbers ------------------------------------------------------------------------------------------------------


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def interpolate(x, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Piecewise-linear between two points, flat outside."""
    return F.lit(y0) + (clip(x, x0, x1) - x0) / (x1 - x0) * (y1 - y0)


def stride_scale(tile_ratio, stride_scaler: float) -> Column:
    return interpolate(tile_ratio, 0.05, 1.0, 0.15, stride_scaler)


def is_finite(x) -> Column:
    v = _c(x)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def fov_y(fov_x_degrees, width, height) -> Column:
    """Vertical angle of view in degrees."""
    half = F.tan(F.radians(_c(fov_x_degrees)) / 2) * _c(height) / _c(width)
    return F.degrees(2 * F.atan(half))


def focal_length(fov_degrees, size) -> Column:
    """In pixels."""
    return 0.5 * _c(size) / F.tan(0.5 * F.radians(_c(fov_degrees)))


def relevancy_to(positive, negative, temperature: float = 10.0) -> Column:
    """Softmax weight of the positive against one negative."""
    return 1.0 / (1.0 + F.exp(temperature * (_c(negative) - _c(positive))))


def opacity(density) -> Column:
    """1 - exp(-density), NaN as 0."""
    return F.nanvl(1.0 - F.exp(-_c(density)), F.lit(0.0))


def composite(relevancy, largest) -> Column:
    """Clipped relevancy over its maximum."""
    return clip(_c(relevancy) - 0.5, 0.0, 1.0) / (_c(largest) + 1e-6)


def huber(error, delta: float = 1.25) -> Column:
    e = F.abs(_c(error))
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
