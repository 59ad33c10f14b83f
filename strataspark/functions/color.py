"""Colour indices and the vegetation mask, in single precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _f(x) -> Column:
    return x.cast("float")


def ndvi(red: Column, nir: Column) -> Column:
    r, n = _f(red), _f(nir)
    total = _f(n + r)
    return F.when(total > 0, _f(_f(n - r) / total)).otherwise(F.lit(0.0).cast("float"))


def vari(red: Column, green: Column, blue: Column) -> Column:
    r, g, b = _f(red), _f(green), _f(blue)
    below = _f(_f(g + r) - b)
    ratio = _f(_f(g - r) / below)
    value = F.when(F.abs(below) > F.lit(1e-6).cast("float"), ratio).otherwise(F.lit(0.0).cast("float"))
    return F.greatest(F.least(value, F.lit(2.0).cast("float")), F.lit(-2.0).cast("float"))


def exg(red: Column, green: Column, blue: Column) -> Column:
    return _f(_f(F.lit(2.0).cast("float") * _f(green) - _f(red)) - _f(blue))


def has_bands(points: DataFrame, *bands: str) -> bool:
    """Whether all ``bands`` are columns that hold a value; readers give absent bands as null columns."""
    if not all(b in points.columns for b in bands):
        return False
    optional = [b for b in bands if points.schema[b].nullable]
    # a band without values is seen on any row that has all: one row is read where bands are there
    return not optional or not points.select(*optional).dropna("any").isEmpty()


def vegetation_mask(points: DataFrame, index: str = "auto", *, ndvi_threshold=0.20, vari_threshold=0.15, exg_threshold=15.0) -> tuple[Column | None, str]:
    """(mask, index used). Auto takes NDVI with red and NIR, else VARI with RGB; otherwise (None, "unavailable")."""
    red, green, blue, nir = (F.col(c) for c in ("red", "green", "blue", "nir"))
    over = lambda x, t: x > F.lit(t).cast("float")
    if index in ("auto", "ndvi") and has_bands(points, "red", "nir"):
        return over(ndvi(red, nir), ndvi_threshold), "ndvi"
    if index in ("auto", "vari", "exg") and has_bands(points, "red", "green", "blue"):
        if index == "exg":
            return over(exg(red, green, blue), exg_threshold), index
        return over(vari(red, green, blue), vari_threshold), "vari"
    return None, "unavailable"
