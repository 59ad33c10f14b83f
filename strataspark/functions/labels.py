"""Class codes and the CASE chain that assigns them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class codes.
UNCLASSIFIED, GROUND, LOW_VEG, MED_VEG, HIGH_VEG, BUILDING, LOW_NOISE, KEY_POINT, PROBABLE_GROUND, BIRD = 1, 2, 3, 4, 5, 6, 7, 8, 12, 20


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite (NaN sorts above all numbers here, unlike in most tools)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def ground_mask(nz: Column, threshold: float) -> Column:
    return finite(nz) & (F.abs(nz) <= threshold)


def base_label(ground: Column) -> Column:
    return F.when(ground, GROUND).otherwise(UNCLASSIFIED).cast("short")


def source_ground(classification: Column) -> Column:
    return classification.isin(GROUND, KEY_POINT)


def height_label(label: Column, nz: Column, *, threshold: float, low_min=0.10, low_max=1.00, med_max=3.00, noise=-0.10, probable_band=0.0, protected=(GROUND, BIRD), vegetation=True) -> Column:
    """Probable ground first, then low noise, then vegetation bands; protected classes stay."""
    free = ~label.isin(*protected) & finite(nz)
    cases = []
    if probable_band > 0:
        cases.append((F.abs(nz) <= threshold + probable_band, PROBABLE_GROUND))
    cases.append((nz <= noise, LOW_NOISE))
    if vegetation:
        cases += [((nz >= low_min) & (nz < low_max), LOW_VEG), ((nz >= low_max) & (nz < med_max), MED_VEG), (nz >= med_max, HIGH_VEG)]
    chain = reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(*cases[0])).otherwise(label)
    return F.when(free, chain).otherwise(label).cast("short")


def bird_candidate(nz: Column, ground: Column, nz_min: float, nz_max: float) -> Column:
    return finite(nz) & (nz >= nz_min) & (nz <= nz_max) & ~ground


def tile_status(clusters: Column, written: Column, error: Column) -> Column:
    """SKIPPED on an error or without clusters, WRITE_FAILED if nothing was written, else PROCESSED."""
    return F.when(error.isNotNull(), "SKIPPED").when(clusters == 0, "SKIPPED").when(~written, "WRITE_FAILED").otherwise("PROCESSED")
