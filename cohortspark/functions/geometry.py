"""Column functions on directions, grids and intensities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions import fixed
from cohortspark.functions.text import let


def _plane_of(values: Column) -> Column:
    """Plane of the normal of two direction vectors, given as at least six numbers."""
    a, b = [values[i] for i in range(3)], [values[i] for i in range(3, 6)]
    normal = F.array(
        F.abs(a[1] * b[2] - a[2] * b[1]),
        F.abs(a[2] * b[0] - a[0] * b[2]),
        F.abs(a[0] * b[1] - a[1] * b[0]),
    )
    names = F.array(F.lit("SAGITTAL"), F.lit("CORONAL"), F.lit("AXIAL"))
    return let(
        normal,
        lambda n: F.when(F.array_max(n) < 0.8, "OBLIQUE").otherwise(
            F.get(names, F.array_position(n, F.array_max(n)).cast("int") - 1)
        ),
    )


def scan_plane_from_iop(text: Column) -> Column:
    """Plane from six backslash-separated numbers; NULL where the text does not hold six numbers."""
    return let(
        F.transform(F.split(text, r"\\"), lambda v: v.try_cast("double")),
        lambda n: F.when((F.size(n) == 6) & ~F.exists(n, lambda v: v.isNull()), _plane_of(n)),
    )


def scan_plane_from_text(description: Column) -> Column:
    def first_word(text):
        plane = F.when(F.lit(False), F.lit(None))
        for word, name in fixed.PLANE_WORDS:
            plane = plane.when(text.contains(word), name)
        return plane.otherwise("AXIAL")

    return let(F.upper(description), first_word)


def detect_scan_plane(orientation: Column, description: Column) -> Column:
    return F.coalesce(scan_plane_from_iop(orientation), scan_plane_from_text(description))


def scan_plane_from_direction(direction: Column) -> Column:
    return F.when(F.size(direction) >= 9, _plane_of(direction)).otherwise("AXIAL")


def direction_to_string(direction: Column) -> Column:
    text = F.array_join(F.transform(F.slice(direction, 1, 6), lambda v: F.format_string("%.6f", v)), "\\")
    return F.when(F.size(direction) > 0, text)


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def window_rescale(hu: Column, low: float = -200.0, high: float = 300.0) -> Column:
    """Clip to the window, then to [-1, 1]."""
    return 2.0 * (clip(hu, low, high) - low) / (high - low) - 1.0


def window_to_display(value: Column, low: float = -200.0, high: float = 300.0) -> Column:
    """[-1, 1] back to intensities, then to [0, 1]."""
    hu = (value + 1.0) / 2.0 * (high - low) + low
    return clip((hu - low) / (high - low), 0.0, 1.0)


def hu_to_display(hu: Column, low: float = -150.0, high: float = 250.0) -> Column:
    return (clip(hu, low, high) - low) / (high - low)
