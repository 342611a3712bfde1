"""Scalar functions on columns: inflow, pressure, profiles, tapers, clips."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(*components: Column) -> Column:
    """Length of a vector, from its components."""
    return F.sqrt(sum((c * c for c in components[1:]), components[0] * components[0]))


def polar_to_components(angle: Column, size: Column) -> tuple[Column, Column]:
    """x and y of a vector whose angle is in degrees, counter-clockwise from +x."""
    return size * F.cos(F.radians(angle)), size * F.sin(F.radians(angle))


def components_to_angle(x: Column, y: Column) -> Column:
    """Angle of a vector in degrees, counter-clockwise from +x."""
    return F.degrees(F.atan2(y, x))


#: Velocity from angle and speed, and the pressure gradient from angle and size, follow one rule.
angle_to_velocity = angle_to_pressure_gradient = polar_to_components
velocity_to_angle = pressure_gradient_to_angle = components_to_angle


def pressure_gradient_consistent(angle: Column, u: Column, v: Column, dpdx: Column, dpdy: Column, tolerance: float = 0.01) -> Column:
    """Whether velocity has the angle, and pressure gradient and velocity the same ratio of components.

    The ratio is judged, relative to the larger one, only where neither y component vanishes.
    """
    ratio_v, ratio_p = u / F.nullif(v, F.lit(0.0)), dpdx / F.nullif(dpdy, F.lit(0.0))
    judged = (F.abs(v) > 1e-10) & (F.abs(dpdy) > 1e-10)
    larger = F.nullif(F.greatest(F.abs(ratio_v), F.abs(ratio_p)), F.lit(0.0))
    ratio_fits = F.when(judged, F.coalesce(F.abs(ratio_v - ratio_p) / larger < tolerance, F.lit(False))).otherwise(F.lit(True))
    return ratio_fits & (F.abs(components_to_angle(u, v) - angle) < tolerance)


def profile_shape(z: Column, kind: str, *, alpha: float = 0.25, z_ref: Column | float = 1.0, z_0: float = 0.0) -> Column:
    """Vertical shape of an inflow: ``uniform`` is 1, ``power_law`` is (max(z, z_0) / z_ref) ** alpha."""
    if kind not in PROFILES:
        raise ValueError(f"unknown profile {kind!r}; there are {sorted(PROFILES)}")
    return PROFILES[kind](z, alpha, z_ref, z_0)


#: Builders of profile shapes; register another by adding to it.
PROFILES = {
    "uniform": lambda z, alpha, z_ref, z_0: F.when(z.isNotNull(), F.lit(1.0)),
    "power_law": lambda z, alpha, z_ref, z_0: F.pow(F.greatest(z, F.lit(float(z_0))) / z_ref, F.lit(float(alpha))),
}


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """``value`` within bounds; a bound that is None does not bind."""
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    return value if high is None else F.least(value, F.lit(float(high)))


def control_points(values: list[float] | float, position: Column) -> Column:
    """A profile given by evenly spaced control points over [0, 1], linear between them, at ``position``."""
    if not isinstance(values, (list, tuple)):
        return F.when(position.isNotNull(), F.lit(float(values)))
    if len(values) == 1:
        return F.when(position.isNotNull(), F.lit(float(values[0])))
    points, last = F.array(*[F.lit(float(v)) for v in values]), len(values) - 1
    at = clip(position, 0, 1) * last
    low = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    a, b = F.get(points, low), F.get(points, low + 1)
    return a + (b - a) * (at - low)


def control_mean(values: list[float] | float) -> float:
    """The scalar that stands for a profile: the mean of its control points."""
    return float(values) if not isinstance(values, (list, tuple)) else math.fsum(values) / len(values)


def taper_inflation(distance: Column, radius: Column | float, beta: float, most: float) -> Column:
    """Inflation of the observation error with distance: 1 up to ``beta * radius``, growing to
    ``most`` at ``radius``; null (excluded) beyond. ``most`` of 1 does not taper."""
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    flat = radius * beta
    width = (radius - flat) / math.sqrt(math.log(most)) if most > 1 else None
    rise = F.lit(1.0) if width is None else F.when(width > 0, F.exp(F.pow((distance - flat) / F.nullif(width, F.lit(0.0)), 2))).otherwise(F.lit(1.0))
    return F.when(distance <= flat, F.lit(1.0)).when(distance <= radius, rise)


def default_truncation(members: Column) -> Column:
    """The correlation below which sampling noise rules, for an ensemble of that size."""
    return F.least(F.lit(3.0) / F.sqrt(members), F.lit(0.99))


def relaxation_weight(time: Column, start: Column, length: float) -> Column:
    """How much of the last window's end is left at ``time``."""
    return F.exp(-(time - start) / max(length, 1e-6))


def base_name(name: Column) -> Column:
    """A flattened parameter's name without its knot number."""
    return F.regexp_replace(name, r"_\d+$", "")


def snap(height: Column, step: float, floor: float = 0.0) -> Column:
    """Heights over ``floor`` as whole multiples of ``step``, halves to even."""
    return F.rint(F.greatest(height - floor, F.lit(0.0)) / step) * step


def z_score(x: Column, mean: Column, std: Column, least: float | None = None) -> Column:
    """Standardised value; a spread of 0 counts as 1, or any below ``least`` as that."""
    safe = F.when(std > 0, std).otherwise(F.lit(1.0)) if least is None else F.greatest(std, F.lit(least))
    return (x - mean) / safe


def lapse_profile(level: Column, surface: float, lapse: float, height: float, levels: int) -> Column:
    """A temperature that changes by the same step from each level to the next."""
    return F.lit(surface) + level * (lapse * height / levels)


def nudged_levels(z: Column, height: float) -> Column:
    """Aggregate: how many levels lie below ``height``; all of them is an error."""
    below = F.count_if(z < height)
    return F.when(below >= F.count(z), F.raise_error(F.lit("no level lies above the nudging height"))).otherwise(below)


#: Kinds of forcing, and the column that each gives a value to: fixed values.
FORCINGS = {"pressure": "dpdx", "flow_rate": "u_flow", "profile": "u_geo", "coriolis": "coriolis"}


def forcing_columns(kinds: Column, value: Column) -> dict[str, Column]:
    """A run's forcing as columns, 0 but for the one kind that ``kinds`` (an array of names) has.

    More than one kind, or one that is not known, is an error; none leaves all 0.
    """
    known = F.array(*[F.lit(k) for k in FORCINGS])
    bad = F.when(F.size(kinds) > 1, F.raise_error(F.lit("more than one kind of forcing"))).when(
        F.size(F.array_except(kinds, known)) > 0, F.raise_error(F.lit("unknown kind of forcing"))
    )
    return {c: F.when(F.array_contains(kinds, k), value).otherwise(F.coalesce(bad.cast("double"), F.lit(0.0))) for k, c in FORCINGS.items()}
