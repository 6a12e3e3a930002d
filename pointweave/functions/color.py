"""Color conversions and value-to-color transfer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_from_byte(c) -> Column:
    return c / 255.0


def byte_from_unit(c) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255.0).cast("int")


def transfer(value, stops):
    """Piecewise-linear map from a value to (r, g, b).

    ``stops`` is an ascending list of ``(value, (r, g, b))``; values outside
    the list take the color of the nearest stop.
    """
    result = []
    for channel in range(3):
        expr = F.when(value <= stops[0][0], F.lit(float(stops[0][1][channel])))
        for (v0, c0), (v1, c1) in zip(stops, stops[1:]):
            t = (value - v0) / (v1 - v0)
            expr = expr.when(value <= v1, c0[channel] + (c1[channel] - c0[channel]) * t)
        result.append(expr.otherwise(F.lit(float(stops[-1][1][channel]))))
    return tuple(result)


HEAT = [(0.0, (0.0, 0.0, 1.0)), (0.5, (0.0, 1.0, 0.0)), (1.0, (1.0, 0.0, 0.0))]


def orientation(nx, ny, nz):
    """Axis and angle that turn +Z onto the normal (identity when too short)."""
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    usable = size > 1e-4
    ux, uy, uz = (F.when(usable, c / size).otherwise(F.lit(d)) for c, d in ((nx, 0.0), (ny, 0.0), (nz, 1.0)))
    flat = F.sqrt(ux * ux + uy * uy)
    turning = flat > 1e-4
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), uz)))
    axis_x = F.when(turning, -uy / flat).otherwise(F.lit(1.0))
    axis_y = F.when(turning, ux / flat).otherwise(F.lit(0.0))
    turn = F.when(turning, angle).when(uz < -0.9, F.lit(3.141592653589793)).otherwise(F.lit(0.0))
    return axis_x, axis_y, F.lit(0.0), turn
