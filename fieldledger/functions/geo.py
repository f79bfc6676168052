"""Equirectangular distance and box predicates as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MILES_PER_DEGREE = 69.0
SITE_LATITUDE = 37.7  # reference latitude of distances between sites
HOME_LATITUDE = 37.5  # reference latitude of the distance from home


def lon_miles(at: float = SITE_LATITUDE) -> float:
    return MILES_PER_DEGREE * math.cos(math.radians(at))


def miles(lat1, lon1, lat2, lon2, at: float = SITE_LATITUDE) -> Column:
    return F.hypot(
        (F.col(lat1) - F.col(lat2) if isinstance(lat1, str) else lat1 - lat2) * F.lit(MILES_PER_DEGREE),
        (F.col(lon1) - F.col(lon2) if isinstance(lon1, str) else lon1 - lon2) * F.lit(MILES_PER_DEGREE) * F.cos(F.radians(F.lit(at))),
    )


def in_ring(ring: str, lat: str, lon: str) -> Column:
    """Even-odd rule over an array<struct(lon, lat)> without the repeated last point."""
    return F.expr(
        f"""size({ring}) > 2 AND size(filter(zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)),
              (p, q) -> ((p.lat > {lat}) <> (q.lat > {lat}))
                        AND {lon} < (q.lon - p.lon) * ({lat} - p.lat) / nullif(q.lat - p.lat, 0D) + p.lon), hit -> hit)) % 2 = 1"""
    )


def ring_meets_box(ring: str, lo_lat: str, lo_lon: str, hi_lat: str, hi_lon: str) -> Column:
    """True if some edge of the ring may touch the box: the edge's own box overlaps it."""
    return F.expr(
        f"""exists(zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)),
              (p, q) -> least(p.lat, q.lat) <= {hi_lat} AND greatest(p.lat, q.lat) >= {lo_lat}
                        AND least(p.lon, q.lon) <= {hi_lon} AND greatest(p.lon, q.lon) >= {lo_lon}), hit -> hit)"""
    )
