"""Equal-area pixels of the sphere as a closed-form column expression (Gorski et al. 2005, ring order)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_pixel(lat: Column, lon: Column, nside: int) -> Column:
    """Index of the pixel, from the north pole on, in rings of constant latitude."""
    z = F.sin(F.radians(lat))
    t = F.pmod(F.radians(lon), F.lit(2 * math.pi)) / (math.pi / 2)
    za = F.abs(z)
    # the belt between the caps: ascending and descending edge lines
    up, down = F.floor(nside * (0.5 + t) - nside * z * 0.75), F.floor(nside * (0.5 + t) + nside * z * 0.75)
    ring = nside + 1 + up - down
    shift = 1 - ring % 2
    inner = F.floor((up + down - nside + shift + 1) / 2) % (4 * nside)
    belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + F.pmod(inner, F.lit(4 * nside))
    # a cap: rings of four times their number
    part = t - F.floor(t)
    reach = nside * F.sqrt(3 * (1 - za))
    k = F.floor(part * reach) + F.floor((1 - part) * reach) + 1
    place = F.least(F.floor(t * k), 4 * k - 1)
    cap = F.when(z > 0, 2 * k * (k - 1) + place).otherwise(12 * nside * nside - 2 * k * (k + 1) + place)
    return F.when(za <= 2 / 3, belt).otherwise(cap).cast("long")
