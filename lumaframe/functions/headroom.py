"""Camera headroom tags 33 and 48, to and from linear headroom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (tag 33 at least 1, tag 48 at most 0.01) -> slope and intercept in stops.
BRANCHES = {(False, True): (-20.0, 1.8), (False, False): (-0.101, 1.601), (True, True): (-70.0, 3.0), (True, False): (-0.303, 2.303)}
#: Most stops read from tags, and most that tags can express.
MOST_STOPS, MOST_EXPRESSIBLE = 16.0, 3.0
#: Where the two branches with tag 33 at least 1 meet.
MEETING = (BRANCHES[True, True][0] * BRANCHES[True, False][1] - BRANCHES[True, False][0] * BRANCHES[True, True][1]) / (BRANCHES[True, True][0] - BRANCHES[True, False][0])


def stops_from_tags(tag33: Column, tag48: Column) -> Column:
    """As the formula gives it, unclamped."""
    def line(branch: tuple[bool, bool]) -> Column:
        slope, at_zero = BRANCHES[branch]
        return slope * tag48 + at_zero

    low = F.when(tag48 <= 0.01, line((False, True))).otherwise(line((False, False)))
    high = F.when(tag48 <= 0.01, line((True, True))).otherwise(line((True, False)))
    return F.when(tag33 < 1.0, low).otherwise(high)


def headroom_from_tags(tag33: Column, tag48: Column) -> Column:
    stops = stops_from_tags(tag33, tag48)
    stops = F.when(F.isnan(stops), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MOST_STOPS), stops)))
    return F.pow(F.lit(2.0), stops)


def tag48_from_headroom(headroom: Column) -> Column:
    """Tag 48 beside a tag 33 of 1; never negative, so more than 8x reads back as 8x."""
    stops = F.log2(F.greatest(F.lit(1.0), F.least(F.lit(16.0), headroom)))
    steep, flat = BRANCHES[True, True], BRANCHES[True, False]
    t = F.when(stops >= MOST_EXPRESSIBLE, 0.0).when(stops >= MEETING, (stops - steep[1]) / steep[0]).otherwise((stops - flat[1]) / flat[0])
    return F.greatest(t, F.lit(0.0))
