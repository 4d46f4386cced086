"""Run parameters and the fixed values the results depend on.

Everything that changes an answer is an argument with a default here, so a
run for another country, month, carrier set or corridor needs no code edit.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference job's values for the same
# results; they are stated plainly, in their natural order.
# ---------------------------------------------------------------------------
# Carrier slots: the focal carrier every delta is taken from, then the two
# challengers in the order the classification rules test them.
FOCAL_CARRIER = "Smart"
CHALLENGER_1 = "Metfone"
CHALLENGER_2 = "Cellcard"
# Rows kept for scoring.
NETWORK_KEPT = "cellular"
COUNTRY_KEPT = "KH"
# Marker for "no carrier in this rank" and for an unresolved secondary SIM.
NO_SIM = "0"
OTHER_SIM = "others"
# Calendar features, taken from the departure observation.
WEEKEND_DAYS = ("Saturday", "Sunday")
WEEKEND = "weekend"
WEEKDAY = "weekday"
# Dayparts by hour of day, inclusive: morning 6-12, afternoon 13-17,
# evening 18-22, night 23 and 0-5.
DAYPARTS = (
    ("morning", 6, 12),
    ("afternoon", 13, 17),
    ("evening", 18, 22),
    ("night", 23, 23),
    ("night", 0, 5),
)
# Trip key separator: "<origin>_<destination>".
TRAVEL_SEPARATOR = "_"
# Tiers of corridor trips per device: cut percentiles and (id, level) labels.
TIER_CUTS = (0.10, 0.80)
TIER_CUTS_FOUR = (0.10, 0.80, 0.90)
TIER_LABELS = (
    ("TRV_01_001", "Low"),
    ("TRV_01_002", "Mid"),
    ("TRV_01_003", "High"),
    ("TRV_01_004", "Ultra High"),
)
# Deciles reported for corridor trips per device.
DECILES = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
# Segment names of the membership table, and the roll-up row's name.
SEGMENTS = ("PP", "SS", "SP", "PS", "Others")
ALL_SEGMENTS = "all"
# Corridors named for cohort analysis (both directions of each pair).
CORRIDORS = (
    ("Kandal", "Phnom Penh"),
    ("Banteay Meanchey", "Phnom Penh"),
    ("Kampong Thom", "Phnom Penh"),
)
# Delta classes.
DELTA_CLASSES = (
    ("primary_focal", "delta_rfm > 0"),
    ("secondary_focal", "delta_rfm < 0"),
    ("either", "delta_rfm = 0"),
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CarrierSlots:
    """The three named carriers of the SIM ranking.

    ``focal`` is the carrier every delta is taken from; ``challenger_1`` and
    ``challenger_2`` keep the order the ranking rules test them in.
    """

    focal: str = FOCAL_CARRIER
    challenger_1: str = CHALLENGER_1
    challenger_2: str = CHALLENGER_2

    @property
    def names(self) -> tuple[str, str, str]:
        return (self.focal, self.challenger_1, self.challenger_2)

    def score_column(self, carrier: str) -> str:
        return f"{carrier.lower()}_rfm"

    @property
    def score_columns(self) -> list[str]:
        return [self.score_column(c) for c in self.names]


def corridor_keys(a: str, b: str) -> tuple[str, str]:
    """Both directed trip keys of the corridor between ``a`` and ``b``."""
    return (f"{a}{TRAVEL_SEPARATOR}{b}", f"{b}{TRAVEL_SEPARATOR}{a}")
