"""Business rules that are parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Knobs of the programme; the defaults are the ones the results are defined by.

    ``brand_prefix`` is the prefix of the shop's own campaign codes, which are not personal
    codes and are left out. It differs per shop: set it to yours.
    """

    brand_prefix: str = "CLUB"
    utc_lag_hours: int = 6  # shop time = UTC minus this
    cutoff_hour: int = 21  # orders up to this local hour (inclusive) ship one day earlier
    strict_week: bool = False  # True: week start is the plain Monday (see functions.calendar)
    active_days: int = 15  # a customer is active if the last order week began fewer days ago
    zipcode_weight: float = 1.0  # weights of the two parts of physical virality
    store_weight: float = 0.8
    min_active_days: int = 5  # fewer distinct days than this give no growth factor
    k_low: float = 0.01  # bounds of the growth factor
    k_high: float = 10.0
    dedupe_lines: bool = False  # True: money of a line counts once, not once per category of its product
    stop_on_coupon_conflict: bool = False  # True: fail when a client used several codes
