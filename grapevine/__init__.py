"""Word-of-mouth analytics for invitation-coupon programmes, on Spark DataFrames."""

from grapevine.plans.campaign import Campaign, run
from grapevine.rules import Rules

__all__ = ["Campaign", "Rules", "run"]
