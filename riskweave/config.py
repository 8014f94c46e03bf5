"""Settings of an evaluation run."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

_DURATION = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def seconds(duration: str) -> int:
    """Whole seconds of an ISO duration such as PT1H or P7D."""
    match = _DURATION.fullmatch(duration)
    if not match or not any(match.groups()):
        raise ValueError(f"not a duration: {duration}")
    days, hours, minutes, secs = (int(part or 0) for part in match.groups())
    return ((days * 24 + hours) * 60 + minutes) * 60 + secs


@dataclass(frozen=True)
class RiskConfig:
    """Business settings first, then the sizes that shape the physical plan.

    The physical settings never change a result: they decide when a busy
    account is split over several tasks and how many vectors one unit of a
    search may have.
    """

    amount_threshold: Decimal = Decimal("10000")
    velocity_limit: int = 10
    velocity_window_seconds: int = 3600
    max_neighbours: int = 5
    history_limit: int = 20
    gate_weight: float = 0.20
    history_weight: float = 0.30
    assessment_weight: float = 0.50
    approve_max: int = 30
    flag_max: int = 70

    # An account with more rows is split into ranges of about hot_rows_per_slot.
    hot_account_rows: int = 1_000_000
    hot_rows_per_slot: int = 100_000
    # Names of such accounts that are sent to every task; beyond, all accounts are split.
    broadcast_accounts: int = 10_000

    # Dense vectors of one unit of work of a search.
    cut_vectors: int = 2048

    @property
    def velocity_window_us(self) -> int:
        return self.velocity_window_seconds * 1_000_000

    @classmethod
    def from_settings(cls, settings: Mapping) -> RiskConfig:
        """Business settings as they stand in a configuration file; what is missing keeps its default."""
        weights, limits = settings.get("weights", {}), settings.get("thresholds", {})
        given = {
            "amount_threshold": (settings.get("amount-threshold"), lambda v: Decimal(str(v))),
            "velocity_limit": (settings.get("velocity-limit"), int),
            "velocity_window_seconds": (settings.get("velocity-window"), seconds),
            "max_neighbours": (settings.get("rag-max-results"), int),
            "history_limit": (settings.get("history-limit"), int),
            "gate_weight": (weights.get("rule-gate"), float),
            "history_weight": (weights.get("rag"), float),
            "assessment_weight": (weights.get("llm"), float),
            "approve_max": (limits.get("approve-max"), int),
            "flag_max": (limits.get("flag-max"), int),
        }
        return cls(**{name: parse(value) for name, (value, parse) in given.items() if value is not None})
