"""Scoring parameters and the checks made on the driver before a job starts."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, functions as F

# Purpose codes, decay rate, exponent, cut-off and weights of the
# default parameter set, and the rate used for an unlisted (mode, purpose).
PURPOSES = (
    "aeropuerto",
    "bachiller",
    "centro_educativo",
    "centro_urbano",
    "consulta_general",
    "hacienda",
    "hospital",
    "osakidetza",
    "residencia",
    "universidad",
)
DEFAULT_ALPHA = 0.05
ALPHA = 0.03
BETA = 0.7
MAX_MINUTES = 120.0
WEIGHT = 0.10
MODES = ("TRANSIT",)
METRICS = ("score", "travel_time")
RESOLUTIONS = (250, 500, 1000)
DEFAULT_SLOT = "08:00"


@dataclass(frozen=True)
class ScoreParams:
    """Immutable scoring parameters; nested maps go mode -> purpose -> value."""

    purpose_map: dict[str, str] = field(default_factory=lambda: {p: p for p in PURPOSES})
    impedance: dict[str, dict[str, float]] = field(
        default_factory=lambda: {m: dict.fromkeys(PURPOSES, ALPHA) for m in MODES}
    )
    beta: float = BETA
    max_minutes: float = MAX_MINUTES
    weights: dict[str, dict[str, float]] = field(
        default_factory=lambda: {m: dict.fromkeys(PURPOSES, WEIGHT) for m in MODES}
    )

    def __post_init__(self) -> None:
        if not 0 < self.beta < 1:
            raise ValueError(f"beta must lie strictly between 0 and 1, got {self.beta}")
        for mode, rates in self.impedance.items():
            for purpose, alpha in rates.items():
                if alpha <= 0:
                    raise ValueError(f"alpha for {mode}/{purpose} must be positive, got {alpha}")
        for mode, by_purpose in self.weights.items():
            total = sum(by_purpose.values())
            if abs(total - 1.0) > 0.01:
                warnings.warn(
                    f"weights for {mode} sum to {total:.3f}; they are rescaled over the purposes present",
                    stacklevel=2,
                )

    def with_changes(self, **changes: Any) -> ScoreParams:
        return replace(self, **changes)

    # Literal maps, as small as the parameter file: lookups need no join.
    def purpose_of(self, code: Column) -> Column:
        """Purpose of a destination type; null when it has none."""
        return F.try_element_at(_literal(self.purpose_map), code)

    def alpha_of(self, mode: Column, purpose: Column) -> Column:
        return F.coalesce(_lookup(self.impedance, mode, purpose), F.lit(DEFAULT_ALPHA))

    def weight_of(self, mode: Column, purpose: Column) -> Column:
        """Configured weight; null for an unlisted pair."""
        return _lookup(self.weights, mode, purpose)


def _literal(values: dict[str, Any]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _lookup(nested: dict[str, dict[str, float]], mode: Column, purpose: Column) -> Column:
    found = F.lit(None).cast("double")
    for name, inner in nested.items():
        values = _literal({p: float(v) for p, v in inner.items()})
        found = F.when(mode == name, F.try_element_at(values, purpose)).otherwise(found)
    return found


def load_params(source: str | Path | dict[str, Any] | None = None) -> ScoreParams:
    """Parameters from a mapping, a JSON file or (where PyYAML exists) a YAML file."""
    if source is None:
        return ScoreParams()
    if isinstance(source, dict):
        raw = source
    else:
        text = Path(source).read_text(encoding="utf-8")
        if str(source).endswith(".json"):
            raw = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as exc:
                raise RuntimeError("install PyYAML to read YAML parameters, or use JSON") from exc
            raw = yaml.safe_load(text)
    return ScoreParams(
        purpose_map=raw["purpose_map"],
        impedance=raw["impedance"],
        beta=raw["diminishing"]["beta"],
        max_minutes=float(raw["max_travel_time"]),
        weights=raw["combined_weights"],
    )


def check_slot(slot: str) -> str:
    """Accept ``HH:MM`` on a half-hour boundary."""
    if not re.fullmatch(r"\d{2}:\d{2}", slot, flags=re.ASCII):
        raise ValueError(f"departure_time {slot!r} is not HH:MM")
    if int(slot[:2]) > 23 or slot[3:] not in ("00", "30"):
        raise ValueError(f"departure_time {slot!r} is not on a half-hour boundary")
    return slot


def check_code(code: str, label: str = "code") -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,20}", code):
        raise ValueError(f"{label} must be 1-20 letters, digits, '_' or '-'")
    return code


def check_choice(value: Any, allowed: tuple[Any, ...], label: str) -> Any:
    if value not in allowed:
        raise ValueError(f"{label} must be one of {allowed}, got {value!r}")
    return value


def check_limit(value: int, upper: int) -> int:
    if not 1 <= value <= upper:
        raise ValueError(f"limit must be between 1 and {upper}")
    return value
