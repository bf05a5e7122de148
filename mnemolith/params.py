"""Fixed parameters of scoring and maintenance, as values and as CASE expressions that every SQL dialect reads."""

from __future__ import annotations

import math

#: The time that stands for now.
AS_OF = "2025-06-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"
NOW_NTZ = f"TIMESTAMP_NTZ '{AS_OF}'"

# fixed values: shape and scale (hours) of the recency curve by memory type
WEIBULL = {
    "profile": (0.3, 8760), "preference": (0.4, 4380), "relationship": (0.35, 8760), "dream": (0.4, 4380),
    "learning": (0.7, 1440), "fact": (0.8, 720), "entity": (0.5, 4380), "setup": (0.6, 2160),
    "pattern": (0.6, 1680), "context": (0.85, 360), "observation": (0.9, 480), "artifact": (0.75, 2160),
    "project": (0.85, 1080), "goal": (0.9, 720), "decision": (1.0, 336), "commitment": (1.0, 240),
    "event": (1.2, 168), "instruction": (0.9, 480), "error": (1.1, 336), "issue": (1.1, 336),
    "request": (1.5, 72), "general": (1.0, 168),
}
# fixed values: weights (vector, importance, recency) by intent, and factors by verification status
INTENTS = {"temporal": (0.7, 0.8, 1.5), "factual": (1.0, 1.2, 0.7), "entity": (1.2, 1.1, 0.8), "preference": (1.0, 1.4, 0.5), "procedural": (1.3, 1.0, 0.6), "general": (1.0, 1.0, 1.0)}
VERIFICATION = {"certified": 1.05, "verified": 1.0, "unverified": 0.95, "stale": 0.85, "contradicted": 0.5}
TYPE_PRIORITY = {"profile": 9, "preference": 8, "relationship": 8, "entity": 7, "setup": 6, "pattern": 5, "fact": 4, "project": 3, "observation": 2, "learning": 2, "instruction": 2, "general": 1}
# fixed values: words that a keyword search leaves out
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()


def case(column: str, values: dict, otherwise) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


def archive_days(k: float, eta: float) -> int:
    """Days after which a type's curve has fallen to a tenth, between 7 and 365."""
    return int(min(365, max(7, math.floor(eta * math.log(10) ** (1 / k) / 24 + 0.5))))


K = case("memory_type", {t: f"CAST({v[0]} AS DOUBLE)" for t, v in WEIBULL.items()}, "CAST(1.0 AS DOUBLE)")
ETA = case("memory_type", {t: f"CAST({v[1]} AS DOUBLE)" for t, v in WEIBULL.items()}, "CAST(168 AS DOUBLE)")
DAYS = case("memory_type", {t: archive_days(*v) for t, v in WEIBULL.items()}, 14)
TRUST = case("verification_status", {s: f"CAST({v} AS DOUBLE)" for s, v in VERIFICATION.items()}, "CAST(0.95 AS DOUBLE)")
PRIORITY = case("memory_type", TYPE_PRIORITY, 0)
