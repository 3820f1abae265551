"""The analysis plan: every constant of the analyses, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# The registered plan.
REFERENCE_MODE = "incumbent"
STORAGE_ENV = "E1"
CANONICAL_ENV = "E1"
RULE, MARGIN, TAU, ALPHA = "net_win", 0.0, 0.05, 0.10
SCHEDULE = ((0, "E1"), (4, "E2"), (8, "E4"))
T4_AGE = 3
T4_LABELS = {"E1": "Unchanged environment", "E2": "Decoding change", "E3": "Answer-extraction change", "E4": "Multiple environment changes"}
T7_AGES, T7_UNCHANGED, T7_CHANGED = (0, 1, 3, 5, 10), "E1", "E4"
REPLICATES, BOOTSTRAP_SEED = 2000, 20261004
N_SCHEDULES, N_CHANGES, SCHEDULE_SEED = 200, 2, 7
EQUIVALENCE_MARGIN_PP = 10.0
CALL_PURPOSES = ("trajectory_dev", "proposer", "candidate_dev", "candidate_eval", "reference_init", "reference_refresh", "rescore", "oracle_gt")


@dataclass(frozen=True)
class Ablation:
    name: str
    schedule: tuple[tuple[int, str], ...]
    fixed_age: int | None = None
    description: str = ""


# The registered ablations.
ABLATIONS = (
    Ablation("A1", SCHEDULE, None, "Full system (decoding + extraction changes, variable age)"),
    Ablation("A2", ((0, "E1"), (8, "E3")), None, "No decoding changes (extraction change only)"),
    Ablation("A3", ((0, "E1"), (4, "E2")), None, "No extraction changes (decoding change only)"),
    Ablation("A4", SCHEDULE, 1, "Fixed reference age (always 1 round old)"),
)


@dataclass(frozen=True)
class Convention:
    """How logical model calls are counted: ``attempts`` counts every proposal, ``initial`` the first baseline too."""

    name: str
    candidate_dev: bool = False
    attempts: bool = False
    initial: bool = False


CONVENTIONS = {c.name: c for c in (Convention("teammate_v1"), Convention("full", True, True, True))}


def convention(name: str | Convention | None) -> Convention:
    if isinstance(name, Convention):
        return name
    if (name or "teammate_v1") not in CONVENTIONS:
        raise ValueError(f"unknown convention {name!r}; known: {sorted(CONVENTIONS)}")
    return CONVENTIONS[name or "teammate_v1"]
