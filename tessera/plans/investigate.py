"""The bounded investigation: rounds of actions until every requirement is supported, or nothing new is found."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.evidence import sufficiency

ANSWER, PARTIAL, ABSTAIN = "ANSWER", "PARTIAL_ANSWER", "ABSTAIN"


@dataclass(frozen=True)
class Action:
    """One retrieval step; its identity keeps it from running twice."""

    kind: str
    requirement: str
    argument: str = ""


@dataclass
class Outcome:
    decision: str
    states: dict[str, str]
    rounds: int
    actions: list[Action] = field(default_factory=list)


def investigate(
    requirements: DataFrame,
    evidence: Callable[[list[Action]], DataFrame],
    propose: Callable[[dict[str, str], list[Action]], list[Action]],
    rounds: int = 3,
    actions_per_round: int = 5,
    seconds: float = 60.0,
) -> Outcome:
    """requirements(requirement); evidence(actions so far) -> (requirement, state); propose(states, done) -> actions.

    Only requirement states come to the driver, one row each. The loop ends when all are supported, an action would
    repeat, nothing is proposed, or the rounds or seconds are used up.
    """
    done: list[Action] = []
    began = time.monotonic()
    states: dict[str, str] = {}
    n = 0
    for n in range(1, rounds + 1):
        rows = sufficiency(evidence(done), requirements, "requirement", "state").collect()
        states = {r["requirement"]: r["state"] for r in rows}
        if all(s == "SUPPORTED" for s in states.values()) or time.monotonic() - began > seconds:
            break
        new = [a for a in dict.fromkeys(propose(states, done)) if a not in done][:actions_per_round]
        if not new:
            break
        done += new
    supported = [s for s in states.values() if s == "SUPPORTED"]
    some = [s for s in states.values() if s in ("SUPPORTED", "PARTIALLY_SUPPORTED")]
    decision = ANSWER if states and len(supported) == len(states) else PARTIAL if some else ABSTAIN
    return Outcome(decision, states, n, done)


def new_evidence(before: DataFrame, after: DataFrame, key: str = "evidence") -> DataFrame:
    """What a round has added."""
    return after.select(key).subtract(before.select(key))


def answer_status(direct: DataFrame, related: DataFrame) -> str:
    """The status that a presentation shows."""
    if direct.take(1):
        return "DIRECT"
    return "RELATED" if related.where(F.lit(True)).take(1) else "NO_DIRECT"
