"""Ordered stages of a build: functions with a stage, a priority and a condition; one builder for each run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

#: fixed values: stages in their order
STAGES = ("files:prepare", "files:write", "metadata:merge", "crate:prepare", "crate:build", "crate:validate", "crate:write")


@dataclass(frozen=True)
class Tap:
    name: str
    stage: str
    priority: int
    run: Callable[[dict], dict | None]
    builder: bool = False
    active: Callable[[dict], bool] | None = None


def check(taps: Iterable[Tap]) -> list[str]:
    """Unknown stages, priorities that repeat inside a stage, builders without exactly one that is always active."""
    taps = list(taps)
    out = [f"{t.name}: unknown stage {t.stage}" for t in taps if t.stage not in STAGES]
    seen: dict[tuple[str, int], str] = {}
    for t in taps:
        if (other := seen.setdefault((t.stage, t.priority), t.name)) != t.name:
            out.append(f"{t.name} and {other} have the same priority in {t.stage}")
    if (builders := [t for t in taps if t.builder]) and len({t.name for t in builders if t.active is None}) != 1:
        out.append("exactly one builder must be active always")
    return out


def chosen_builder(taps: Iterable[Tap], context: dict) -> str | None:
    """The active builder of the least priority."""
    active = [t for t in taps if t.builder and (t.active is None or t.active(context))]
    return min(active, key=lambda t: t.priority).name if active else None


def run(taps: Iterable[Tap], context: dict, stages: Iterable[str] = STAGES, progress: Callable[[float, str], None] | None = None) -> dict:
    """Runs active taps stage by stage in the order of priority; taps of builders that lost are left out. A tap may return what it changes."""
    taps = list(taps)
    if problems := check(taps):
        raise ValueError("; ".join(problems))
    winner, losers = chosen_builder(taps, context), {t.name for t in taps if t.builder}
    todo = [t for s in stages for t in sorted((t for t in taps if t.stage == s), key=lambda t: t.priority) if (t.active is None or t.active(context)) and not (t.name in losers and t.name != winner)]
    for k, t in enumerate(todo):
        context = {**context, **(t.run(context) or {})}
        if progress:
            progress((k + 1) / len(todo), t.name)
    return context
