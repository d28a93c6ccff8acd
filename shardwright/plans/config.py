"""Experiments described in text: lines of ``key: value, name(option=value, ...)``."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field


@dataclass
class Spec:
    """A named thing with options."""

    name: str
    params: dict = field(default_factory=dict)


@dataclass
class ExperimentConfig:
    datasets: list[Spec]
    sampling_strategies: list[Spec]
    automl_models: list[Spec]
    time_budget_minutes: int = 10
    tracking: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


def coerce(text: str):
    """Whole numbers, decimals and truth values; else the text itself."""
    text = text.strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        return {"true": True, "false": False, "none": None}.get(text.lower(), text)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that stand outside parentheses."""
    parts, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == separator and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*parts, part] if p.strip()]


def parse_entity(text: str) -> Spec:
    """``name`` or ``name(option=value, ...)``."""
    found = re.fullmatch(r"\s*([^()]+?)\s*(?:\((.*)\))?\s*", text, re.S)
    if not found:
        raise ValueError(f"cannot read {text!r}")
    params = {}
    for pair in split_top(found[2] or ""):
        name, equals, value = pair.partition("=")
        if not equals:
            raise ValueError(f"{pair!r} in {text!r} has no value")
        params[name.strip()] = coerce(value)
    return Spec(found[1], params)


class ExperimentConfigBuilder:
    """Reads a configuration; what is not named has a default."""

    DEFAULTS = {"datasets": "adult", "sampling_strategies": "hierarchical_stratified(n_partitions=5)", "automl_models": "random_forest"}

    def from_text(self, text: str) -> ExperimentConfig:
        sections = dict(self.DEFAULTS)
        for line in text.splitlines():
            key, colon, value = line.partition(":")
            if colon and value.strip():
                sections[key.strip().lower()] = value.strip()
        lists = {k: [parse_entity(x) for x in split_top(sections[k])] for k in self.DEFAULTS}
        budget = coerce(sections.get("time_budget_minutes", "10"))
        return ExperimentConfig(**lists, time_budget_minutes=int(budget), tracking=sections.get("tracking"))

    @staticmethod
    def example_request() -> str:
        return "datasets: adult\nsampling_strategies: random(n_partitions=4)\nautoml_models: random_forest(numTrees=20)\ntime_budget_minutes: 5"
