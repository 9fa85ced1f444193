"""Settings, and their coercion from text."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .operators.transport import Solver, TermCost


@dataclass(frozen=True)
class Config:
    mode: str = "unbalanced_divergence"
    epsilon: float = 0.1
    iterations: int = 30
    reg_m: float = 0.1
    top_k: int = 10
    top_flows: int = 8
    max_terms: int = 256
    drop_top_df: int = 100
    min_token_len: int = 2
    vad_threshold: float = 0.45
    min_arousal: float = 0.45
    negation_window: int = 3
    low_signal_filter: bool = False
    weight: str = "tfidf"
    weight_min: float = 0.0
    weight_max: float = 1.0
    weight_power: float = 1.0
    weight_mix: float = 1.0
    cost: str = "vad"
    alpha: float = 0.5
    beta: float = 0.5

    def solver(self) -> Solver:
        return Solver(self.mode, self.epsilon, self.iterations, self.reg_m)

    def term_cost(self) -> TermCost:
        return TermCost(self.cost, self.alpha, self.beta)


def coerce(value, like):
    """The value as the type of `like`: texts such as yes and 0 are booleans where one is due."""
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)
    if isinstance(like, int):
        return int(float(value))
    return type(like)(value)


def load(settings: dict | str | None = None) -> Config:
    """Defaults with the settings of a dict or a YAML file; unknown names are ignored, nulls keep the default."""
    if isinstance(settings, str):
        import yaml

        with open(settings, encoding="utf-8") as f:
            settings = yaml.safe_load(f) or {}
    base = Config()
    known = {f.name for f in fields(Config)}
    return replace(base, **{k: coerce(v, getattr(base, k)) for k, v in (settings or {}).items() if k in known and v is not None})
