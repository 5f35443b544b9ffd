"""Scenario parameters, their checks and the names made of them."""

from __future__ import annotations

import logging
from dataclasses import dataclass


def weight_code(x: float) -> str:
    """0.65 as 065, 1 as 100, 0.125 as 12p5."""
    percent = round(x * 100, 6)
    return f"{int(percent):03d}" if percent == int(percent) else f"{percent:g}".replace(".", "p")


@dataclass(frozen=True)
class Scenario:
    fit_year: int
    base_year: int
    target_year: int
    size: int = 5
    iterations: int = 5
    neighbour_weight: float = 0.9
    other_weight: float = 0.1
    jitter: float = 0.03
    seed: int = 42

    def __post_init__(self):
        if self.size < 3 or self.size % 2 == 0:
            raise ValueError("the window must be odd and at least 3")
        if self.iterations < 1:
            raise ValueError("at least one iteration")
        if min(self.neighbour_weight, self.other_weight) < 0 or self.neighbour_weight + self.other_weight <= 0:
            raise ValueError("weights must not be negative, and one must be positive")

    def stem(self, model: str) -> str:
        return (f"{model}_fit_{self.fit_year}_{self.base_year}_predict_{self.target_year}_n{self.size}_i{self.iterations}"
                f"_nw{weight_code(self.neighbour_weight)}_sw{weight_code(self.other_weight)}")


    def plain_stem(self, model: str) -> str:
        """Of models without weights: Markov runs have neither window nor iterations."""
        years = f"{model}_fit_{self.fit_year}_{self.base_year}_predict_{self.target_year}"
        return years if model == "markov" else f"{years}_n{self.size}_i{self.iterations}"


def forest_stem(fit_year: int, base_year: int, drivers: int, size: int = 5, sample_seed: int = 42, trees: int = 300, depth: int | None = None,
                leaf: int = 1, weights: str = "transition", seed: int = 42) -> str:
    """The name of a forest and of all that is made of it."""
    deep = "none" if depth is None else depth
    return (f"rf_fit_{fit_year}_{base_year}_driver{drivers}_n{size}_sampseed{sample_seed}_rf{trees}_depth{deep}_leaf{leaf}"
            f"_w{weights}_trainseed{seed}")


def driver_year(years: set[int], wanted: int, fallback: int) -> tuple[int, str | None]:
    """The year whose factors are used, and a warning if it isn't the wanted one."""
    if wanted in years:
        return wanted, None
    if fallback in years:
        return fallback, f"no factors of {wanted}; those of {fallback} are used"
    raise ValueError(f"no factors of {wanted} or {fallback}")


def windows(years: list[int]) -> list[tuple[int, int, int]]:
    """The rolling (fit, base, target) epochs of validation."""
    ordered = sorted(years)
    return list(zip(ordered, ordered[1:], ordered[2:]))


def run_log(name: str, path: str) -> logging.Logger:
    """A logger whose messages go to the console and, one a line with the time, to the end of a file of the driver."""
    log = logging.getLogger(f"terramark.{name}")
    log.setLevel(logging.INFO)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%Y-%m-%d %H:%M:%S"))
        log.addHandler(handler)
    return log
