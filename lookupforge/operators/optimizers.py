"""Optimizer rules: scalar Columns in, scalar Columns out.

Each rule takes the row's value ``w``, the summed gradient ``g``, its slots and the hyperparameters of the step, and gives the
new value (before clipping) and the new slots. A rule runs once for each touched id, on the sum of its gradients.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lookupforge.specs import Optimizer

Rule = Callable[..., tuple[Column, dict[str, Column]]]


@dataclass(frozen=True)
class Kind:
    """A rule with its slots' first values and its hyperparameters' defaults."""

    rule: Rule
    slots: dict[str, float]
    defaults: dict[str, float | bool | None]
    learning_rate: float = 0.001


def _sgd(w: Column, g: Column, s: dict, lr: float, step: int | None) -> tuple:
    return w - F.lit(lr) * g, {}


def _adagrad(w: Column, g: Column, s: dict, lr: float, step: int | None, initial: float) -> tuple:
    a = s["accumulator"] + g * g
    return w - F.lit(lr) * g / F.sqrt(a), {"accumulator": a}


def _adam(w: Column, g: Column, s: dict, lr: float, step: int | None, beta1: float, beta2: float, epsilon: float) -> tuple:
    t = (step or 0) + 1
    root = (1 - beta2**t) ** 0.5
    m = s["momentum"] + F.lit(1 - beta1) * (g - s["momentum"])
    v = s["velocity"] + F.lit(1 - beta2) * (g * g - s["velocity"])
    return w - F.lit(lr * root / (1 - beta1**t)) * m / (F.sqrt(v) + F.lit(epsilon * root)), {"momentum": m, "velocity": v}


def _adagrad_momentum(w: Column, g: Column, s: dict, lr: float, step: int | None, momentum: float, beta2: float, epsilon: float, exponent: float, nesterov: bool, initial: float) -> tuple:
    a = s["accumulator"] + g * g if beta2 == 1 else F.lit(beta2) * s["accumulator"] + F.lit(1 - beta2) * g * g
    scaled = F.pow(a + F.lit(epsilon), F.lit(-1.0 / exponent)) * g
    m = F.lit(momentum) * s["momentum"] + scaled
    u = F.lit(momentum) * m + scaled if nesterov else m
    return w - F.lit(lr) * u, {"accumulator": a, "momentum": m}


def _ftrl(w: Column, g: Column, s: dict, lr: float, step: int | None, power: float, l1: float, l2: float, beta: float, multiply: bool, initial: float) -> tuple:
    a = s["accumulator"] + g * g
    p_new, p_old = F.pow(a, F.lit(-power)), F.pow(s["accumulator"], F.lit(-power))
    if multiply:
        linear = s["linear"] + F.lit(lr) * g - (p_new - p_old) * w
        bound, den = l1 * lr, p_new + F.lit(2 * lr * l2 + beta)
    else:
        linear = s["linear"] + g - (p_new - p_old) / F.lit(lr) * w
        bound, den = l1, (p_new + F.lit(beta)) / F.lit(lr) + F.lit(2 * l2)
    num = -linear if l1 == 0 else F.greatest(F.least(linear, F.lit(bound)), F.lit(-bound)) - linear
    return num / den, {"accumulator": a, "linear": linear}


def _laprop(w: Column, g: Column, s: dict, lr: float, step: int | None, beta1: float, beta2: float, epsilon: float, rms_clip: float | None) -> tuple:
    if rms_clip is not None:
        raise ValueError("clipping by root mean square isn't supported")
    d = beta2 if step is None else beta2 * (1 - beta2**step) / (1 - beta2 ** (step + 1))
    v = F.lit(d) * s["velocity"] + F.lit(1 - d) * (g * g + F.lit(epsilon))
    m = F.lit(beta1) * s["momentum"] + F.lit((1 - beta1**2) ** 0.5) * g / F.sqrt(v)
    return w - F.lit(lr) * m, {"momentum": m, "velocity": v}


def _frequency_adagrad(w: Column, g: Column, s: dict, lr: float, step: int | None, rho: float, l1: float, l2: float, most: float, initial: float) -> tuple:
    n = s["count"] + F.lit(1.0)
    f = F.least(F.pow(F.lit(float(max(step or 0, 1))) / n, F.lit(rho)), F.lit(most))
    a = s["accumulator"] + g * g
    return w - F.lit(lr) * (f * g / F.sqrt(a) + F.lit(l1) * F.signum(w) + F.lit(l2) * w), {"accumulator": a, "count": n}


RULES: dict[str, Kind] = {
    "sgd": Kind(_sgd, {}, {}),
    "adagrad": Kind(_adagrad, {"accumulator": 0.1}, {"initial": 0.1}),
    "adam": Kind(_adam, {"momentum": 0.0, "velocity": 0.0}, {"beta1": 0.9, "beta2": 0.999, "epsilon": 1e-8}),
    "adagrad_momentum": Kind(_adagrad_momentum, {"accumulator": 0.1, "momentum": 0.0}, {"momentum": 0.9, "beta2": 1.0, "epsilon": 1e-10, "exponent": 2.0, "nesterov": False, "initial": 0.1}),
    "ftrl": Kind(_ftrl, {"accumulator": 0.1, "linear": 0.0}, {"power": -0.5, "l1": 0.0, "l2": 0.0, "beta": 0.0, "multiply": False, "initial": 0.1}, 0.01),
    "laprop": Kind(_laprop, {"momentum": 0.0, "velocity": 0.0}, {"beta1": 0.9, "beta2": 0.95, "epsilon": 1e-30, "rms_clip": None}),
    "frequency_adagrad": Kind(_frequency_adagrad, {"accumulator": 0.1, "count": 0.0}, {"rho": 0.5, "l1": 0.0, "l2": 0.0, "most": 1e6, "initial": 0.1}, 0.01),
}


def register(name: str, rule: Rule, slots: dict[str, float] | None = None, defaults: dict | None = None) -> None:
    """A custom rule, from Columns to Columns: it stays in the plan like the built-in ones."""
    if not callable(rule):
        raise ValueError("a custom optimizer needs a rule")
    RULES[name] = Kind(rule, slots or {}, defaults or {})


def kind_of(opt: Optimizer) -> tuple[Kind, dict]:
    if opt.rule is not None:
        return Kind(opt.rule, dict(opt.slots), {}), dict(opt.params)
    if opt.name not in RULES:
        raise ValueError(f"unknown optimizer {opt.name!r}")
    kind = RULES[opt.name]
    if unknown := {k for k, _ in opt.params} - set(kind.defaults):
        raise ValueError(f"{opt.name} has no {sorted(unknown)}")
    return kind, kind.defaults | dict(opt.params)


def initial_slots(opt: Optimizer) -> dict[str, float]:
    kind, params = kind_of(opt)
    return {k: params.get("initial", v) if k == "accumulator" else v for k, v in kind.slots.items()}
