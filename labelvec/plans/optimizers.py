"""Weight updates. State lives next to the weights under the optimizer's slot names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from labelvec.plans.network import NetSpec, Tensors


@dataclass(frozen=True)
class Adagrad:
    rate: float = 0.01
    start: float = 0.1

    def slots(self, weights: Tensors) -> Tensors:
        return {f"{name}/Adagrad": np.full(w.shape, self.start) for name, w in weights.items()}

    def update(self, spec: NetSpec, state: Tensors, gradient: Tensors) -> Tensors:
        new = dict(state)
        for name in spec.names:
            g = gradient[name]
            total = g * g
            total += state[f"{name}/Adagrad"]
            change = np.sqrt(total)
            np.divide(g, change, out=change)
            change *= -self.rate
            change += state[name]
            new[f"{name}/Adagrad"], new[name] = total, change
        return new


@dataclass(frozen=True)
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8

    def slots(self, weights: Tensors) -> Tensors:
        slots = {"Adam/updates": np.zeros(1)}
        for name, w in weights.items():
            slots[f"{name}/Adam"] = np.zeros(w.shape)
            slots[f"{name}/Adam_1"] = np.zeros(w.shape)
        return slots

    def update(self, spec: NetSpec, state: Tensors, gradient: Tensors) -> Tensors:
        new = dict(state)
        t = float(state["Adam/updates"][0]) + 1.0
        new["Adam/updates"] = np.array([t])
        rate = self.rate * np.sqrt(1.0 - self.beta2**t) / (1.0 - self.beta1**t)
        for name in spec.names:
            g = gradient[name]
            m = self.beta1 * state[f"{name}/Adam"]
            m += (1.0 - self.beta1) * g
            v = self.beta2 * state[f"{name}/Adam_1"]
            v += (1.0 - self.beta2) * g * g
            change = np.sqrt(v)
            change += self.epsilon
            np.divide(m, change, out=change)
            change *= -rate
            change += state[name]
            new[f"{name}/Adam"], new[f"{name}/Adam_1"], new[name] = m, v, change
        return new


def default_optimizer(spec: NetSpec) -> Adagrad | Adam:
    return Adagrad() if spec.kind == "a" else Adam()
