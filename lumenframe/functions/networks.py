"""Small networks as column expressions, for any layer sizes.

Parameters lie as: biases of the first hidden layer, then its weights input by input; and so on
layer by layer. The output layer has for each output its bias and then its weights. With 2
inputs and layers 10, 1, 10, 2 these are 83 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import ACTIVATION_FLOPS, ACTIVATIONS, weighted

AUTOENCODER = (2, 10, 1, 10, 2)


def n_parameters(sizes: Sequence[int]) -> int:
    return sum(b + a * b for a, b in zip(sizes, sizes[1:]))


def flops(sizes: Sequence[int], activation: str) -> int:
    """Operations for one example: a multiplication and an addition for each weight, three for each output's squared difference, and the activations."""
    weights = sum(a * b for a, b in zip(sizes, sizes[1:]))
    squashed = sum(sizes[1:-1:2]) if len(sizes) == 5 else sum(sizes[1:-1])
    return 2 * weights + 3 * sizes[-1] + 2 + squashed * ACTIVATION_FLOPS[activation]


def forward(inputs: Sequence[Column], parameters: Sequence[float], sizes: Sequence[int] = AUTOENCODER, activation: str = "elliott", squash: Sequence[bool] | None = None) -> list[Column]:
    """The outputs. squash: which hidden layers are activated; the default leaves a middle layer (the bottleneck) linear."""
    if len(inputs) != sizes[0] or len(parameters) != n_parameters(sizes):
        raise ValueError(f"{len(inputs)} inputs and {len(parameters)} parameters do not fit the layers {tuple(sizes)}")
    g = ACTIVATIONS[activation]
    hidden = len(sizes) - 2
    squash = squash or [hidden != 3 or i != 1 for i in range(hidden)]
    values, at = list(inputs), 0
    for layer, (a, b) in enumerate(zip(sizes, sizes[1:])):
        if layer < hidden:
            bias, weight = parameters[at : at + b], parameters[at + b : at + b + a * b]
            values = [weighted([(v, weight[i * b + j]) for i, v in enumerate(values)], bias[j]) for j in range(b)]
            values = [g(v) for v in values] if squash[layer] else values
        else:
            each = [parameters[at + j * (a + 1) : at + (j + 1) * (a + 1)] for j in range(b)]
            values = [weighted(list(zip(values, p[1:])), p[0]) for p in each]
        at += b + a * b
    return values


def squared_error(outputs: Sequence[Column], targets: Sequence[Column]) -> Column:
    """The sum over outputs of squared differences."""
    out = F.lit(0.0)
    for o, t in zip(outputs, targets):
        out = out + (o - t) * (o - t)
    return out


def xor_forward(x0: Column, x1: Column, p: Sequence[float], activation: str = "elliott") -> Column:
    """One hidden unit and a direct connection; the 7 parameters: hidden bias, output bias, two hidden weights, two direct weights, hidden to output."""
    if len(p) != 7:
        raise ValueError("7 parameters are needed")
    h = ACTIVATIONS[activation](weighted([(x0, p[2]), (x1, p[3])], p[0]))
    return weighted([(x0, p[4]), (x1, p[5]), (h, p[6])], p[1])


NUMPY_ACTIVATIONS = {
    "linear": lambda x: x,
    "tanh": np.tanh,
    "logistic": lambda x: 1 / (1 + np.exp(-x)),
    "elliott": lambda x: x / (1 + np.abs(x)),
}


def forward_rows(x: np.ndarray, parameters: np.ndarray, sizes: Sequence[int] = AUTOENCODER, activation: str = "elliott") -> np.ndarray:
    """forward() for a matrix of examples, one in each row."""
    g, p, at, hidden = NUMPY_ACTIVATIONS[activation], np.asarray(parameters, float), 0, len(sizes) - 2
    for layer, (a, b) in enumerate(zip(sizes, sizes[1:])):
        if layer < hidden:
            x = x @ p[at + b : at + b + a * b].reshape(a, b) + p[at : at + b]
            x = x if hidden == 3 and layer == 1 else g(x)
        else:
            w = p[at : at + b * (a + 1)].reshape(b, a + 1)
            x = x @ w[:, 1:].T + w[:, 0]
        at += b + a * b
    return x


def xor_rows(x: np.ndarray, p: np.ndarray, activation: str = "elliott") -> np.ndarray:
    """xor_forward() for a matrix with x0 and x1 first."""
    h = NUMPY_ACTIVATIONS[activation](p[0] + x[:, 0] * p[2] + x[:, 1] * p[3])
    return p[1] + x[:, 0] * p[4] + x[:, 1] * p[5] + h * p[6]
