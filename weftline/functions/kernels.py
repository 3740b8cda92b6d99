"""Numerical kernels, as pandas functions over groups or batches; each group is small by its nature (a chain, a lattice, a register)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def singular_values(v: np.ndarray, rows: int, most: int | None = None) -> np.ndarray:
    """AR7: singular values of a vector laid out in rows, the greatest ones if most is given (SL7)."""
    s = np.linalg.svd(v.reshape(rows, -1), compute_uv=False)
    return s[:most] if most else s


def mps(v: np.ndarray, chi: int) -> tuple[list[np.ndarray], float]:
    """M14: matrix-product chain of a state of 2**n entries, bonds cut to chi; with the weight thrown away (AG17)."""
    chain, left, rest, lost = [], 1, v.reshape(1, -1), 0.0
    for _ in range(int(math.log2(v.size)) - 1):
        u, s, w = np.linalg.svd(rest.reshape(left * 2, -1), full_matrices=False)
        lost += float((s[chi:] ** 2).sum())
        u, s, w = u[:, :chi], s[:chi], w[:chi]
        chain.append(u.reshape(left, 2, -1))
        rest, left = s[:, None] * w, len(s)
    return [*chain, rest.reshape(left, 2, 1)], lost


def contracted(chain: list[np.ndarray]) -> np.ndarray:
    """AR6: the state of a chain."""
    out = chain[0]
    for a in chain[1:]:
        out = np.tensordot(out, a, axes=(-1, 0))
    return out.reshape(-1)


def mps_norm(chain: list[np.ndarray]) -> float:
    """<psi|psi>, site by site."""
    e = np.ones((1, 1))
    for a in chain:
        e = np.einsum("ij,isk,jsl->kl", e, a, a.conj())
    return float(e.real[0, 0])


def mps_z(chain: list[np.ndarray], site: int) -> float:
    """<Z> at a site, over the norm."""
    e = np.ones((1, 1))
    for k, a in enumerate(chain):
        b = a * np.array([1, -1])[None, :, None] if k == site else a
        e = np.einsum("ij,isk,jsl->kl", e, b, a.conj())
    return float(e.real[0, 0]) / mps_norm(chain)


def chain_table(vectors: DataFrame, key: str, vector: str, chi: int) -> DataFrame:
    """For each vector (padded to a power of two): the bond dimensions, weight lost, norm, <Z> of the first site, and fidelity of its cut chain."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("bonds", T.ArrayType(T.IntegerType())), T.StructField("discarded", T.DoubleType()), T.StructField("norm", T.DoubleType()), T.StructField("z0", T.DoubleType()), T.StructField("fidelity", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for k, v in zip(pdf[key], pdf[vector], strict=True):
                a = np.asarray(v, float)
                a = np.concatenate([a, np.zeros((1 << max(1, math.ceil(math.log2(max(2, a.size))))) - a.size)])
                a = a / (np.linalg.norm(a) or 1.0)
                chain, lost = mps(a, chi)
                b = contracted(chain)
                rows.append((k, [x.shape[2] for x in chain[:-1]], lost, mps_norm(chain), mps_z(chain, 0), abs(float(a @ b)) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1.0)))
            yield pd.DataFrame(rows, columns=schema.names)

    return vectors.select(F.col(key).cast("long"), vector).mapInPandas(run, schema)


def svd_spectrum(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """A row for each singular value: key, k (from 0), s."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = [(k, i, float(x)) for k, v in zip(pdf[key], pdf[vector], strict=True) for i, x in enumerate(singular_values(np.asarray(v, float), rows))]
            yield pd.DataFrame(out, columns=schema.names)

    return vectors.select(F.col(key).cast("long"), vector).mapInPandas(run, schema)


def ising_sweeps(temperatures: DataFrame, size: int, sweeps: int, seed: int) -> DataFrame:
    """Metropolis sweeps of a periodic square lattice at each temperature: one key a task, as a sweep is sequential."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = float(pdf["temperature"].iloc[0])
        rng = np.random.default_rng([seed, int(t * 1e6)])
        s = np.ones((size, size), int)
        parity = np.indices((size, size)).sum(axis=0) % 2
        energy, magnet = [], []
        for _ in range(sweeps):
            for colour in (0, 1):  # cells of a colour have no bond between them
                near = sum(np.roll(s, d, a) for d in (1, -1) for a in (0, 1))
                s = np.where((parity == colour) & (rng.random(s.shape) < np.exp(np.minimum(0, -2 * s * near / t))), -s, s)
            energy.append(-float((s * np.roll(s, 1, 0)).sum() + (s * np.roll(s, 1, 1)).sum()))
            magnet.append(abs(float(s.mean())))
        e = np.array(energy[sweeps // 2 :])
        return pd.DataFrame({"temperature": [t], "mean_energy": [e.mean() / s.size], "heat_capacity": [e.var() / (t * t * s.size)], "magnetisation": [float(np.mean(magnet[sweeps // 2 :]))]})

    return temperatures.groupBy("temperature").applyInPandas(run, "temperature double, mean_energy double, heat_capacity double, magnetisation double")


GATES = {"h": np.array([[1, 1], [1, -1]]) / math.sqrt(2), "x": np.array([[0, 1], [1, 0]]), "z": np.diag([1, -1])}


def statevector(n: int, gates: list[tuple]) -> np.ndarray:
    """State of n qubits (first one the highest bit) after gates (name, qubit) and ("cx" or "cz", control, target), from all zeros."""
    psi = np.zeros([2] * n, complex)
    psi[(0,) * n] = 1
    for name, *qs in gates:
        if name in ("cx", "cz"):
            ix = [slice(None)] * n
            ix[qs[0]] = 1
            axis = qs[1] - (qs[1] > qs[0])
            psi[tuple(ix)] = np.moveaxis(np.tensordot(GATES[name[1]], psi[tuple(ix)], (1, axis)), 0, axis)
        else:
            psi = np.moveaxis(np.tensordot(GATES[name], psi, (1, qs[0])), 0, qs[0])
    return psi.reshape(-1)


def purity(rho: np.ndarray) -> float:
    """Tr rho rho of a density matrix."""
    return float(np.trace(rho @ rho).real)


def inverse_erf(x: np.ndarray) -> np.ndarray:
    """Inverse error function by Newton steps on math.erf from a rational start."""
    x = np.clip(np.asarray(x, float), -1 + 1e-15, 1 - 1e-15)
    a, l = 0.147, np.log1p(-x * x)
    b = 2 / (math.pi * a) + l / 2
    y = np.sign(x) * np.sqrt(np.sqrt(b * b - l / a) - b)
    erf = np.vectorize(math.erf)
    for _ in range(4):
        y = y - (erf(y) - x) / (2 / math.sqrt(math.pi) * np.exp(-y * y))
    return y


def normal_grid(t: Column, mu: float, sigma: float, low: float, high: float) -> Column:
    """MA14: clip(mu + sigma sqrt2 erfinv(2t - 1), low, high)."""

    @F.pandas_udf(T.DoubleType())
    def grid(x: pd.Series) -> pd.Series:
        return pd.Series(np.clip(mu + sigma * math.sqrt(2) * inverse_erf(2 * x.to_numpy() - 1), low, high))

    return grid(t)


def internet_checksum(data: Column) -> Column:
    """AG25: one's-complement sum of 16-bit words of a binary column, complemented; an odd byte counts as a high one."""
    digits = F.hex(data)
    even = F.when(F.pmod(F.length(digits), F.lit(4)) == 0, digits).otherwise(F.concat(digits, F.lit("00")))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(even) / 4).cast("int") - 1)), lambda k: F.coalesce(F.conv(F.nullif(F.substring(even, 4 * k + 1, F.lit(4)), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long")))
    fold = lambda x: F.shiftright(x, 16) + x.bitwiseAND(F.lit(0xFFFF).cast("long"))
    return (F.lit(0xFFFF) - fold(fold(F.aggregate(words, F.lit(0).cast("long"), lambda s, v: s + v)))).cast("int")
