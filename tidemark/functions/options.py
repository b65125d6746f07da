"""Option pricing as Arrow-batched functions; Spark SQL has no error function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_erf = np.vectorize(math.erf, otypes=[float])


def _cdf(x):
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def greeks(s, k, t, r, v, call: bool) -> dict[str, np.ndarray]:
    """Black-Scholes price, delta, gamma, vega and rho (per point), theta (per day)."""
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    pdf, z, df = np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi), (1 if call else -1), np.exp(-r * t)
    return {
        "price": z * (s * _cdf(z * d1) - k * df * _cdf(z * d2)),
        "delta": _cdf(d1) - (0 if call else 1),
        "gamma": pdf / (s * v * np.sqrt(t)),
        "vega": s * pdf * np.sqrt(t) / 100,
        "theta": (-s * pdf * v / (2 * np.sqrt(t)) - z * r * k * df * _cdf(z * d2)) / 365,
        "rho": z * k * t * df * _cdf(z * d2) / 100,
    }


def implied(price, s, k, t, r, call: bool, most: int = 100, tolerance: float = 1e-5):
    """Volatility by Newton's method from 0.3, kept above 0.001."""
    v = np.full(len(price), 0.3)
    for _ in range(most):
        g = greeks(s, k, t, r, v, call)
        off = g["price"] - price
        if (np.abs(off) < tolerance).all():
            break
        v = np.where(np.abs(off) < tolerance, v, np.clip(v - off / np.maximum(g["vega"] * 100, 1e-8), 0.001, 5.0))
    return v


def priced(df, call: bool = True):
    """df with the figures of an option on columns spot, strike, years, rate, vol, and iv recovered from the price."""
    fields = "price double, delta double, gamma double, vega double, theta double, rho double, iv double"

    @F.pandas_udf(fields)
    def run(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, v: pd.Series) -> pd.DataFrame:
        a = [x.to_numpy(float) for x in (s, k, t, r, v)]
        g = greeks(*a, call)
        return pd.DataFrame(g | {"iv": implied(g["price"], *a[:4], call)})

    return df.withColumn("o", run("spot", "strike", "years", "rate", "vol")).select(*df.columns, "o.*")
