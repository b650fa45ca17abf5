"""Published confidence models and the terms they read, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bias, then a weight for each term of detection_terms().
DETECTION = (0.167814, 0.947158, -0.382409, 0.344810, -0.389818, 0.473048, 0.369443, -1.812427, 1.568032, 1.520297)
# Bias and weights of N, S, V, F over class_terms(), clinical and patch.
CLINICAL_CLASSES = (
    (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    (-2.935872, 0.084314, 0.150091, -0.080899, -2.383425, -0.067497, -0.040144),
    (-1.603803, 0.283742, 0.084875, 0.016681, -1.562722, -0.051106, -0.087180),
    (-6.148267, 0.177240, -0.085609, -0.002183, -1.293278, -0.062153, -0.053667),
)
PATCH_CLASSES = (
    (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    (-1.966072, -0.014956, 0.094335, 0.000300, -0.555909, 0.011780, 0.100310),
    (-2.816300, 1.176300, 0.059857, -0.008372, -1.012921, -0.017458, -0.705576),
    (-17.430817, 0.467019, 0.170600, 0.246595, -0.117794, 0.059661, -0.103558),
)


def _within(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def detection_terms(margin: Column, recovered: Column, score: Column, unusable: Column, rr_rel: Column) -> list[Column]:
    m, r, q = F.log(_within(margin, 0.05, 50.0)), F.log(_within(rr_rel, 0.1, 4.0)), _within(score, 0.0, 1.0)
    return [m, m * m, recovered.cast("double"), q, unusable.cast("double"), r, r * r, q * q, m * q]


def class_terms(v: Column, s: Column, f: Column, fibrillating: Column) -> list[Column]:
    odds = lambda p: F.log(_within(p, 1e-6, 1 - 1e-6) / (1 - _within(p, 1e-6, 1 - 1e-6)))
    on = fibrillating.cast("double")
    return [odds(v), odds(s), odds(f), on, on * odds(s), odds(v) * F.greatest(odds(s), F.lit(0.0)) / 10.0]
