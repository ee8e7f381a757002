"""Score arithmetic."""

from pyspark.sql import Column, functions as F

from recollect.functions.constants import B, HALF_LIFE_MS, IMPORTANCE_SHARE, K1, LN2

DIGITS = 8


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(idf_: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def decay(age_ms: Column, half_life_ms: float = HALF_LIFE_MS) -> Column:
    """One half for every half-life; times to come count as now."""
    return F.when(age_ms <= 0, 1.0).otherwise(F.exp(-F.lit(LN2) / F.lit(float(half_life_ms)) * age_ms))


def blended(relevance: Column, recency: Column, weight: Column) -> Column:
    return (1 - weight) * relevance + weight * recency * relevance


def boosted(score: Column, importance: Column) -> Column:
    return score * (1 + F.lit(IMPORTANCE_SHARE) * importance)


def serial_fraction(speedup: Column, threads: Column) -> Column:
    """Amdahl's serial share, between 0 and 1; 1 for a single thread."""
    raw = (1 / speedup - F.lit(1.0) / threads) / (1 - F.lit(1.0) / threads)
    return F.when(threads <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def amdahl(serial: Column, threads: Column) -> Column:
    return 1 / (serial + (1 - serial) / threads)


def rounded(score: Column) -> Column:
    """Scores are rounded before they are ranked, so that ties are ties.

    Spark rounds a double by way of a decimal.  The whole number of units gives the same double
    wherever the rest isn't near a half.
    """
    units = score * 10**DIGITS
    plain = (F.abs(score) < 1000) & (F.abs(units - F.floor(units) - 0.5) > 1e-4)
    return F.when(plain, F.floor(units + 0.5) / F.lit(10.0**DIGITS)).otherwise(F.round(score, DIGITS))
