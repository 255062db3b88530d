"""Name scores as columns, and the same for two plain strings."""

import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import kernels
from palisade.functions.folding import normalize

# Shares of the ensemble.
ENSEMBLE_WEIGHTS = {"jaro_winkler": 0.4, "token_set": 0.4, "phonetic": 0.2}


def jaro_winkler_score(a: Column, b: Column) -> Column:
    return kernels.jaro_winkler_of(normalize(a), normalize(b))


def token_set_score(a: Column, b: Column) -> Column:
    return kernels.token_set_of(normalize(a), normalize(b))


def phonetic_score(a: Column, b: Column) -> Column:
    """Token set ratio of the sound codes; 0 where either side has none."""
    return kernels.token_set_of(kernels.metaphone_of(normalize(a)), kernels.metaphone_of(normalize(b)))


def weighted(jw: Column, ts: Column, ph: Column, weights: Mapping[str, float] | None = None) -> Column:
    w = weights or ENSEMBLE_WEIGHTS
    return F.lit(w.get("jaro_winkler", 0.0)) * jw + F.lit(w.get("token_set", 0.0)) * ts + F.lit(w.get("phonetic", 0.0)) * ph


def ensemble_score(a: Column, b: Column, weights: Mapping[str, float] | None = None) -> Column:
    return weighted(jaro_winkler_score(a, b), token_set_score(a, b), phonetic_score(a, b), weights)


def score_all(a: Column, b: Column) -> Column:
    """struct(jaro_winkler, token_set, phonetic, ensemble)."""
    jw, ts, ph = jaro_winkler_score(a, b), token_set_score(a, b), phonetic_score(a, b)
    return F.struct(jw.alias("jaro_winkler"), ts.alias("token_set"), ph.alias("phonetic"), weighted(jw, ts, ph).alias("ensemble"))


def plain_normalize(name: str | None) -> str:
    """normalize() of one string, for use on the driver."""
    bare = "".join(c for c in unicodedata.normalize("NFD", (name or "").lower()) if unicodedata.category(c) != "Mn")
    return " ".join(re.sub(r"[^\w\s]", " ", bare).split())


def plain_scores(a: str | None, b: str | None, weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """The four scores of two strings."""
    a, b, w = plain_normalize(a), plain_normalize(b), weights or ENSEMBLE_WEIGHTS
    out = {"jaro_winkler": kernels.jaro_winkler(a, b), "token_set": kernels.token_set(a, b), "phonetic": kernels.token_set(kernels.metaphone_string(a), kernels.metaphone_string(b))}
    return out | {"ensemble": sum(w.get(k, 0.0) * v for k, v in out.items())}
