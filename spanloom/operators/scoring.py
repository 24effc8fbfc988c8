"""Scores of edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed


def retention_scores(raw: Column, pacing_score: Column | None = None, density: Column | None = None) -> Column:
    """A4: the eight scores of a string map (50 where missing) as map<string,int>; pacing and density blended with the measured ones."""
    values = {k: exprs.map_score(raw, k, 50) for k in fixed.RETENTION_WEIGHTS}
    if pacing_score is not None:
        values["pacing"] = F.when(pacing_score.isNull(), values["pacing"]).otherwise(F.bround((values["pacing"] * 60 + pacing_score * 40) / 100.0).cast("int"))
    if density is not None:
        own = values["information_density"]
        values["information_density"] = F.when(density.isNull(), own).otherwise(F.bround((own * 70 + density * 30) / 100.0).cast("int"))
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))


def retention_score(scores: Column, penalty: Column) -> Column:
    """A4: weighted sum of the scores less the edit penalty (in points), as an int from 0 to 100."""
    total = sum((F.coalesce(scores[k], F.lit(0)) * w for k, w in fixed.RETENTION_WEIGHTS.items()), F.lit(0))
    return exprs.half_even(total - F.greatest(F.lit(0.0), penalty) * 100)
