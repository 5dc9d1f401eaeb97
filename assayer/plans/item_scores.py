"""From bill-of-materials lines and factor sources to scored, explained items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assayer.operators import bom as B
from assayer.operators import profiles as R
from assayer.operators import scoring as S
from assayer.session import cut_lineage


def structure(lines: DataFrame) -> dict[str, DataFrame]:
    """Roll-up per context, one representative per item, conflicts and the bottom-up audit."""
    rolled = cut_lineage(B.roll_up(lines))
    return {
        "features": rolled,
        "representative": R.representative(rolled),
        "conflicts": B.context_conflicts(rolled),
        "audit": B.audit(rolled, B.bottom_up_totals(B.prepare_lines(lines))),
    }


def scores(semis: DataFrame, blend: DataFrame | None = None) -> dict[str, DataFrame]:
    """Provisional scores and factor provenance, with the blended quality overlaid if given."""
    rows = semis if blend is None else S.overlay_blend(semis, blend)
    return {"scores": S.sku_scores(rows), "provenance": S.factor_provenance(rows)}
