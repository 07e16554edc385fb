"""All queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from gleaner.llm import (
    p1_site_lines, p2_mojibake, p3_boilerplate, p4_language, p5_stuffing, p6_borda, p7_enrichment, p8_packing, p9_mixing, p10_repetition,
)

MODULES = (p1_site_lines, p2_mojibake, p3_boilerplate, p4_language, p5_stuffing, p6_borda, p7_enrichment, p8_packing, p9_mixing, p10_repetition)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
