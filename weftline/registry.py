"""All registered queries and their SQL equivalents, gathered from the modules of ``plans``."""

from __future__ import annotations

from weftline.plans import assembly, basics, biology, corpora, features, formats, models, outcomes, projections, training  # noqa: F401  they register their queries in basics

FLAGSHIP = "j03_variant_exon_join"


def queries() -> dict:
    return dict(basics.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(basics.ORACLES)
