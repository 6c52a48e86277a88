"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from palimpsest.plans import drives, folds, more, reads, registry, scalars  # noqa: F401  importing a module registers its queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
