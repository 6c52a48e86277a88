"""Named queries over the fixture drives, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the fixtures as a query of that name."""

    def register(build: Callable[[Fixtures], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return build

    return register


#: DuckDB: keys of the fixture drive and of its later form, by recursion.
KEYED = """keyed as (select parent, name, oid, kind, case kind when 'folder' then name || '/' else name end as key, 1 as depth from fx_entries where parent = 'root'
  union all select e.parent, e.name, e.oid, e.kind, k.key || e.name || case e.kind when 'folder' then '/' else '' end, k.depth + 1 from keyed k join fx_entries e on e.parent = k.oid)"""
