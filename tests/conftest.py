from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palimpsest import session

    return session("tests", "8", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})


@pytest.fixture
def table(spark):
    """A small table from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)
