import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from docpipe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    return local_session(
        8,
        "tests",
        driver_memory="4g",
        **{"spark.checkpoint.dir": str(shared / "checkpoints"), "spark.sql.warehouse.dir": str(shared / "warehouse")},
    )


@pytest.fixture
def table(spark):
    """DataFrame (doc_id, <name>) of the given values."""

    def make(values, name="text", type_="string"):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"doc_id long, {name} {type_}")

    return make


@pytest.fixture
def apply(spark):
    """Values of an expression on the column v, in order."""

    def run(values, expression, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}").coalesce(1)
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plan():
    return plan_of
