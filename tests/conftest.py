import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from logweave.session import build_session, clear_scratch

    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    clear_scratch(session)


@pytest.fixture
def lines(spark):
    """Text of one file as ``(file_path, line_no, value)``."""

    def build(text: str, path: str = "f"):
        rows = [(path, i, v) for i, v in enumerate(text.split("\n"), start=1)]
        return spark.createDataFrame(rows, "file_path string, line_no bigint, value string")

    return build
