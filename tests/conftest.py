import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparklake.session import session

    s = session(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def settings(tmp_path):
    from sparklake.config import Settings

    return Settings.load(environ={}, catalog={"warehouse": str(tmp_path / "warehouse"), "commit_backoff_base_seconds": 0.01, "commit_backoff_max_seconds": 0.02}, ingestion={"dlq_dir": str(tmp_path / "dlq")}, compaction={"min_input_files": 2})


@pytest.fixture
def engine(spark, settings):
    from sparklake.engine import Engine

    with Engine(settings, spark) as e:
        yield e


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
