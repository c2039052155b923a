import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from amperia.session import get_session

    at = tmp_path_factory.mktemp("spark")
    s = get_session("tests", **{"spark.master": "local[4]", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000", "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1", "spark.sql.warehouse.dir": str(at / "warehouse"), "spark.checkpoint.dir": str(at / "shared")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
