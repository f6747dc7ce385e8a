import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(cores="4", memory="4g", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
