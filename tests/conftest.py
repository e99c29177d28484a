import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mercato.session import build_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = build_session(master="local[4]", shuffle_partitions=4, app_name="mercato-tests",
                            extra={"spark.sql.maxMetadataStringLength": "2000",
                                   "spark.sql.warehouse.dir": warehouse})
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
