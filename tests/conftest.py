import pytest

from weftline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s
