from pathlib import Path

import pytest

from sitelens import session


def test_scratch_is_dropped(spark):
    df = session.stored(spark.range(5), "five")
    assert df.count() == 5
    (path,) = [p for p in session._written[spark.sparkContext.applicationId] if "/five-" in p]
    local = Path(path.removeprefix("file:"))
    assert local.exists()
    session.drop_scratch(spark)
    assert not local.exists()


def test_a_cluster_must_name_its_folder(spark):
    class Elsewhere:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Elsewhere())
