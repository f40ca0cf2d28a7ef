import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from talkframe.session import build_session  # noqa: E402


# Columns are made while test modules are read, which needs a session.
SESSION = build_session("local[4]", 4)


@pytest.fixture(scope="session")
def spark():
    session = SESSION
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column over named string or array inputs."""

    def run(column, **inputs):
        names = list(inputs) or ["_"]
        df = spark.createDataFrame([tuple(inputs[n] for n in names) if inputs else (1,)], names)
        return df.select(column.alias("x")).collect()[0][0]

    return run


SEGMENT = "meeting_id string, seg_idx bigint, start double, end double, text string, speaker string, source string, duplicate boolean, overlap boolean"


@pytest.fixture(scope="session")
def segs(spark):
    """Segment rows of one meeting from dicts; absent keys are null, absent flags false."""

    def make(*rows, meeting="m"):
        data = [
            (r.get("meeting", meeting), i, r.get("start"), r.get("end"), r.get("text", ""), r.get("speaker"), r.get("source"), r.get("duplicate", False), r.get("overlap", False))
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(data, SEGMENT)

    return make
