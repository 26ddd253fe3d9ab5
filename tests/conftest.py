import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallywick import schemas  # noqa: E402
from tallywick.session import build_session  # noqa: E402

CASE = {
    "ID": "1", "CNTYFIPS": "Cook, IL", "State": "Illinois", "Solved": "No", "Year": 2010, "VicAge": 30,
    "VicSex": "Male", "VicRace": "White", "VicCount": 0, "OffAge": 40, "OffSex": "Male", "OffRace": "White",
    "Weapon": "Rifle", "county_fips": "17031",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__sql__maxMetadataStringLength="20000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def incidents(spark):
    """Incident rows from dicts holding only what differs from a default case."""

    def build(*rows):
        names = [field.split()[0] for field in schemas.INCIDENTS.split(", ")]
        data = [tuple({**CASE, "ID": str(i), **row}[n] for n in names) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, schemas.INCIDENTS)

    return build


def dicts(df, *order):
    rows = [row.asDict() for row in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows
