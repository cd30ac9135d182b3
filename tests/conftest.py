import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def operations(spark):
    rows = [
        ("example", "Parcel Sorting", "v7", "WeighParcel", "<p>Weighs a parcel.</p>", 0, 0),
        ("example", "Parcel Sorting", "v7", "RouteParcel", "<p>Routes a parcel.</p>", 0, 1),
    ]
    return spark.createDataFrame(
        rows,
        "service string, service_name string, api_version string, operation string, "
        "description string, list_pos int, pos int",
    )


def column(df, name):
    return [row[name] for row in df.collect()]
