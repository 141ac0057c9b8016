import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stratafac.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app_name="stratafac-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tiny_ratings(spark):
    """4 users × 5 items, 12 hand-placed ratings (FIXTURES.md §3)."""
    rows = [
        (0, 0, 5.0), (0, 1, 3.0), (0, 3, 1.0),
        (1, 0, 4.0), (1, 2, 2.0), (1, 4, 5.0),
        (2, 1, 1.0), (2, 2, 4.0), (2, 3, 5.0),
        (3, 0, 2.0), (3, 3, 3.0), (3, 4, 4.0),
    ]
    return spark.createDataFrame(rows, "user bigint, item bigint, rating double")


@pytest.fixture()
def edge_ratings(spark):
    """Duplicate pair, single-rating user, constant user, a mean-valued rating
    (z = 0), an id gap (no user 4), an item with one rating."""
    rows = [
        (0, 0, 1.0), (0, 0, 3.0),  # duplicate pair
        (1, 1, 4.0),  # single-rating user
        (2, 0, 3.0), (2, 1, 3.0), (2, 2, 3.0),  # constant user
        (3, 0, 3.0), (3, 1, 4.0), (3, 2, 5.0),  # middle rating has z = 0
        (5, 3, 2.0),  # id gap, item 3 rated once
    ]
    return spark.createDataFrame(rows, "user bigint, item bigint, rating double")
