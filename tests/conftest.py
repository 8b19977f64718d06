import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark

    s = get_spark("local[*]", app="tessera-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s


def step(*lps, tok="t"):
    """A step with the given logprobs; alternative 0 carries ``tok``."""
    return [{"decoded_token": tok if i == 0 else f"#{i}", "logprob": float(v), "rank": i + 1}
            for i, v in enumerate(lps)]
