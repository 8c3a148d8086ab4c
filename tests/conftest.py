from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from teebox.schemas import HOLES, ROUNDS, SHOTS, conform  # noqa: E402
from teebox.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="teebox-tests")
    yield s


def frame(spark, rows, schema):
    """Rows given as dicts with only some columns -> conformed frame (absent = null)."""
    if not rows:
        return spark.createDataFrame([], schema)
    import pandas as pd

    names = [f.name for f in schema.fields]
    pdf = pd.DataFrame([{k: r.get(k) for k in names} for r in rows], columns=names).astype(object)
    pdf = pdf.where(pd.notna(pdf), None)
    return conform(spark.createDataFrame(pdf, schema=schema), schema)


@pytest.fixture()
def mk(spark):
    def make(kind, rows):
        return frame(spark, rows, {"rounds": ROUNDS, "holes": HOLES, "shots": SHOTS}[kind])

    return make
