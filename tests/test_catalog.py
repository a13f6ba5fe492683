"""A part of the registered queries against their SQL; check_oracles.py runs all of them."""

from __future__ import annotations

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize(
    "name",
    [
        "canonical_sites",
        "compartment_join",
        "assign_confounded",
        "integrate_patients",
        "well_profiles_median",
        "well_profiles_hot",
        "normalize_mad",
        "consensus_modz",
        "replicate_map",
        "label_classifiability",
    ],
)
def test_query_equals_sql(spark, oracle, name):
    import __spark_entry__ as contract
    from check_oracles import normal

    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = oracle.execute(contract.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(normal(ours), normal(theirs), check_dtype=False, rtol=0, atol=0)


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
