"""Every named query against its SQL. The older plans run at sf0.01, the others at sf0.001, unless TEST_SF_DIR names a folder."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue, evidence, jobs, library, recordings, scalars, timeline

PLANS = {catalogue: "sf0.01", timeline: "sf0.01", recordings: "sf0.001", library: "sf0.001", scalars: "sf0.001", jobs: "sf0.001", evidence: "sf0.001"}
CASES = [(name, plan, sf) for plan, sf in PLANS.items() for name in plan.queries()]


def folder(sf):
    return os.environ.get("TEST_SF_DIR", f"/root/testdata/{sf}")


@pytest.fixture(scope="module")
def db():
    out = {}
    for d in {folder(sf) for sf in PLANS.values()}:
        out[d] = duckdb.connect()
        for f in os.listdir(d):
            out[d].sql(f"create view {f[:-8]} as select * from '{d}/{f}'")
    return out


@pytest.mark.parametrize("name,plan,sf", [c for c in CASES if c[0] in c[1].oracle_sql()], ids=lambda x: x if isinstance(x, str) else "")
def test_query_equals_sql(spark, db, name, plan, sf):
    df = plan.queries()[name](spark, folder(sf))
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = db[folder(sf)].sql(plan.oracle_sql()[name])
    assert sorted(want.columns) == cols
    want = sorted(want.select(", ".join(cols)).fetchall(), key=repr)
    assert len(got) == len(want) and got == want


def test_names_are_unique():
    names = [c[0] for c in CASES]
    assert len(names) == len(set(names))
