"""Every registered query with SQL gives the same rows as DuckDB; the others run."""

import os

import duckdb
import pytest

from tidemark.plans import queries as plans
from tidemark.plans import books, cohorts, details, exports, fleet, intake, ladder, planning, registers, streams, summaries  # noqa: F401  (add their queries to those of plans)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that have no rows at this size: too few to train on, no day with all series, no country that lacks a value.
EMPTY = {"p17_feature_matrix", "p18_fit_predict_forest", "p18_fit_predict_boosting", "p19_fit_predict_network", "g19_headline_tiles", "w9_estimate_missing", "w10_whole_cohort"}
#: Steps of rounded scores, which may go either way where a half is met in doubles.
STEPS = {"a16_score_retention_horizon": 0.1}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, found):
    """Rows by their columns in order of name, sorted by what is no float; not-a-number and null are alike."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None or v != v else v if isinstance(v, float) else str(v)
    made = [tuple(plain(r[i]) for i in order) for r in found]
    return [names[i] for i in order], sorted(made, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


def close(a, b, step):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(float(a) - float(b)) <= step + 1e-6 * max(1.0, abs(float(a)))
    return a == b


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    assert got or name in EMPTY
    if name in plans.SQL:
        want = db.execute(plans.SQL[name])
        columns = [c[0] for c in want.description]
        (names, mine), (wanted, theirs) = rows(df.columns, got), rows(columns, want.fetchall())
        assert names == wanted and len(mine) == len(theirs)
        apart = [(x, y) for x, y in zip(mine, theirs, strict=True) if not all(close(a, b, STEPS.get(name, 0.0)) for a, b in zip(x, y, strict=True))]
        assert not apart, apart[:3]
