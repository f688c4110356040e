import pytest

from subsidia.operators import fit
from subsidia.plans import queries as plans, sql as S
from subsidia.plans.queries import QUERIES, SQL
from tests.compare import connection, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, SQL[name])


def test_fit_lowers_the_objective(spark, sf_dir):
    found = {r["name"]: r["value"] for r in QUERIES["q41_fit_small"](spark, sf_dir).collect()}
    assert found["final_objective"] < found["initial_objective"]


def test_registered_fit_runs_to_its_end(spark, sf_dir):
    found = {r["name"]: r["value"] for r in QUERIES["q41_fit_small"](spark, sf_dir).collect()}
    model = plans.MODEL.with_theta([found[f"theta{i}"] for i in range(len(plans.MODEL.theta))])
    pixels = plans.usable(plans.masked_pixels(spark, sf_dir))
    assert fit.fit(pixels, model, plans.DESIGN, (0, 0, 0))[1]["gradient_norm"] < 1e-4


def test_fitted_objective_in_sql(spark, sf_dir, con):
    """The objective at the parameters that q41 finds, computed anew by the other engine."""
    found = {r["name"]: r["value"] for r in QUERIES["q41_fit_small"](spark, sf_dir).collect()}
    model = plans.MODEL.with_theta([found[f"theta{i}"] for i in range(len(plans.MODEL.theta))])
    prior = 0.5 * model.ridge * model.gamma_norm**2
    sql = f"WITH {S.PX}, {S.model(m=model)} SELECT (sum(res_sin * res_sin + res_cos * res_cos) * {0.5 / model.sigma**2} + {prior}) / (2 * count(*)) FROM mf"
    assert con.execute(sql).fetchone()[0] == pytest.approx(found["final_objective"], rel=1e-9)


def test_fold_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["q01_fold_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))]" in plan
    assert "o_orderpriority" not in plan


def test_entry_contract(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "fold_id"
