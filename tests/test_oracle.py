"""Every registered query against its DuckDB oracle on sf0.001 (the driver
does the same at sf0.01)."""

import functools
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, canon, type_mismatches  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# Reports whose thresholds, chosen for sf0.01, select nothing from sf0.001.
LARGER = "/root/testdata/sf0.01"
SELECTIVE = ("r5_", "r6_", "r7_", "r8_", "r9_yearly_top_by", "r11_yearly_sales_by", "r13_")


def views(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="module", autouse=True)
def each_job_once():
    """Queries that show different tables of the same job share its run."""
    from counterfoil.plans import catalog
    jobs = {name: getattr(catalog, name) for name in ("_placed", "_replay", "_timeline", "_by_deltas")}
    for name, job in jobs.items():
        setattr(catalog, name, functools.cache(job))
    yield
    for name, job in jobs.items():
        setattr(catalog, name, job)


@pytest.fixture(scope="module")
def duck():
    return {sf: views(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sf = LARGER if name.startswith(SELECTIVE) else SF
    df = entry.queries()[name](spark, sf)
    rel = duck[sf].execute(SQL[name])
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert not type_mismatches(df, rel)
    assert got[1] == want[1]
    assert got[1] or not name.startswith(SELECTIVE)


def test_missing_dependency_is_not_hidden(tmp_path):
    """Without the optional folder the entry imports; without a module that the folder needs it does not."""
    import shutil
    import subprocess
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(f"{root}/counterfoil", copy / "counterfoil", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{root}/__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; print(len(e.queries()))"

    def run():
        return subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                              env={**os.environ, "PYTHONPATH": str(copy)})
    out = run()
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 50
    (copy / "counterfoil" / "llm").mkdir()
    (copy / "counterfoil" / "llm" / "__init__.py").touch()
    (copy / "counterfoil" / "llm" / "registry.py").write_text("import a_module_that_is_not_there\n")
    out = run()
    assert out.returncode != 0 and "a_module_that_is_not_there" in out.stderr


def test_every_query_has_a_builder_and_runs(spark):
    qs = entry.queries()
    assert set(SQL) <= set(qs)
    for name in set(qs) - set(SQL):      # iterative operators: rows only
        assert qs[name](spark, SF).count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["yr", "staff_id", "full_name"]
    df.collect()


def test_registered_outputs_hold_no_decimal_columns(spark):
    from pyspark.sql.types import DecimalType
    for name, build in entry.queries().items():
        if name.startswith(("c3", "c9", "c11", "op", "pipeline", "s_", "s8", "v_cascade", "v_valid", "e6_returned")) or name.endswith("by_deltas"):
            continue
        df = build(spark, SF)
        assert not [f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)], name


def test_every_integrity_rule_is_met(spark):
    rules = {r["rule"] for r in entry.queries()["v_integrity_violations"](spark, SF).select("rule").distinct().collect()}
    assert rules == {f"V{i}" for i in range(1, 9)}


def test_every_rejection_reason_is_met(spark):
    from counterfoil.operators.intake import REASONS
    rows = entry.queries()["c3_admit_orders"](spark, SF).select("reason").distinct().collect()
    assert {r["reason"] for r in rows} == {None, *REASONS}
