import importlib
import os
import sys

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _entry():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return importlib.import_module("__spark_entry__")


def test_entry_contract(spark):
    e = _entry()
    df = e.entry(spark)
    assert df.count() >= 0 and {"marker", "method", "r", "p", "z"} <= set(df.columns)
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cartesian_or_python_udf(spark):
    from tagspace.catalog import QUERIES
    for name in ("tag_distance_matrix", "common_tags", "mantel_pearson", "experiment"):
        p = _plan(QUERIES[name](spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                    "ArrowEvalPython"):
            assert bad not in p, (name, bad)


def test_scan_prunes_columns_and_pushes_filters(spark):
    from tagspace.sources.tables import table
    df = table(spark, SF, "events").filter(F.col("event_type") == "click").select("event_id")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_python_tasks_run_from_another_folder(tmp_path):
    """The package reaches the executors' Python workers wherever the driver was started."""
    import subprocess
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as e\n"
            "from tagspace.session import local_session\n"
            "s = local_session(2, driver_memory='2g')\n"
            f"print('ROWS', e.queries()['twin_distance_matrix'](s, {SF!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=240)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
