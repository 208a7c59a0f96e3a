import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "fit" in df.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_rest_does_not_need_the_training_data_operators(tmp_path):
    """A copy without the two folders and the pipeline imports and has its queries; one with a broken operator doesn't import."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "splinewright", tmp_path / "splinewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op1') for n in e.queries()); assert 'flagship' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120, capture_output=True)
    assert run().returncode == 0
    (tmp_path / "splinewright/llm").mkdir()
    (tmp_path / "splinewright/llm/__init__.py").write_text("")
    (tmp_path / "splinewright/llm/catalog.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("ORACLE_SQL = None\n")
    assert b"no_such_module" in run().stderr


def test_queries_equal_their_sql(spark):
    """A few of the driver's comparisons, on the smallest tables."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("link_logit", "fam_gamma_totals", "knots_value_k5", "basis_cr_k3", "basis_cc_k4", "cyclic_wrap", "row_tensor", "factor_by_cr_k3", "gram_weighted", "pirls_logit_2", "pirls_gamma_2", "pirls_poisson_weighted_2_jobs", "predict_ols", "predict_fixed_sp_k3", "statistics_reml_k3", "fit_reml_gaussian_cr_k3_jobs"):
        got = entry.queries()[name](spark, sf).toPandas()
        want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
        keys = [c for c in got.columns if got[c].dtype == object or "int" in str(got[c].dtype)] or list(got.columns)
        a, b = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
        for c in got.columns:
            if a[c].dtype == float:
                assert (a[c] - b[c]).abs().max() < 2e-5, (name, c)
            else:
                assert (a[c] == b[c]).all(), (name, c)
