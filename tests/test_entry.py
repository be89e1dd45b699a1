"""The driver's contract."""

from conftest import ROOT, SF


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_subpackage(tmp_path):
    """The entry imports and lists the engine's own queries when the other folders are gone."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    (tmp_path / "tessera" / "llm").mkdir()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_flagship_scans_prune_columns(spark):
    from tessera.plans.fixtures import Context

    plan = Context(spark, SF).build_edges()._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
