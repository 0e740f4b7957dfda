"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from conftest import ROOT


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_queries_and_oracle_agree(spark):
    module = _entry_module()
    df = module.entry(spark)
    assert df.columns == ["activity", "diff", "retained", "total", "retention_rate"]
    assert df.count() > 0
    own = {name for name in module.queries() if name != "pipeline" and not name.startswith("op")}
    assert own <= set(module.oracle_sql()) <= set(module.queries())
    assert len(own) == 42
