"""The driver contract: every query runs on the smallest tables, and SQL names are queries."""

import ast
import importlib.util
from pathlib import Path

import pytest

import confab.catalogue as catalogue

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry_module", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert set(catalogue.QUERIES) <= set(module.queries())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not n.startswith("g_") and n != "g16_search_without_snap"])
def test_query_runs(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_core_does_not_need_the_training_package():
    for path in (ROOT / "confab").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
