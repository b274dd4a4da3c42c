"""The registry without the training-data package."""

from __future__ import annotations

import importlib.util
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry_module  # noqa: E402


def test_registry_without_the_training_data_package(spark, monkeypatch):
    """The package is gone, with and without the pipeline file: all other queries stay."""
    real = importlib.util.find_spec
    for gone in (("paritymill.llm",), ("paritymill.llm", "corpus_pipeline")):
        with monkeypatch.context() as m:
            m.setattr(importlib.util, "find_spec", lambda name, *a, hidden=gone: None if name in hidden else real(name, *a))
            for name in [n for n in sys.modules if n.startswith("paritymill.llm") or n == "corpus_pipeline"]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, "paritymill.llm", None)  # an import of it raises
            keys = set(entry_module.queries())
            assert keys and "pipeline" not in keys and not any(k.startswith("op") and k[2].isdigit() for k in keys)
            assert set(entry_module.oracle_sql()) <= keys
            assert entry_module.entry(spark).count() > 0
