"""The entry points."""

from __future__ import annotations

import __spark_entry__


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 100
