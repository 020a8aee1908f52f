"""Staged tables and their clean-up."""

import os

import pytest

from linkloom.operators.staging import cleaning_up, staged, staged_by


def test_tables_staged_inside_are_removed(spark):
    before = len(staged_by(spark))
    outer = staged(spark.range(3))
    with pytest.raises(KeyError), cleaning_up(spark):
        assert staged(spark.range(5)).count() == 5
        raise KeyError
    kept, removed = staged_by(spark)[before : before + 2]
    assert os.path.isdir(kept.removeprefix("file:")) and not os.path.exists(removed.removeprefix("file:"))
    assert outer.count() == 3
