"""Operators that use DataFrame functions only."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from strataframe.llm import registry


@pytest.mark.parametrize("name", ["op1_mixing", "op3_chat_formatting", "op4_license_scan"])
def test_no_python_on_executors(spark, sf_dir, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()[name](spark, sf_dir).explain("formatted")
    assert not re.search("Python|Pandas|MapInArrow|ExistingRDD", out.getvalue())
    assert "Cartesian" not in out.getvalue() and "NestedLoop" not in out.getvalue()
