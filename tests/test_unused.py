"""Queries of texts compute only what their columns use."""

import os

import pytest

from glyphmill.plans import registry
from tests.test_oracle import SF


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sections_need_no_tokens(spark):
    plan = registry.QUERIES["K21_sections"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" in plan and "regexp_extract_all" not in plan and "split(" not in plan and "generate" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, unused", [("E01_structure_profile", "majority wl_cv ttr bigram_diversity idea_pairs s1_fire openers"), ("S27_S28_positive_signals", "majority wl_cv bigram_diversity idea_pairs lively voice")])
def test_stages_add_only_what_is_wanted(spark, name, unused):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_sents" in plan and not [c for c in unused.split() if c in plan]
