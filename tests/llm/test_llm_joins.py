"""Joins of near duplicates leave the driver alone, however small Spark takes their sides to be."""

import corpus_pipeline
import pytest
from conftest import plan_of
from llm_data import odd_docs

from lodeseek.llm import components as components_module
from lodeseek.llm import simhash
from lodeseek.llm.simhash import links_within, near_groups
from lodeseek.session import materialize


@pytest.fixture
def plans(monkeypatch):
    """Plans of what is stored, by label."""
    seen = {}

    def stored(df, label):
        seen[label] = plan_of(df)
        return materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", stored)
    monkeypatch.setattr(components_module, "materialize", stored)
    return seen


def test_balls_are_not_broadcast(spark):
    # Every fingerprint has 66 rows in its balls, which Spark sizes as one.
    links = links_within(spark.range(3000).selectExpr("id AS fingerprint"))
    assert "SortMergeJoin" in plan_of(links)
    wanted = sum(bin(a ^ b).count("1") <= 3 for a in range(3000) for b in range(a))
    assert links.count() == links.distinct().count() == wanted
    assert links.collect() and "Broadcast" not in plan_of(links)


def test_groups_are_not_broadcast(spark, plans):
    groups = near_groups(odd_docs(spark))
    for plan in (plans["links"], plans["components"], plan_of(groups)):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert groups.collect() and "Broadcast" not in plan_of(groups)


def test_near_dedup_stage_does_not_broadcast_balls_or_groups(spark, plans):
    docs = odd_docs(spark)
    kept = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, None)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    for label in ("links", "components", "near-groups"):
        assert "SortMergeJoin" in plans[label] and "Broadcast" not in plans[label]
