from __future__ import annotations

import pytest

from terravane.operators import fitting
from terravane.plans import analysis
from terravane.queries import whole


class Reached(Exception):
    pass


def test_fire_analysis_is_registered_whole(spark, monkeypatch):
    asked = {}

    def spy(df, features, feature, series, order, k=12, permutations=None, weights=None, candidates=None):
        asked.update(permutations=permutations, candidates=candidates)
        raise Reached

    monkeypatch.setattr(analysis, "analyze", spy)
    with pytest.raises(Reached):
        whole.QUERIES["fire_analysis"](spark, "/root/testdata/sf0.001")
    assert asked["permutations"] >= 199
    assert set(asked["candidates"] or fitting.SHAPES) == set(fitting.SHAPES) and len(fitting.SHAPES) == 20
