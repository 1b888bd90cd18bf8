"""Parameters are taken as given or refused, never cut without notice."""

import pytest

from lexiflow.operators import models as ML


def test_too_deep_trees_are_refused():
    with pytest.raises(ValueError):
        ML.random_forest(max_depth=31)
    assert ML.random_forest(max_depth=30).getMaxDepth() == 30
    assert ML.random_forest().getMaxDepth() == ML.MAX_DEPTH
