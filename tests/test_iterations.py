from __future__ import annotations

import inspect

import pytest

from quire.operators import significance
from quire.plans import retrieval


@pytest.mark.parametrize(("name", "query"), [("monte_carlo", retrieval.monte_carlo_p), ("seeded", retrieval.seeded_p)])
def test_registered_with_all_iterations(monkeypatch, name, query):
    real, seen = inspect.signature(getattr(significance, name)), []
    monkeypatch.setattr(retrieval, "_paired", lambda spark, sf_dir: None)
    monkeypatch.setattr(significance, name, lambda *a, **k: seen.append(b := real.bind(*a, **k)) or b.apply_defaults())
    query(None, "")
    assert seen[0].arguments["n_iter"] == 10_000
