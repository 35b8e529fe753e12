from __future__ import annotations

import inspect
import os

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


class Called(Exception):
    pass


def test_registered_queries_fit_to_the_end(spark, monkeypatch):
    """Queries without SQL leave the rounds of the operators as they are by default."""
    from trigrid.plans import model_queries as q

    def spy(original):
        def f(*args, **named):
            given = inspect.signature(original).bind(*args, **named).arguments
            raise Called({**given, **given.get("options", {})})

        return f

    monkeypatch.setattr(q, "y", q.v.counts)
    monkeypatch.setattr(q, "_pb", lambda *_: np.ones((8, 6)))
    for module, names in ((q.pmf, ["fit", "fit_cbind", "fit_rbind", "fit_delta", "fit_larch"]), (q.recal, ["pmf_regression", "pmf_regression_cbind"]), (q.bulk, ["random_bulk_cbind_sets"]), (q.cluster, ["cluster_rows"])):
        for n in names:
            monkeypatch.setattr(module, n, spy(getattr(module, n)))
    for name in ("r10_regression_delta", "r3_regression_cbind", "b3_cbind_sets", "f1_fit", "f2_fit_cbind", "f3_fit_rbind", "f4_fit_delta", "f5_fit_larch", "c1_cluster_rows"):
        with pytest.raises(Called) as called:
            q.QUERIES[name](spark, DATA)
        assert not {"iterations", "mcmc", "burnin"} & set(called.value.args[0]), name
