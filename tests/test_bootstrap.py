import os
import random
from statistics import fmean

import pytest

from pagewright.operators import scoring as S
from pagewright.plans import evaluation

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 5, 64, 300, 1025])
def test_draws_are_those_of_the_plain_generator(n):
    rng, drawn = random.Random(9), S.Draws(random.Random(9).getstate(), n)
    for _ in range(5):
        assert drawn.take().tolist() == [rng.randrange(n) for _ in range(n)]
        drawn = S.Draws(drawn.state(), n)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_interval_is_that_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWS", 30_000)
    deltas = [r["delta"] for r in evaluation._deltas(spark, SF, "document").orderBy("document").collect()]
    rng, n = random.Random(7), len(deltas)
    means = sorted(fmean(deltas[rng.randrange(n)] for _ in range(n)) for _ in range(10_000))
    got = evaluation.bootstrap_interval(spark, SF).first()
    assert n > 4 and (got["lower"], got["upper"]) == pytest.approx((means[250], means[int((1 - 0.025) * 10_000)]), abs=1e-12)
