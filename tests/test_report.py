"""The report's lists from one rollup equal those of the separate operators."""

import random

from helpers import dicts, trace, traces
from tracelake.operators import analytics


def test_lists_of_rollup_equal_separate_ones(spark):
    rng = random.Random(4)
    rows = [
        trace(f"t{i}", i, provider=rng.choice(["a", "", None, " b "]), model=rng.choice(["m", "n", None]), api_key_hash=rng.choice(["", None, " ", "k1", "k2"]), latency_ms=rng.choice([None, i]),
              time_to_first_token_ms=None, total_tokens=rng.choice([None, i]), estimated_cost_usd=rng.choice([None, 0.25]))
        for i in range(200)
    ]
    for given in (rows, rows[:0]):
        t = traces(spark, given)
        got = analytics.lists_of(analytics.usage_rollup(t))
        want = {"summary": analytics.summary(t), "providers": analytics.provider_rollup(t), "models": analytics.model_stats(t), "keys": analytics.key_stats(t)}
        for name, df in want.items():
            assert got[name].columns == df.columns
            assert sorted(map(str, dicts(got[name]))) == sorted(map(str, dicts(df))), name
