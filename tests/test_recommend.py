"""Recommendations of all samples at once against a plain loop, and the shuffles of their plan."""

import random
from collections import defaultdict

from attrmill.operators import recommend as R


def test_batch_recommend_equals_a_plain_loop_with_one_shuffle(spark):
    rnd = random.Random(4)
    names = [f"a{i}" for i in range(12)]
    weights = {(a, b): rnd.uniform(-1, 1) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.5}
    edges = [(a, b, w) for (a, b), w in weights.items()] + [(b, a, w) for (a, b), w in weights.items()]
    held = [(s, a) for s in range(3000) for a in rnd.sample(names, rnd.randint(1, 5))] + [(None, names[0]), (None, names[1]), (3, None), (4, "other")]
    sample_attr = spark.createDataFrame(held + held[:200], "sample_id long, attribute string")
    got = R.batch_recommend(sample_attr, spark.createDataFrame(edges, "src string, dst string, weight double"), 3)

    own, sums = set(held), defaultdict(lambda: defaultdict(float))
    for s, a in own:
        for src, dst, w in edges:
            if src == a:
                sums[s][dst] += w
    want = set()
    for s in sums:
        # nothing is known to be the own of samples without an id
        best = sorted((-round(w, 9), a) for a, w in sums[s].items() if s is None or (s, a) not in own)
        want |= {(s, a, rank + 1) for rank, (_, a) in enumerate(best[:3])}
    assert {(r.sample_id, r.attribute, r["rank"]) for r in got.collect()} == want
    # samples are shuffled once by their id, sums and ranks are not
    plan = spark.createDataFrame(edges, "src string, dst string, weight double")
    plan = R.batch_recommend(sample_attr, plan, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
