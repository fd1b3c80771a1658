"""The join's full comparison: every pair with a key in common, seldom more than once."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from dialogweave.llm import ngram_join


def test_pairs_meet_at_their_first_key(spark):
    r = random.Random(5)
    base = [r.randrange(-(2**62), 2**62) for _ in range(60)]
    sets = {node: set(r.sample(base, 50)) for node in range(30)}  # alike: 40 keys in common and more
    sets |= {node: set(r.sample(base, 2)) | {node} for node in range(30, 60)}
    rows = [(node, node // 2 if node < 4 else node, key) for node, keys in sets.items() for key in keys]
    members = spark.createDataFrame(rows, "node long, root long, key long").select(
        "*", F.lit(100).cast("long").alias("n"), *(F.lit(0).cast("long").alias(c) for c in ngram_join._SHORT)
    )
    met = [tuple(p) for p in ngram_join._met(members, 80).collect()]
    apart = [(a, b) for a, b in combinations(sets, 2) if {a, b} not in ({0, 1}, {2, 3})]
    assert set(met) == {(a, b) for a, b in apart if sets[a] & sets[b]}
    assert len(met) < 1.5 * len(set(met))
