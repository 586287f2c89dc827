"""Connected components over long chains."""

from __future__ import annotations

import numpy as np

from fathomline.llm.components import components


def test_long_chains_end_in_one_label_each(spark):
    rng = np.random.default_rng(21)
    nodes = rng.permutation(np.arange(1, 503))
    chains = nodes[:500].tolist(), nodes[500:].tolist()
    links = spark.createDataFrame([(a, b) for chain in chains for a, b in zip(chain, chain[1:], strict=False)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {node: min(chain) for chain in chains for node in chain}
