"""A neighbour search that has to choose its lists, and the additive model against plain Python."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import ann, gam


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_where_lists_are_pruned(spark, tmp_path, spread):
    """20,000 vectors in 300 clusters, of equal or log-normal lengths: 16 lists or more, a part of which is read."""
    r = np.random.default_rng(11)
    n, size = 20_000, 32
    centre = r.normal(size=(300, size))
    x = centre[r.integers(0, 300, n)] + 0.4 * r.normal(size=(n, size))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * r.normal(size=(n, 1)))
    x = x.astype(np.float32).astype(np.float64)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x.astype(np.float32))}), f"{tmp_path}/v.parquet")
    assert n // ann.LIST >= 8
    found = ann.search(spark.read.parquet(f"{tmp_path}/v.parquet")).toPandas()
    queries = np.arange(0, n, 20)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    got = {q: set(g.vec_id) for q, g in found.groupby("query_id")}
    assert sorted(got) == queries.tolist() and set(found.groupby("query_id").size()) == {20}
    recall = [len(got[q] & set(b.tolist())) / 20 for q, b in zip(queries.tolist(), best, strict=True)]
    assert np.mean(recall) >= 0.95, np.mean(recall)
    row = found.sample(300, random_state=1)
    assert np.allclose(row.score, (x[row.query_id] * x[row.vec_id]).sum(1), rtol=1e-12)


def test_additive_model_by_plain_python():
    r = np.random.default_rng(3)
    x = r.random((1500, 5)).astype(np.float32)
    y = (r.random(1500) < 1 / (1 + np.exp(-(6 * np.abs(x[:, 0] - 0.5) + 4 * (x[:, 1] > 0.5) * (x[:, 2] > 0.5) - 2.5)))).astype(float)
    model = gam.Model(x, y)
    fresh = r.random((200, 5)).astype(np.float32)
    for row, score in zip(fresh, model.score(fresh), strict=True):
        bins = [sum(bool(e <= v) for e in edges) for edges, v in zip(model.edges, row, strict=True)]
        coarse = [b * gam.PAIR_BINS // (len(edges) + 1) for b, edges in zip(bins, model.edges, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[coarse[a]][coarse[b]] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert (1, 2) in model.pairs[:3]  # the interaction is found
    chance = 1 / (1 + np.exp(-(6 * np.abs(fresh[:, 0] - 0.5) + 4 * (fresh[:, 1] > 0.5) * (fresh[:, 2] > 0.5) - 2.5)))
    linear = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    plain = np.column_stack([np.ones(len(fresh)), fresh]) @ linear
    assert np.mean((model.score(fresh) - chance) ** 2) < 0.5 * np.mean((plain - chance) ** 2)


@pytest.mark.parametrize("seed", range(8))
def test_trees_by_all_cuts(seed):
    """A tree of two leaves takes the best of all cuts, and its leaves Newton's step."""
    r = np.random.default_rng(seed)
    g, h = r.normal(size=12), r.random(12) + 0.1
    gain = {c: g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1) for c in range(1, 12)}
    cut = max(gain, key=gain.get)
    want = np.concatenate([np.full(cut, g[:cut].sum() / (h[:cut].sum() + 1)), np.full(12 - cut, g[cut:].sum() / (h[cut:].sum() + 1))])
    assert np.allclose(gam._tree(g, h, 2), want)
