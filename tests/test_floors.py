"""BM25: documents under a query's floor are left out before the best k of a range are sought."""

import numpy as np
import pyarrow as pa

from docloom.operators import postings

KINDS = {"kind": pa.int32(), "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "term": pa.string(), "places": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "query_id": pa.int64(), "terms": pa.list_(pa.string()), "idfs": pa.list_(pa.float64()), "floor": pa.float64()}


def test_floor_comes_before_the_best_k(monkeypatch):
    counts = [1 + i % 9 for i in range(100)]
    share = [2.0 * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * 30 / 30.0)) for c in counts]
    floor = sorted(share)[-5]
    rows = [{"kind": 0, "ids": list(range(100)), "lengths": [30] * 100}, {"kind": 1, "term": "a", "places": list(range(100)), "counts": counts}]
    rows += [{"kind": 2, "query_id": q, "terms": ["a", "unknown"], "idfs": [2.0, 9.0], "floor": f} for q, f in ((1, floor), (2, None), (3, max(share) + 1))]
    batch = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in KINDS.items()], names=list(KINDS))
    sought, plain = [], np.partition
    monkeypatch.setattr(postings.np, "partition", lambda x, *a: sought.append(len(x)) or plain(x, *a))
    got = [r for b in postings._met(iter([batch]), 20, 30.0, pa.int64(), pa.int64()) for r in b.to_pylist()]
    for q, least in ((1, floor), (2, sorted(share)[-20])):
        assert {r["chunk_id"] for r in got if r["query_id"] == q} == {i for i in range(100) if share[i] >= least - 1e-9}
    assert all(abs(r["score"] - share[r["chunk_id"]]) < 1e-12 for r in got) and {r["query_id"] for r in got} == {1, 2}
    assert sought == [100]
