"""What a worker keeps beside its batch."""

import pandas as pd
import pyarrow as pa

from gaugeframe.llm import common, near_dedup


def test_memory_is_given_back_around_batches(monkeypatch):
    class Pool:
        def release_unused(self):
            said.append("released")

    said: list = []
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    for k in common.released(iter([1, 2])):
        said.append(k)
    assert said == ["released", 1, "released", 2, "released"]


def test_sets_of_a_batch_are_made_in_parts(spark):
    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return lambda frame: list(run(iter([frame])))

    texts = [None if k % 50 == 0 else " ".join(f"w{k % 700} x{j} y{k % 3}" for j in range(k % 9)) for k in range(2500)]
    rows = pd.DataFrame({"doc_id": range(2500), "text_hash": range(2500), "text": texts})
    run = near_dedup.fingerprints(Docs(), 3, 8)
    parts = run(rows)
    assert max(map(len, parts)) <= 1000
    alone = [run(rows.iloc[k : k + 1])[0].iloc[0] for k in range(0, 2500, 7)]
    found = pd.concat(parts, ignore_index=True)
    assert found["doc_id"].tolist() == list(range(2500))
    for x in alone:
        got = found.iloc[x["doc_id"]]
        assert (got["n_shingles"], got["cid"], got["sig"]) == (x["n_shingles"], x["cid"], x["sig"])
        assert (got["bands"] is None) == (x["bands"] is None) and (x["bands"] is None or got["bands"].tolist() == x["bands"].tolist())
