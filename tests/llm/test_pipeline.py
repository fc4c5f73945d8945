"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import brute
import corpus_pipeline as P
from jobweave.llm import queries, shared, toxicity
from test_operators import check_packing


def test_stages(spark, sf, tmp_path):
    docs = shared.table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        rows = docs.collect()
        kept[name] = len(rows)
        if name == "toxicity":
            labels = shared.table(spark, sf, "labels").where(~queries.held_out())
            full = shared.table(spark, sf, "documents")
            score = {r.doc_id: r.score for r in toxicity.score(full, toxicity.fit(full, labels)).collect()}
            assert {r.doc_id for r in rows} == {i for i in before if score[i] < 0.7}
        elif name == "line dedup":
            assert {r.doc_id for r in rows} == set(before)
            assert all(set(r.text.splitlines()) <= set(before[r.doc_id].text.splitlines()) for r in rows)
            assert any(r.text != before[r.doc_id].text for r in rows)
        elif name == "near dedup":
            root = brute.components([(i, r.text) for i, r in before.items()], 5, 80, 100)
            assert {r.doc_id for r in rows} == {i for i in before if root[i] == i}
        elif name == "decontamination":
            items = [brute.tokens(r.text) for r in shared.table(spark, sf, "benchmark").collect()]
            dirty = set()
            for i, r in before.items():
                text = " " + " ".join(brute.tokens(r.text)) + " "
                if any(" " + " ".join(t) + " " in text for t in items):
                    dirty.add(i)
            left = {r.doc_id for r in rows}
            assert not dirty & left and len(set(before) - dirty - left) <= 2
        else:
            check_packing(rows, [(i, r.text) for i, r in before.items()], 4096)
    assert P.run(spark, sf).count() == kept["packing"]
