"""The pipeline's stages, each against a brute-force version over its own input."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import sellers, words
from tests.llm.test_minhash import brute
from tidemark.llm.common import written
from tidemark.llm.decontaminate import EDITS
from tidemark.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows[name] = ({r.doc_id: r for r in before.collect()}, after.collect())
        assert name == "packing" or after.columns == columns
        before = after
    old, new = rows["toxicity"]
    assert {r.doc_id for r in new} <= set(old) and len(new) >= 0.7 * len(old) and all(old[r.doc_id] == r for r in new)
    old, new = rows["near_dedup"]
    assert {r.doc_id for r in new} == {i for i, _, _, kept in brute([(i, r.text) for i, r in old.items()], 5, 80) if kept}
    old, new = rows["decontamination"]
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = [w for w in bench if w]
    leaked = {i for i, r in old.items() if any(sellers(b, words(r.text)) <= int(EDITS * len(b) + 1e-9) for b in bench if set(b) & set(words(r.text)))}
    assert {r.doc_id for r in new} == set(old) - leaked
    old, new = rows["pii"]
    assert {r.doc_id for r in new} == set(old)
    assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in new)
    assert all(r.text == old[r.doc_id].text for r in new if not base_spans(old[r.doc_id].text) and "<" not in r.text)
    old, new = rows["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(t.encode(r.text, add_special_tokens=False)) + 1 for i, r in old.items()}
    got = {}
    for r in new:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total
    used = len({r.sequence_id for r in new})
    assert used <= -(-sum(total.values()) // 1024) * 1.03 + 1


def test_stages_edges(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and clashing column names go through every stage; so does nothing."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, "no id, mail a.b@c.example.com", None, None, None), (10**6, None, "en", "x", 0), (10**6 + 1, "", None, "x", None)]
    odd += [(10**6 + 2, "the same row twice", "en", None, 18)] * 2
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns({c: F.lit(1) for c in ("score", "kept", "start", "item_id", "component_id", "spans")})
    folder = tmp_path / "sf"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    for start in (docs, docs.limit(0)):
        before = start
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, before, str(folder)), "edges")
            if name != "packing":
                assert after.columns == docs.columns
                ids = [r.doc_id for r in after.select("doc_id").collect()]
                if before.count():
                    assert {None, 10**6, 10**6 + 1, 10**6 + 2} <= set(ids), name
                    assert ids.count(10**6 + 2) == 2, name  # rows of one id are one document
            before = after
        assert (before.count() > 0) == (start is docs)
