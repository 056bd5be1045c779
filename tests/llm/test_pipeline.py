"""Each stage's result on its own input, and the whole run."""

from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from gravelake.llm import pii, quality_rules
from gravelake.llm._store import materialise

from .test_dedup import brute_force
from .test_tokens import check_pieces


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        rows = docs.collect()
        seen[name] = before, rows
        if name != "packing":
            assert docs.columns == columns
    before, rows = seen["quality rules"]
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert {r.doc_id for r in rows} == {i for i, k in verdict.items() if k}
    before, rows = seen["exact dedup"]
    largest = defaultdict(int)
    for r in before.values():
        largest[r.text] = max(largest[r.text], r.doc_id)
    assert {r.doc_id for r in rows} == set(largest.values())
    before, rows = seen["near dedup"]
    groups = brute_force([(i, r.text) for i, r in before.items()], 80)
    assert {r.doc_id for r in rows} == {i for i, (_, c) in groups.items() if i == c}
    before, rows = seen["pii"]
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id].text or "[" in r.text
    before, rows = seen["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(rows, {i: library.encode(r.text, add_special_tokens=False).ids for i, r in before.items()})
    whole = cp.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.doc_tokens) for r in whole if r.start == 0) == sorted((r.doc_id, r.start, r.doc_tokens) for r in rows if r.start == 0)
