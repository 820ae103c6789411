"""The pipeline, stage by stage, against plain versions of what each stage must keep."""
import re

import corpus_pipeline
import public_tokenizers
from fixtures import awkward, frame
from test_dedup import plain_exact, plain_near
from test_near_index import components
from tokenizers import Tokenizer

from firmground.llm import exact_dedup, near_dedup
from firmground.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
            assert set(kept[name][1]) <= set(before)
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.predicted for r in QUERIES["op2_toxicity"](spark, FOLDER).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not scores[r.doc_id]}
    before, after = kept["exact dedup"]
    assert {r.doc_id for r in after} == {i for i, _, _, stays, _ in plain_exact([(r.doc_id, r.text) for r in before]) if stays}
    before, after = kept["near dedup"]
    texts = [(r.doc_id, r.text) for r in before]
    root = components(texts)
    assert {r.doc_id for r in after} == {i for i, _ in texts if root[i] == i}
    before, after = kept["benchmark decontamination"]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in before if any(f" {i} " in f" {plain(r.text)} " for i in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert whole and whole <= gone and len(gone) <= len(whole) + 2
    before, pieces = kept["packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    places = sorted(p.sequence_id * 2048 + p.offset + k for p in pieces for k in (0, p.length - 1))
    assert places[0] == 0 and places[-1] == sum(want.values()) - 1


def test_edges(spark):
    texts = awkward()
    docs = frame(spark, texts)
    stay = exact_dedup.kept(docs)
    assert stay.columns == docs.columns
    want = sorted(repr(x[0]) for x in plain_exact(texts) if x[3])
    assert sorted(repr(r.doc_id) for r in stay.collect()) == want
    near = near_dedup.kept(docs).collect()
    find = plain_near(texts)
    assert sorted(repr(r.doc_id) for r in near) == sorted(repr(i) for i, _ in texts if i is None or find(i) == i)
    for stage in (exact_dedup.kept, near_dedup.kept):
        assert stage(docs.limit(0)).count() == 0
