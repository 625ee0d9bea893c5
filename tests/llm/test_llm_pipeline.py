"""The pipeline against its stages in plain Python, on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from logsift.llm import mixing
from logsift.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark, tmp_path):
    from test_llm_dedup import brute_components, shingle_set, similar
    from test_llm_placing import brute_copies

    docs = table(spark, FOLDER, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        kept[name] = docs.collect()
    known = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect()}
    before = {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}
    gone = set(before) - {r.doc_id for r in kept["toxicity"]}
    wrong = [i for i, t in known.items() if (i in gone) != bool(t)]
    assert len(wrong) <= 0.05 * len(known)

    clean = {r.doc_id: r.text for r in kept["toxicity"]}
    largest = {}
    for i, t in clean.items():
        largest[t] = max(i, largest.get(t, i))
    assert sorted(r.doc_id for r in kept["exact dedup"]) == sorted(largest.values())

    sets = {r.doc_id: shingle_set(r.text) for r in kept["exact dedup"]}
    want = set(brute_components(sets, similar).values())
    near = kept["simhash near-dedup"]
    assert {r.doc_id for r in near} == want and len(near) == len(want)

    size = Counter()
    for r in near:
        size[r.source] += len((r.text or "").encode()) + 1
    total = sum(n**mixing.EXPONENT for n in size.values())
    copies = {r.doc_id: brute_copies(r.doc_id, sum(size.values()) * size[r.source] ** mixing.EXPONENT / total / size[r.source]) for r in near}
    assert Counter(r.doc_id for r in kept["mixing"]) == +Counter(copies)

    from hashlib import sha256

    texts = {r.doc_id: sha256((r.text or "").encode()).hexdigest() for r in near}
    last = kept["sentencepiece"]
    assert Counter(r.doc_id for r in last) == +Counter(copies)
    assert all(r.decoded_sha256 == texts[r.doc_id] for r in last)
