"""The pipeline's stages, one after the other, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_corpus import SF, brute_hits, brute_join, brute_repetition, texts_of
from weftgraph.llm import mixing, repetition
from weftgraph.llm._common import stage


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mix_sources", "token_store")

    kept = stage(functions[0](spark, docs, SF), "s0")
    assert kept.schema == docs.schema
    want = set()
    for d, x in texts_of(docs):
        n, _, _, _, again, covered, longest = brute_repetition(x)
        if n >= 10 and 100 * again <= 20 * n and covered <= repetition.MAX_COVERED * n and longest <= max(repetition.MAX_LONGEST * n, repetition.MIN_REPEAT):
            want.add(d)
    assert {r.doc_id for r in kept.collect()} == want

    single = stage(functions[1](spark, kept, SF), "s1")
    by, _ = brute_join(texts_of(kept))
    assert {r.doc_id for r in single.collect()} == {lead for _, lead, _, _ in by}

    clean = stage(functions[2](spark, single, SF), "s2")
    assert {r.doc_id for r in clean.collect()} == {k[0] for k in brute_hits(texts_of(single), bench) if not k[2]}

    mixed = stage(functions[3](spark, clean, SF), "s3")
    assert mixed.schema == docs.schema
    sizes = Counter()
    for r in clean.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    target, got = mixing.targets(sizes), Counter()
    for r in mixed.collect():
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(got[s] <= 2 * sizes[s] for s in target)
    assert abs(sum(got.values()) - float(sum(target.values()))) < 0.05 * float(sum(target.values()))

    out = functions[4](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} == set(rows[0].asDict())
