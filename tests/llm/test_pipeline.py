"""The pipeline's stages, each against what its own input calls for."""

import re

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        from wakefold.llm.store import stored

        frames.append(stored(stage(spark, frames[-1], FOLDER), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames[-1].columns == columns
    texts = [{r.doc_id: r.text or "" for r in f.collect()} for f in frames[:5]]
    assert set(texts[1]) <= set(texts[0]) and set(texts[3]) == set(texts[2])
    sets = {}
    for i, t in texts[2].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    assert not any(
        100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[:n]
    )
    pieces = frames[5].collect()
    assert {r.doc_id for r in pieces} == set(texts[4])
    assert set(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_crc32").collect())) == {
        (r.doc_id, r.ids_crc32) for r in pieces
    }
