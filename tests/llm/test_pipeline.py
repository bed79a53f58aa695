"""The pipeline against its stages worked out by hand on the smallest tables."""

from collections import Counter

import corpus_pipeline
from test_dedup import components
from test_text import rows_of, spans

from lumaframe.llm import quality, secrets
from lumaframe.llm.simhash import fingerprint

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def by_hand(docs, kept):
    rows = [(i, t) for i, t in docs if i in kept]
    best = {}
    for i, t in rows:
        k = (t or "").translate(SPACE)
        best[k] = min(best.get(k, (1, 0, None)), (-len(t or ""), i, t), key=lambda x: x[:2])
    rows = sorted((i, t) for _, i, t in best.values())
    roots = components([fingerprint((t or "").encode()) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    out = []
    for i, t in rows:
        at, text = 0, ""
        for a, _, _, b in spans(t):
            if a >= at:
                text += t[at:a] + secrets.MARK
            at = max(at, b)
        out.append((i, text + (t or "")[at:]))
    return out


def test_stages(spark, small):
    kept = {r["doc_id"] for r in quality.judge(small).where("kept").collect()}
    docs = small
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == small.columns
    want = by_hand(rows_of(small), kept)
    assert sorted(rows_of(docs)) == want
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, _ in want)


def test_edges_and_nothing(spark, edges, nothing):
    for docs in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()
    assert docs.count() == 0
