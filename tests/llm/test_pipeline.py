"""The pipeline's stages, one after the other, against brute force on the smallest table."""

import re
from collections import Counter

import pytest

from tests.llm.test_operators import LOW, brute_components, brute_dedup, sha

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from plinth.llm import sentencepiece_bpe
    from plinth.llm.common import staged
    from plinth.llm.registry import tokenizer_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        seen.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "contaminated", "tokens"]
    assert all(d.columns == columns for d in seen[:-1])
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]

    # only texts without letters may have gone by language here
    left = {r.doc_id for r in seen[0].collect()}
    gone = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id not in left]
    assert len(gone) <= 2

    want = brute_components(rows(seen[0]), 5, 80)
    assert Counter(i for i, _ in rows(seen[1])) == Counter(i for i in want if want[i][1] == i)

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert Counter((i, sha(" ".join(words(t)))) for i, t in rows(seen[2])) == Counter((i, h) for i, _, _, h in brute_dedup(rows(seen[1])))

    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    table = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = norm(r.text)
        table |= {tuple(w[a : a + 13]) for a in range(max(1, len(w) - 12)) if w}
    clean = []
    for i, t in rows(seen[2]):
        w = norm(t)
        hit = {a + k for n in {len(x) for x in table} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in table for k in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(i)
    assert Counter(i for i, _ in rows(seen[3])) == Counter(clean)

    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.Model(sentencepiece_bpe.read_model(tokenizer_path("piece_bpe_32k.model"))))
    assert Counter(map(tuple, seen[4].collect())) == Counter((i, *encoder.digest(t)) for i, t in rows(seen[3]))
