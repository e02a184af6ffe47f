"""The pipeline's stages: each one's decisions against plain versions on its own input."""

import hashlib
import random
import re

import tiktoken

import corpus_pipeline
from lamella.llm import bpe


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "re", "on", "an"]) for _ in range(rng.randrange(1, 4)))
    token = hashlib.sha256(b"pipeline").hexdigest()[:40]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(word() for _ in range(rng.choice([40, 80, 150])))
        bad = i % 5 == 0
        if bad:
            text = " ".join(f"{w.upper()}!! $$$" for w in text.split())
        elif i % 7 == 1:
            text += f' token = "{token}" end'
        elif i % 7 == 2 and (i - 1) % 5:
            text = rows[-1][1] + " more"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0)]
    labels += [(i, int(i % 5 > 0), 0) for i in range(0, 400, 4)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [{r["doc_id"]: r for r in docs.collect()}]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "secret_scan", "source_mixing", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k < 4:
            assert docs.columns == columns
        seen.append({r["doc_id"]: r for r in docs.collect()})
    good = {i for i in seen[0] if i < 400 and i % 5}
    assert len(good - seen[1].keys()) <= 4 and len(seen[1].keys() & {i for i in seen[0] if i < 400 and i % 5 == 0}) <= 3
    gone = seen[1].keys() - seen[2].keys()
    assert all(seen[1][i]["text"].endswith(" more") for i in gone) and gone
    assert seen[3].keys() == seen[2].keys() and not any(token in (r["text"] or "") for r in seen[3].values())
    assert all(seen[3][i]["text"] == r["text"] for i, r in seen[2].items() if token not in (r["text"] or ""))
    assert seen[4].keys() <= seen[3].keys()
    import public_tokenizers

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in seen[5].items():
        assert r["n_tokens"] == len(plain.encode_ordinary(seen[4][i]["text"])) == len(r["ids"]) // 4
        assert r["decoded_sha256"] == hashlib.sha256(seen[4][i]["text"].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == docs.count() and re.match("doc_id", whole.columns[0])


def test_stages_on_hard_rows(spark, hard, tmp_path):
    """Nulls anywhere, empty and long texts, repeated rows, more columns, no rows at all."""
    spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    blank = spark.createDataFrame([(None,) * 7] * 2, hard.schema)
    for docs in (hard, hard.unionAll(blank), hard.limit(0)):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            assert out.count() == {0: n, 1: n - 2 if n else 0, 2: n, 4: n}.get(k, out.count())
