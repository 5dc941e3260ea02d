"""The corpus pipeline stage by stage, and what its stages keep."""

import hashlib
import math
import re
from pathlib import Path

import numpy as np
import pytest

from stratalyn.llm import mixing, pii, quality_knn

pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists() or not Path(pipeline.VOCABULARY).exists(), reason="tables or vocabulary are not here")


def test_stages_in_order_with_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "personal data", "mixing", "encoding"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows.append(docs.count())
        if name != "encoding":
            assert docs.columns == columns
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) / len(good) > 0.97
            assert sum(i in kept for i, q in labels.items() if q == 0) < 0.3 * max(1, sum(q == 0 for q in labels.values()))
        if name == "near duplicates":
            assert docs.select("doc_id").distinct().count() == rows[-1] < rows[-2]
        if name == "personal data":
            assert docs.where("text like '%@mail%'").count() == 0 and rows[-1] == rows[-2]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows[-1] == rows[-2]
    whole = pipeline.run(spark, str(DATA))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_the_whole_is_what_plain_python_makes(spark):
    """Every stage again without Spark, but for fitted models and spans, which tests of their own hold."""
    tokenizers = pytest.importorskip("tokenizers")
    from test_forms import groups, slow_fingerprint

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality_knn.fit(table.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))
    docs = [r for r in table.collect()]

    def accepted(text):
        counts = quality_knn.damped(quality_knn.counts((text or "").encode()))
        if not counts[:, quality_knn.PARTS[0]].any():
            return model.labels.mean() >= quality_knn.THRESHOLD
        mine = model.latent(counts)[0]
        near = sorted(((-round(float(np.dot(mine, v)), 9), i) for i, v in enumerate(model.vectors)))[: quality_knn.NEIGHBOURS]
        votes = [(math.exp(quality_knn.SHARPNESS * (-s - 1)), model.labels[i]) for s, i in near]
        return sum(w * y for w, y in votes) / sum(w for w, _ in votes) >= quality_knn.THRESHOLD

    docs = [r for r in docs if accepted(r.text)]
    found = groups([slow_fingerprint(r.text) for r in docs], [r.doc_id for r in docs])
    docs = [r for r, g in zip(docs, found) if r.doc_id == g]
    spans = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans) for r in pii.find_pii(table.select("doc_id", "text")).collect()}

    def clean(r):
        out, at = [], 0
        for start, end, kind in spans[r.doc_id]:
            if start >= at:
                out.append(f"{r.text[at:start]}[{kind.upper()}]")
            at = max(at, end)
        return "".join(out) + (r.text or "")[at:]

    texts = {r.doc_id: clean(r) for r in docs}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    queue = []
    for rank, source in enumerate(sorted({r.source for r in docs}, key=lambda s: (s is None, s or ""))):
        mine = sorted((hashlib.md5(f"{mixing.SEED}{r.doc_id}".encode()).hexdigest(), r.doc_id) for r in docs if r.source == source)
        at = 0
        for e in range(mixing.EPOCHS):
            for _, i in mine:
                for begin in range(0, size[i], mixing.QUANTUM):
                    queue.append(((at + min(size[i], begin + mixing.QUANTUM)) / mixing.WEIGHTS[rank % 3], rank, i, e, min(mixing.QUANTUM, size[i] - begin)))
                at += size[i]
    left, served = sum(size.values()), {}
    for _, _, i, e, n in sorted(queue):
        served[i, e] = served.get((i, e), 0) + min(n, left)
        left -= min(n, left)
    lib, want = tokenizers.Tokenizer.from_file(pipeline.VOCABULARY), []
    for (i, _), n in served.items():
        if n:
            text = texts[i] if n == size[i] else re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % n, texts[i]).group()
            ids = lib.encode(text, add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, pipeline.run(spark, str(DATA)).collect())) == sorted(want)
