"""Every stage against brute force on its own input, and run() against the stages one by one."""

import hashlib
from collections import defaultdict

import pytest
import tokenizers

import corpus_pipeline
from amperia.llm.bpe import default_path
from amperia.llm.common import documents, labels
from amperia.llm.quality_classifier import op9_quality_classifier

from .test_line_dedup import brute as line_brute
from .test_mixing import brute_targets, size
from .test_ngram_join import brute as component_brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), documents(spark, DATA)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    assert all(df.dtypes == steps[0].dtypes for df in steps[1:-1])
    assert all(r.n_chars == len(r.text or "") for df in steps[2:-1] for r in df.collect())


def test_quality(spark, steps):
    kept = {r.doc_id for r in op9_quality_classifier(steps[0], labels(spark, DATA)).collect() if r.score >= 0.3}
    assert texts(steps[1]).keys() == kept and 0 < len(kept) < steps[0].count()
    good = {r.doc_id for r in labels(spark, DATA).collect() if r.quality == 1}
    assert len(good & kept) >= 0.95 * len(good)


def test_lines(steps):
    before = texts(steps[1])
    assert texts(steps[2]) == {d: t for d, (_, _, t) in line_brute(list(before.items())).items()}


def test_near_duplicates(steps):
    before = texts(steps[2])
    want = {d for d, (_, c) in component_brute(list(before.items())).items() if c == d}
    assert texts(steps[3]) == {d: before[d] for d in want} and len(want) < len(before)


def test_mix(steps):
    rows, taken, per_doc = steps[3].collect(), defaultdict(int), defaultdict(int)
    sizes, own = defaultdict(int), {r.doc_id: r for r in rows}
    for r in rows:
        sizes[r.source] += size(r.text)
    for r in steps[4].collect():
        assert own[r.doc_id].text.startswith(r.text) and (r.lang, r.source) == (own[r.doc_id].lang, own[r.doc_id].source)
        taken[r.source] += size(r.text)
        per_doc[r.doc_id] += size(r.text)
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= max(64, 0.01 * want)
    assert all(n <= 3 * size(own[d].text) for d, n in per_doc.items())


def test_encoding_and_run(spark, steps):
    t = tokenizers.Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in steps[4].collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = sorted(map(tuple, steps[5].collect()))
    assert got == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == got
