"""The pipeline against its stages done by brute force, and on odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from runweave.llm import langid
from runweave.llm.common import stage_table, words
from runweave.llm.token_ids import vocabulary_path
from tests.llm.test_operators import ascii_lower, brute_components


def play(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        docs = stage_table(out, f"test-{name}")
        yield name, docs
    yield corpus_pipeline.STAGES[-1][0], corpus_pipeline.STAGES[-1][1](spark, docs, None)


def test_pipeline(spark, docs):
    stages = dict(play(spark, docs))
    got = {n: sorted((r["doc_id"], r["text"]) for r in d.collect()) for n, d in stages.items() if n != "packing"}
    model = langid.Classifier(langid.fit(docs))
    now = [(r["doc_id"], r["text"]) for r in docs.collect() if not model.classify(r["text"])[3]]
    assert got["language_id"] == sorted(now) and len(now) > 0.9 * docs.count()
    last = {}
    for k, t in sorted(now):
        last[ascii_lower(t)] = (k, t)
    assert got["exact_dedup"] == sorted(last.values())
    now = sorted(last.values())
    now = sorted((k, t) for (k, t), (_, _, c) in zip(now, brute_components(now, 5, 80)) if k == c)
    assert got["near_dedup"] == now
    first, window = {}, corpus_pipeline.REPEAT_WORDS
    for k, t in now:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    want = []
    for k, t in now:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        want.append((k, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t))
    assert got["substring_dedup"] == sorted(want)
    tool, pieces = Tokenizer.from_file(vocabulary_path()), defaultdict(list)
    for r in stages["packing"].collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {k for k, _ in want}
    for k, t in want:
        ids, at = [*tool.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)


def test_run_writes_what_the_stages_give(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    listed = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in df.collect())
    assert listed(corpus_pipeline.run(spark, str(tmp_path))) == listed(dict(play(spark, docs))["packing"])


def test_pipeline_on_odd_rows(spark, odd):
    """Of the odd rows, six have a letter and are no copies: wordless texts go, and so do one of (4, 4, 5) and no other."""
    stages = {n: d.collect() for n, d in play(spark, odd)}
    ids = lambda n: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in stages[n])
    kept = set(ids("language_id"))
    assert kept <= {-1, 4, 5, 6, 8, 9} and {4, 5, 6} <= kept
    assert ids("exact_dedup") == sorted(kept - {4}) == ids("near_dedup")
    tool = Tokenizer.from_file(vocabulary_path())
    for r in stages["substring_dedup"]:
        k = r["doc_id"] if r["doc_id"] is not None else -1
        own = [p for p in stages["packing"] if (p["doc_id"] if p["doc_id"] is not None else -1) == k]
        ids_ = [*tool.encode(r["text"], add_special_tokens=False).ids, 1]
        assert sum(p["length"] for p in own) == len(ids_) and {p["doc_tokens"] for p in own} == {len(ids_)}
    assert sorted(k for k in ids("packing") if k >= 0) and set(ids("packing")) == set(ids("substring_dedup"))


def test_pipeline_on_an_empty_table(spark, empty):
    assert [(n, d.count()) for n, d in play(spark, empty)] == [(n, 0) for n, _ in corpus_pipeline.STAGES]


def test_bench_times_every_corpus_query():
    import __spark_entry__
    import bench

    assert {n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")} <= set(bench.HEADLINE)
