from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def without_repeats(rows):
    """doc_id -> what stays of its text, by counting all strings of SPAN bytes."""
    from loomspark.llm.suffix_dedup import SPAN

    data = [(i, t, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + SPAN] for _, _, b in data for j in range(len(b) - SPAN + 1))
    out = {}
    for i, t, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - SPAN + 1):
            if seen[b[j : j + SPAN]] > 1:
                gone[j : j + SPAN] = b"\1" * SPAN
        out[i] = None if t is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_empty_tables_and_odd_rows_go_through(spark, tmp_path):
    from .helpers import docs, odd_texts

    odd = docs(spark, odd_texts())
    for name, rows in (("empty", odd.limit(0)), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            found = spark.read.parquet(f"{SF}/{table}.parquet")
            (found.limit(0) if name == "empty" else found).write.parquet(f"{folder}/{table}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} <= {i for i, _ in odd_texts()} and len(got) == len({str(r.doc_id) for r in got if r.doc_id is not None}) + sum(r.doc_id is None for r in got)
        assert bool(got) == (name == "odd")


def test_stages_take_effect_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, texts = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(rows) <= kept
        if name != "encoding":
            assert out.columns == columns
        if name == "near_duplicates":
            from tests.llm.test_minhash import brute

            comps = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert ids == {int(i) for i, _, c in comps if i == c}
        if name == "benchmark_leaks":
            from tests.llm.test_decontam import brute as held

            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {int(x[0]) for x in held([(r.doc_id, r.text) for r in docs.collect()], items, 0.8)}
            assert ids == {r.doc_id for r in docs.select("doc_id").collect()} - bad
            texts = {r.doc_id: r.text for r in rows}
        if name == "encoding":
            sentencepiece = pytest.importorskip("sentencepiece")
            p = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES_MODEL)
            assert all(r.ids == p.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) for r in rows)
        if name == "quality":
            from loomspark.llm import quality_fm
            from tests.llm.test_classifiers import brute_features

            model = quality_fm.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            for r in docs.collect():
                shares, stats = brute_features(r.text, r.n_chars if r.n_chars is not None else len(r.text or ""))
                x = np.concatenate([list(shares.values()), np.clip((np.array(stats) - model.mean) / model.spread, -6, 6)])
                at = [*shares, *range(quality_fm.WORDS, quality_fm.WORDS + quality_fm.STATISTICS)]
                v = model.factors[at] * x[:, None]
                z = model.bias + model.linear[at] @ x + ((v.sum(0) ** 2).sum() - (v * v).sum()) / 2
                assert abs(z) < 1e-4 or (r.doc_id in ids) == (z > 0)
        if name == "repeated_passages":
            want = without_repeats([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id: r.text for r in rows} == want
        path = f"{tmp_path}/{name}"
        out.write.mode("overwrite").parquet(path)
        docs, kept = spark.read.parquet(path), len(rows)
    assert kept > 0
    assert corpus_pipeline.run(spark, SF).count() == kept


def test_encoding_makes_the_round_trip(spark):
    from .helpers import docs, odd_texts

    texts = docs(spark, odd_texts())
    got = corpus_pipeline.encoding(spark, texts, SF).collect()
    assert len(got) == len(odd_texts()) and all(r.round_trip is True for r in got)
    want = corpus_pipeline.pieces.encode(texts, corpus_pipeline.PIECES_MODEL).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r.doc_id), r.ids) for r in want)
