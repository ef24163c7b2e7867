"""The pipeline's stages on hard documents."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_decontaminate import plain
from tests.llm.test_tokens import plain_ids


def test_stages_and_their_decisions(spark, tmp_path):
    from tokenizers import Tokenizer

    from airgauge.llm.queries import tokenizer_path

    folder = str(tmp_path)
    items = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [*cases.hard_texts(), (800, f"before {items[0][1]} after"), (801, f"before {items[0][1]} after")]
    docs = cases.stored(spark, tmp_path / "d", rows, lang=lambda i: "en")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        results.append(docs)
    known = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    assert cases.in_order(results[0].select("doc_id", "text").collect()) == cases.in_order(known)
    assert results[0].columns == results[1].columns == results[2].columns
    groups: dict = {}
    for (d, n, component), row in zip(cases.components(known, 5, 80, 100), known):
        groups.setdefault(component if n else ("alone", d), []).append(row)
    one = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert cases.in_order(results[1].select("doc_id", "text").collect()) == cases.in_order(one)
    clean = [row for row, (_, _, hit, _) in zip(one, plain(one, items)) if not hit]
    assert len(clean) == len(one) - 1
    assert cases.in_order(results[2].select("doc_id", "text").collect()) == cases.in_order(clean)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sizes = {d: len(plain_ids(tokenizer, t)) for d, t in clean}
    got: dict = {}
    for p in results[3].collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == sizes
    assert corpus_pipeline.run(spark, folder).count() == results[3].count()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = cases.stored(spark, tmp_path / "d", cases.hard_texts()[:5], lang=lambda i: "en").limit(0)
    docs.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_no_benchmark_and_no_labels(spark, tmp_path):
    """Nothing is contaminated without a benchmark; without labelled rows no language is known."""
    folder = str(tmp_path)
    spark.createDataFrame([(None, "w1 w2"), (1, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, lang, some in (("labelled", "en", True), ("unlabelled", None, False)):
        docs = cases.stored(spark, tmp_path / name, cases.hard_texts(), lang=lambda i, lang=lang: lang)
        docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        assert bool(corpus_pipeline.run(spark, folder).count()) == some
