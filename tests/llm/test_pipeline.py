"""The pipeline on a small corpus: each stage's decision against plain rules on its own input."""

import random

import corpus_pipeline
from panelwright.llm.common import scratch


def test_stages(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    texts = [some(60) for _ in range(300)]
    for i in range(0, 40):
        texts[i] = " ".join(w.upper() + "!!" for w in texts[i].split())
    for i in range(50, 60):
        texts[i] = texts[49]
    item = some(30)
    texts[100] = some(20) + " " + item
    folder = scratch(spark, "sf")
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 40), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = d, []
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert out.columns == d.columns
        path = scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.collect()})
    good, single, clean, mixed = kept
    assert len(good & set(range(40))) <= 2 and len(good - set(range(40))) >= 255
    assert single == good - set(range(50, 60))
    assert clean == single - {100}
    assert mixed < clean and len(mixed) >= 0.6 * len(clean)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in tokens} == mixed and sorted(r.start for r in tokens)[0] == 0


def test_near_dedup_judges_rows_by_their_texts(spark):
    draw = random.Random(12)
    some = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    cut = lambda t, k: " ".join(t.split()[: 104 - k])
    a, b, c, e, f, g = (some(104) for _ in range(6))  # 100 shingles each
    rows = [
        (1, a), (1, b), (1, a),  # one id, two texts, one of them twice
        (2, c), (3, cut(c, 20)), (4, cut(c, 21)),  # 0.80 of the first: a near copy; 0.79 of the first, but 79 / 80 of the second
        (5, e), (6, cut(e, 21)),  # 0.79
        (None, f), (None, f), (None, cut(f, 20)), (None, some(30)),  # null ids
        (None, g), (8, cut(g, 10)), (None, ""), (9, None),
    ]
    d = spark.createDataFrame([(i, t, "en", "src0", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, d, "")
    assert out.columns == d.columns
    got = {r.n_chars for r in out.collect()}
    assert got - {0, 2, 8, 9, 10} == {1, 3, 6, 7, 11, 13, 14, 15}
    assert len(got & {0, 2}) == 1 and len(got & {8, 9, 10}) == 1


def test_stages_with_nulls_and_clashing_names(spark):
    """Columns named like the stages' working columns, nulls everywhere, and tables without rows."""
    folder = scratch(spark, "sf")
    draw = random.Random(13)
    some = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i if i % 9 else None, None if i % 10 == 0 else "" if i % 10 == 1 else some(40), None if i % 4 == 0 else "en", None if i % 5 == 0 else "src0", i, "c", i, "d", None) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, key long, domain string, component_id long"
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, folder)
            assert out.columns == docs.columns, name
            path = scratch(spark, "stage")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count() and (docs.count() > 20) == bool(data)
