"""Every stage of the pipeline against the plain results of the operators' tests, on its own input."""

import corpus_pipeline
from mapwright.llm import quality
from tests.llm.test_operators import plain_components, plain_hits, plain_lines


def test_stages_on_their_own_inputs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names, inputs = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(stage(spark, inputs[-1], sf).cache())
        assert inputs[-1].columns == docs.columns
    rows = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in inputs]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good, poor = ({r["doc_id"] for r in labels.where(f"quality = {k}").collect()} & set(rows[0]) for k in (1, 0))
    assert good <= set(rows[1]) and len(poor) > 5 and len(poor - set(rows[1])) >= 0.9 * len(poor)
    assert set(rows[1]) == {r["doc_id"] for r in quality.score_quality(docs).where("kept").collect()}
    assert rows[2] == plain_lines(list(rows[1].items()))
    assert set(rows[3]) == {i for i, (_, c) in plain_components(list(rows[2].items())).items() if i == c}
    hits = {i: plain_hits(t, items) for i, t in rows[3].items()}
    assert set(rows[4]) == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    packed = corpus_pipeline.STAGES[-1][1](spark, inputs[-1], sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows[4])


CLASHING = ["id", "key", "own", "print", "_own", "_print", "_gone", "_id", "_tag", "_near", "_links", "component", "tag", "h1", "h2", "a", "b", "score", "bucket", "n", "shingles", "k", "row", "_row"]


def test_stages_on_odd_rows_and_clashing_names(spark):
    """Nulls in any column, empty and repeated rows, ties, and extra columns of every name that the stages use."""
    text = " ".join(f"{w}{k}" for k in range(30) for w in ("good", "plain", "prose"))
    rows = [(None, None), (None, text + " of no id"), (1, text), (1, text), (2, text), (3, ""), (4, None), (5, "one line\n" + text.replace("good3 ", "bad3 ")), (6, text.upper())]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])
    sf, inputs = "/root/testdata/sf0.001", [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(stage(spark, inputs[-1], sf).cache())
        assert inputs[-1].columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    left = [sorted((r["doc_id"] or 0) for r in d.collect() if r["text"]) for d in inputs]
    # 2 loses its only line; the others with words are near the row without an id
    assert left[1:] == [[0, 1, 1, 2, 5, 6], [0, 1, 1, 5, 6], [0], [0]]
    last = corpus_pipeline.STAGES[-1][1](spark, inputs[-1], sf)
    assert last.count() >= 2 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_operators_take_clashing_names(spark):
    from tests.llm.test_operators import RUNS

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string").selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(CLASHING)])
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string").selectExpr("*", "5 as id", "6 as key", "7 as size")
    for name, run in RUNS.items():
        if name != "toxicity":
            assert run(docs, bench).count() == 3, name
