"""The corpus pipeline, stage by stage, against the operators' own brute force."""

import pytest
from pyspark.sql import functions as F
from test_operators import SF, awkward, brute_links

import corpus_pipeline
from graphloom.llm import winnowing
from graphloom.llm.shared import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, before, SF), name)
        seen.append(docs)
        if i < 4:
            assert docs.columns == columns
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen[:4]]
    assert len(ids[0]) >= 0.98 * spark.read.parquet(f"{SF}/documents.parquet").count() and sorted(ids[0]) == sorted(ids[1])
    want = [d for d, n, c in brute_links([(r["doc_id"], r["text"]) for r in seen[1].collect()]) if d == c]
    assert sorted(ids[2]) == sorted(want)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in winnowing.brute_force([(r["doc_id"], r["text"]) for r in seen[2].collect()], bench) if r[5]}
    assert dirty and sorted(ids[3]) == sorted(set(ids[2]) - dirty)
    assert sorted({r["doc_id"] for r in seen[4].collect()}) == sorted(ids[3])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.fixture(scope="module")
def odd(spark):
    """Labelled documents, and awkward rows beside them, under columns with names that the operators use as well."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = spark.createDataFrame(awkward(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang", F.lit(None).cast("string"))
    rows = rows.withColumn("doc_id", F.col("doc_id") + 10**6).select(docs.columns).union(spark.createDataFrame([(None,) * 5], rows.schema).select(docs.columns))
    return docs.union(rows).withColumns({c: F.lit(c) for c in ("id", "row", "row_", "key", "class", "component", "group", "host_", "lines_", "score", "starts", "sequence_id", "__id")}).repartition(3)


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("i", range(5))
def test_awkward_rows_in_every_stage(spark, odd, i):
    """Nulls in any column, empty, blank and repeated rows, and clashing names; then no row at all."""
    name, stage = corpus_pipeline.STAGES[i]
    out = stored(stage(spark, odd, SF), name)
    empty = stage(spark, odd.limit(0), SF)
    assert empty.count() == 0
    rows = [r.asDict() for r in odd.collect()]
    if i < 4:
        assert out.columns == odd.columns == empty.columns
    got = [r.asDict() for r in out.collect()]
    texts = lambda rs: sorted((str(r["doc_id"]), str(r["text"])) for r in rs)
    if name == "language_id":
        assert not [r for r in got if r["text"] is None or not any(c.isalpha() for c in r["text"])]
        assert set(texts(got)) <= set(texts(rows)) and len(got) >= 60
    elif name == "line_dedup":
        assert len(got) == len(rows) and sum(r["text"] is None for r in got) == sum(r["text"] is None for r in rows)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    elif name == "ngram_jaccard_join":
        data = [(r["doc_id"], r["text"]) for r in rows]
        low = {d for d, n, c in brute_links(data) if n and d == c and d is not None}
        assert {r["doc_id"] for r in got if (r["text"] or "").split() and r["doc_id"] is not None} == low
        blank = lambda rs: sum(not (r["text"] or "").strip(" \t\n\r\f\v") for r in rs)
        assert blank(got) == blank(rows)
    elif name == "benchmark_decontamination":
        bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
        clean = [r for r, b in zip(rows, winnowing.brute_force([(r["doc_id"], r["text"]) for r in rows], bench)) if not b[5]]
        assert texts(got) == texts(clean)
    else:
        assert sum(r["start"] == 0 for r in got) == len(rows)
        assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0 and r["doc_tokens"] == 1) == sorted((str(r["doc_id"]), 1) for r in rows if not r["text"])
