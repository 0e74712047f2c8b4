"""The registered queries against DuckDB on the smallest tables, and the pipeline against its parts."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelry.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    duck.execute(ORACLES[name])
    names = [c[0] for c in duck.description]
    order = sorted(names)
    assert sorted(out.columns) == order
    want = sorted((tuple(r[names.index(c)] for c in order) for r in duck.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in out.collect()), key=repr) == want


# The whitening of embeddings has tests of its own.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op12_embedding_whitening"}))
def test_other_queries_return_every_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert QUERIES[name](spark, DATA).select("doc_id").distinct().count() == docs


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds, seen = docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, DATA), f"test-{name}")
        assert docs.dtypes == kinds
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2] and seen[4] < seen[3]
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    whole = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == seen[4]
    assert sorted(map(tuple, whole.select("doc_id", "piece", "n_tokens").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "n_tokens").collect()))


ODD = [(1, None, 0), (2, "", 0), (None, "one two three", 13), (3, "word " * 40_000, 200_000), (4, "same text, said again by all of us here", 39), (4, "same text, said again by all of us here", 39), (None, None, None), (5, "\n\n\n\n", 4)]
NAMES = ("toxic", "grade", "kept_text", "n_lines", "class_id", "representative", "__row", "n_hit", "contaminated", "piece", "bin", "id", "__id", "__hits")


@pytest.mark.parametrize("rows", [ODD, []])
@pytest.mark.parametrize("place", range(5))
def test_stages_on_odd_tables(spark, tmp_path, place, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), "n_chars")
    docs = docs.withColumns({n: F.lit("extra") for n in NAMES})
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    name, stage = corpus_pipeline.STAGES[place]
    got = stage(spark, docs, str(tmp_path)).collect()
    if not rows:
        assert got == []
    elif name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows} and sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    else:
        want = sorted(((i, t) for i, t, _ in rows), key=repr)
        if name == "near_dedup":
            want.remove((4, "same text, said again by all of us here"))
        if name == "line_dedup":
            want = [(i, t if i != 5 else "") for i, t in want]  # five empty lines: the later windows cover all but the first line
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)


def test_pipeline_decisions_equal_their_plain_forms(spark):
    """Line removal, near-duplicate classes and benchmark windows of what the toxicity stage leaves, by plain loops over all rows."""
    docs = corpus_pipeline.keep(corpus_pipeline.toxicity(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA), "test")
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    seen, texts = set(), {}
    for i, t in left:
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= set(range(k, k + 3)) if w in seen else set()
            seen.add(w)
        texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for i, t in texts.items()}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    group = {i: i for i in texts}
    for i in bags:
        for j in bags:
            if j < i and group[i] != group[j]:
                a, b = sum(bags[i].values()), sum(bags[j].values())
                common = sum((bags[i] & bags[j]).values()) if min(a, b) >= 0.8 * max(a, b) else 0
                if common >= 0.8 * (a + b - common):
                    low, high = sorted((group[i], group[j]))
                    group = {k: low if g == high else g for k, g in group.items()}
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in bench if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = {i for i in texts if group[i] == i and not any(tuple(words[i][k : k + n]) in windows for n in sizes for k in range(len(words[i]) - n + 1))}
    got = corpus_pipeline.run(spark, DATA).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(texts[i].split()) for i in clean}
