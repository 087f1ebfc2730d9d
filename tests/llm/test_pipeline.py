"""The pipeline and its stages on a small corpus, with nulls, empty tables and columns of the operators' own names."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from coreloom.llm import queries
from coreloom.llm.common import Scratch

from ..oracle import compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=12)) for _ in range(rng.randint(3, 8))]
        if i % 10 == 9:
            lines.insert(1, "Home | About | Contact | Shop | Login")
        rows.append((i, "\n".join(lines), "en", f"src{i % 4}", 0))
    rows += [(n + i, rows[i][1], "en", "src0", 0) for i in range(10)]  # exact copies
    rows += [(n + 20 + i, rows[20 + i][1].replace("\n", " "), "en", "src1", 0) for i in range(5)]  # equal words, other lines
    return rows + [(900, None, "en", None, 0), (901, "", None, "src1", 0), (902, "too short", "en", "src1", 0), (None, rows[50][1] + " tail", "en", "src2", 0)]


def test_stages(spark):
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    docs, scratch, seen = spark.createDataFrame(corpus(), DOC).withColumns({c: F.lit(1) for c in ("size", "kept", "_row", "fp", "length")}), Scratch(spark, "t"), {}
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.put(name, stage(spark, docs, ""))
        if name != "packing":
            assert docs.columns == cols
        seen[name] = docs.collect()
    clean = {r.doc_id: r for r in seen["quality_rules"]}
    assert not {900, 901, 902} & set(clean) and "Home |" not in clean[9].text and clean[9].n_chars == len(clean[9].text) and len(clean) == 136
    assert {r.doc_id for r in seen["line_dedup"]} == set(clean) and all(r.text == "" for r in seen["line_dedup"] if 120 <= (r.doc_id or 0) < 130)
    left = {r.doc_id for r in seen["near_dedup"]}
    assert set(range(120)) <= left and not left & set(range(140, 145)) and len(left & set(range(120, 130))) <= 1
    assert len(seen["near_dedup"]) == len(left)
    mixed = [r.doc_id for r in seen["mixing"]]
    assert set(mixed) <= left and all(mixed.count(i) <= 3 for i in left)
    assert sum(r.length for r in seen["packing"]) == sum(len(r.text.split()) for r in seen["mixing"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_queries_agree_with_sql(spark):
    for name, sql in queries.ORACLE_SQL.items():
        compare(spark, queries.QUERIES[name], sql)
