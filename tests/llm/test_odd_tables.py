"""Repeated ids and columns with clashing names."""

from pyspark.sql import functions as F

from threadloom.llm import licenses, lines, sharding


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    shared, other = "this line is shared by both of the texts", "a unique line that stands nowhere else"
    rows = [(1, f"{shared}\n{other}"), (1, f"quite another opening of the text\n{shared}"), (2, shared), (2, shared), (None, shared)]
    got = sorted((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect())
    whole = "\n".join(t for k, t in got if k == 1)
    assert whole.count(other) == 1 and whole.count("quite another") == 1 and whole.count(shared) == 1
    assert [t for k, t in got if k == 2] == ["", ""]


def test_shards_keep_clashing_columns(spark):
    names = ["__rn", "__n", "__target", "__pid", "__at", "rn", "n", "target", "pid", "at", "own"]
    df = spark.range(40).select(F.col("id").alias("doc_id"), *((F.col("id") * 10 + k).alias(c) for k, c in enumerate(names)), F.lit("x").alias("shard")).repartition(3)
    rows = sharding.shards(df, 3).collect()
    assert sorted(r.doc_id for r in rows) == [*range(40)]
    assert all(r[c] == r.doc_id * 10 + k for r in rows for k, c in enumerate(names))
    for s in range(3):
        own = sorted(r.slot for r in rows if r["shard"] == s)
        assert own == [*range(len(own))] and len(own) in (13, 14)


def test_licences_with_clashing_columns_and_no_rows(spark):
    mit = dict(licenses.TEMPLATES).get("MIT") or licenses.TEMPLATES[0][1]
    names = ["__license", "__score", "__path", "__file", "__own", "__dir", "own", "near", "u"]
    df = spark.createDataFrame([("a/LICENSE", mit, *names), ("a/b/c.txt", "plain words", *names), ("d.txt", None, *names)], "path string, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r.path: r for r in licenses.scan(df, F.col("path")).collect()}
    assert all(r[c] == c for r in got.values() for c in names)
    assert got["a/LICENSE"].license_from == "own" and got["a/b/c.txt"].license_from == "inherited" and got["d.txt"].license is None
    assert licenses.scan(df.where("false"), F.col("path")).collect() == []
