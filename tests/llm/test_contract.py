"""Columns and rows that each registered training-data query owes, on the smallest tables."""

import os

import pytest

from threadloom.llm import queries

DIR = "/root/testdata/sf0.001"
OWED = {
    "op1_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_mtree": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_lines": "doc_id bigint, text string",
    "op8_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_winnowing": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", OWED)
def test_contract(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    types, owed = dict(got.dtypes), dict(c.split() for c in OWED[name].split(", "))
    assert {c: types.get(c) for c in owed} == owed
    rows = [r.asDict() for r in got.collect()]
    if "query_id" in owed:
        ids = {r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect()}
        step, k = (20, 20) if name == "op1_ann" else (50, 5)
        by = {}
        for r in rows:
            by.setdefault(r["query_id"], []).append(r)
        assert set(by) == {i for i in ids if i % step == 0}
        for q, found in by.items():
            found.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in found] == [*range(1, min(k, len(ids) - 1) + 1)] and q not in {r["vec_id"] for r in found}
            assert found == sorted(found, key=lambda r: (-r["score"], r["vec_id"]))
        return
    if name in ("op11_codes", "op12_whitening"):
        ids = sorted(r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect())
        each = 1 if name == "op11_codes" else 32
        assert sorted(r["vec_id"] for r in rows) == sorted(ids * each)
        return
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect())
    if name == "op5_packing":
        by, at = {}, {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
            at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sorted(by) == ids
        for pieces in by.values():
            ends = [0]
            for start, length, _ in sorted(pieces):
                assert start == ends[-1] and length > 0
                ends.append(start + length)
            assert {p[2] for p in pieces} == {ends[-1]}
        for pieces in at.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 2048
        return
    assert sorted(r["doc_id"] for r in rows) == ids
    if "score" in owed:
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "op3_quality":
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name == "op6_minhash":
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=repr)
