from pyspark.sql import functions as F

from threadloom.operators import stats
from threadloom.sources import export, mock


def test_mock_export_is_parsed_whole(spark):
    lines = mock.export_lines(spark, 5000)
    assert [r.value for r in lines.collect()] == [r.value for r in mock.export_lines(spark, 5000).repartition(3).orderBy("line_no").collect()]
    parsed = export.parse(lines.withColumn("file_hash", F.lit("x"))).cache()
    kinds = {r["msg_type"]: r["count"] for r in stats.type_breakdown(parsed).collect()}
    assert set(kinds) == {"text", "system", "call", "media", "voice", "deleted"} and kinds["text"] > 4500
    assert sum(kinds.values()) == lines.where("value <> 'continua qui'").count() > 5000
    assert parsed.where("text like '%continua qui'").count() == 51
    steps = [r.ts_local for r in parsed.orderBy("line_no").collect()]
    assert steps == sorted(steps)
