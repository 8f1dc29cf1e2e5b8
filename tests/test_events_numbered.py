from threadloom.plans import catalog


def test_lines_of_an_event_type_are_numbered_without_a_window_over_it(spark, tmp_path):
    """A file of all events of a type is no one task's."""
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, id AS user_id, if(id % 4 = 0, 'a', 'b') AS event_type, '{}' AS props FROM range(200)").write.parquet(f"{tmp_path}/events.parquet")
    lines = catalog.exported_events(spark, str(tmp_path))
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString()
    for name, n in (("a.txt", 50), ("b.txt", 150)):
        assert sorted(r.line_no for r in lines.where(f"source_file = '{name}'").collect()) == list(range(1, n + 1))
