import pytest
from pyspark.sql import functions as F

from threadloom.operators import rollup, stats
from threadloom.operators.ingest import Archive
from threadloom.sources.store import Conflict, shared_folder


def lines(spark, name, bodies):
    return spark.createDataFrame([(name, f"hash {len(bodies)}", k + 1, f"{1 + k % 9:02d}/0{1 + k % 5}/2024, {k % 24:02d}:{k % 60:02d} - {b}") for k, b in enumerate(bodies)], "source_file string, file_hash string, line_no long, value string")


def test_kept_statistics_equal_a_recount(spark):
    archive = Archive(spark, shared_folder(spark))
    kept = rollup.Rollup(archive, shared_folder(spark))
    assert kept.refresh() == 0 and kept.states().count() == 0 and kept.per_sender().count() == 0
    a = [f"S{k % 3}: words of {k}" for k in range(30)] + ["S1: <Media omessi>", "Someone created group \"x\"", "S2: "]
    loads = [lines(spark, "a.txt", a), lines(spark, "b.txt", [f"T{k % 2}: more {k}" for k in range(20)]), lines(spark, "a.txt", [*a, "S0: later", "S9: new"])]
    for k, load in enumerate(loads):
        archive.load(load, "UTC")
        if k != 1:
            assert kept.refresh() == (1 if k == 0 else 2)
    assert kept.refresh() == 0
    everything = archive.messages()
    assert everything.count() == 55 == kept.states().agg(F.sum("messages")).first()[0]

    def same():
        for where in ({}, {"chat_id": "b"}, {"sender": "S1", "date_from": "2024-02-01", "date_to": "2024-04-30"}):
            for name, options in (("per_sender", {}), ("volume", {"bucket": "day"}), ("volume", {}), ("hours", {}), ("weekdays", {})):
                assert getattr(kept, name)(**options, **where).collect() == getattr(stats, name)(everything, **options, **where).collect(), (name, where)
        for name in ("type_breakdown", "top_senders"):
            assert getattr(kept, name)().collect() == getattr(stats, name)(everything).collect()
        assert sorted(kept.senders().collect()) == sorted(stats.senders(everything).collect())
        assert stats.shown_chats(kept.chats(), "Europe/Rome").collect() == stats.list_chats(everything, "Europe/Rome").collect()

    same()
    kept.merge()
    kept.tidy()
    assert kept.states().groupBy(*rollup.BY).count().where("count > 1").isEmpty()
    same()


def test_a_load_counts_once(spark):
    archive = Archive(spark, shared_folder(spark))
    archive.load(lines(spark, "a.txt", ["S: one", "S: two"]), "UTC")
    kept = rollup.Rollup(archive, shared_folder(spark))
    before = kept.store.read
    stale = before()
    kept.refresh()
    kept.store.read = lambda: stale
    with pytest.raises(Conflict):
        kept.refresh()
    kept.store.read = before
    assert kept.states().agg(F.sum("messages")).first()[0] == 2
