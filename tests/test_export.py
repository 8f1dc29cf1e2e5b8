from threadloom.operators import ingest, media, search, stats
from threadloom.schema import MESSAGES, RUNS, TRANSCRIPTS
from threadloom.sources import export

CHAT = """17/04/2023, 14:03 - Marta: buongiorno
17/04/2023, 14:04 - Ugo: eccomi
17/04/2023, 14:05 - Marta: prima riga
seconda riga
17/04/2023, 14:06 - I messaggi sono protetti con la crittografia end-to-end.
17/04/2023, 14:07 - Ugo: <Media omessi>
17/04/2023, 14:08 - Ugo: PTT-20230417-WA0001.opus (file allegato)
17/04/2023, 14:09 - Marta: Questo messaggio è stato eliminato
17/04/2023, 14:10 - Marta: corretto <Questo messaggio è stato modificato>
17/04/23, 2:15 pm - Ugo: nel pomeriggio
17/04/2023, 14:16 - Chiamata vocale persa
17/04/2023, 14:17 - Marta: nota: due punti
"""


def load(spark, tmp_path, text=CHAT, name="Chat WhatsApp con Ugo.txt", force=False):
    (tmp_path / name).write_text(text, encoding="utf-8")
    store = str(tmp_path / "store")
    done = ingest.ingest(spark, str(tmp_path / name), store, force=force).collect()
    return done, spark.read.parquet(f"{store}/messages")


def test_line_kinds(spark, tmp_path):
    done, messages = load(spark, tmp_path)
    rows = {r.line_no: r for r in messages.collect()}
    assert len(rows) == 11 and done[0].inserted == 11 and done[0].continuations == 1
    kinds = {r["msg_type"]: r["count"] for r in stats.type_breakdown(messages).collect()}
    assert kinds == {"text": 5, "system": 1, "media": 1, "voice": 1, "deleted": 1, "edited": 1, "call": 1}
    assert rows[3].text == "prima riga\nseconda riga" and rows[3].raw_line.endswith("\nseconda riga")
    assert rows[5].sender_name is None and rows[7].media_ref == "PTT-20230417-WA0001.opus"
    assert rows[8].sender_name == "Marta" and rows[9].text == "corretto"
    assert (rows[10].local_date, rows[10].local_time) == ("2023-04-17", "14:15")
    assert rows[12].sender_name == "Marta" and rows[12].text == "nota: due punti"
    assert rows[1].ts == 1681732980 and rows[1].chat_id == "Ugo"
    assert len({r.id for r in rows.values()}) == 11


def test_reload_is_skipped_and_forced_reload_adds_nothing(spark, tmp_path):
    load(spark, tmp_path)
    again, messages = load(spark, tmp_path)
    assert again == [] and messages.count() == 11
    forced, messages = load(spark, tmp_path, force=True)
    assert forced[0].inserted == 0 and forced[0].skipped == 11 and messages.count() == 11


def test_repeats_get_numbers_and_groups_are_found(spark, tmp_path):
    text = '1/2/2024, 10:00 - Ugo ha creato il gruppo "x"\n' + "1/2/2024, 10:01 - Ugo: ok\n" * 2 + "31/02/2024, 10:02 - no date\n"
    _, messages = load(spark, tmp_path, text, "g.txt")
    ids = sorted(r.id for r in messages.where("sender_name = 'Ugo'").collect())
    assert len(ids) == 2
    assert stats.list_chats(messages).first().is_group


def test_stray_preamble_is_one_system_row(spark, tmp_path):
    _, messages = load(spark, tmp_path, "﻿before\nmore\n1/2/2024, 10:01 - Ugo: hi\n", "s.txt")
    rows = messages.orderBy("line_no").collect()
    assert [(r.msg_type, r.ts, r.text) for r in rows][0] == ("system", 0, "before\nmore") and len(rows) == 2


def test_parse_stats(spark, tmp_path):
    (tmp_path / "a.txt").write_text(CHAT, encoding="utf-8")
    r = export.parse_stats(export.parse(export.read_lines(spark, str(tmp_path / "a.txt")))).first()
    assert (r.lines, r.messages, r.continuations) == (12, 11, 1)


def test_overlapping_exports(spark, tmp_path):
    """Two exports of one chat that overlap, in one load and one after the other: every message once."""
    early = "17/04/2023, 14:03 - Marta: uno\n17/04/2023, 14:03 - Marta: uno\n17/04/2023, 14:04 - Ugo: due\n"
    late = early + "17/04/2023, 14:05 - Marta: tre\n"
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.txt").write_text(early, encoding="utf-8")
    (files / "b.txt").write_text(late, encoding="utf-8")
    together, apart = str(tmp_path / "together"), str(tmp_path / "apart")
    done = ingest.ingest(spark, str(files), together, chat_id="c").collect()
    assert sorted((r.parsed, r.inserted, r.skipped) for r in done) == [(3, 3, 0), (4, 1, 3)]
    for name in ("a.txt", "b.txt"):
        ingest.ingest(spark, str(files / name), apart, chat_id="c").collect()
    ids = [sorted(r.id for r in spark.read.parquet(f"{store}/messages").collect()) for store in (together, apart)]
    assert ids[0] == ids[1] and len(ids[0]) == len(set(ids[0])) == 4


class Fake:
    name, model = "fake", "none"

    def transcribe(self, content):
        if content == b"bad":
            raise ValueError("bad audio")
        return content.decode(), "it", 1.5


def test_transcripts(spark, tmp_path):
    rows = [(f"m{k}", "c", k, k, "voice", ref, "<audio>") for k, ref in enumerate(["a.opus", "b%20c+d.opus", "gone.opus", "x.opus"])]
    m = spark.createDataFrame(rows, "id string, chat_id string, seq long, ts long, msg_type string, media_ref string, text string")
    root = tmp_path / "media"
    root.mkdir()
    for n, c in (("a.opus", b"ciao pizza"), ("b c+d.opus", b"secondo"), ("x.opus", b"bad")):
        (root / n).write_bytes(c)
    none = spark.createDataFrame([], TRANSCRIPTS)
    dry = media.transcribe_pending(m, none, [str(root)], Fake(), dry_run=True)
    assert {r.message_id: r.status for r in dry.collect()} == {"m0": "transcribed", "m1": "transcribed", "m2": "missing", "m3": "transcribed"}
    got = media.transcribe_pending(m, none, [str(root)], Fake())
    assert {r.message_id: r.status for r in got.collect()} == {"m0": "transcribed", "m1": "transcribed", "m2": "missing", "m3": "failed"}
    kept = media.store(none, got, Fake()).cache()
    again = media.transcribe_pending(m, kept, [str(root)], Fake())
    assert {r.status for r in again.where("message_id in ('m0', 'm1')").collect()} == {"skipped"}
    full = media.effective(m, kept)
    assert full.where("text = 'ciao pizza' and msg_type = 'voice'").count() == 1
    assert media.effective(m, kept, apply=False).where("text = '<audio>'").count() == 4
    found = search.keyword_search(full.selectExpr("*", "'d' as local_date", "cast(null as string) as sender_name"), "pizza")
    assert [r.id for r in found.collect()] == ["m0"]


def test_schemas():
    assert "id" in MESSAGES.fieldNames() and "status" in RUNS.fieldNames()
