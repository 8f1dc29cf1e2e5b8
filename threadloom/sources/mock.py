"""A made-up export of any size, for tests and load trials: the same lines for the same arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NAMES = ("Ada", "Bruno", "Carla", "Dino", "Elsa")
WORDS = "sole mare pane vino treno libro gatto festa lavoro scuola pizza musica domani stasera bella grande piano forte".split()
#: Kinds of lines by thousandths of all messages, up to the number; the rest is text.
KINDS = ((12, None, "Ada ha aggiunto Bruno"), (18, None, "Chiamata vocale"), (38, True, "<Media omessi>"), (48, True, "PTT-20230417-WA0001.opus (file allegato)"), (52, True, "Questo messaggio è stato eliminato"))


def export_lines(spark: SparkSession, messages: int, start: str = "2020-01-01", days: int = 2000, seed: int = 7, name: str = "mock.txt") -> DataFrame:
    """source_file, line_no (rising, with gaps) and value, in the order of time and without a shuffle.

    Chats grow over the years and evenings are fuller; 52 of 1,000 messages are not text, 3 of 1,000 stand twice, and every 97th has two lines.
    """

    def draw(purpose: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), "id"), F.lit(n)).cast("int")

    at = F.pow(F.col("id") / messages, 0.8) * days
    minute = F.floor(F.pow(at - F.floor(at), 0.6) * 1440).cast("int")
    day = F.date_format(F.date_add(F.lit(start).cast("date"), F.floor(at).cast("int")), "dd/MM/yyyy")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    header = F.concat(day, F.lit(", "), two(F.floor(minute / 60)), F.lit(":"), two(minute % 60), F.lit(" - "))
    sender = F.concat(F.get(F.array(*map(F.lit, NAMES)), draw("sender", len(NAMES))), F.lit(": "))
    word = lambda k: F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(len(WORDS))).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), draw("length", 12) + 1), word), " ")
    body = F.concat(sender, text)
    kind = draw("kind", 1000)
    for upto, spoken, phrase in reversed(KINDS):
        body = F.when(kind < upto, F.concat(sender, F.lit(phrase)) if spoken else F.lit(phrase)).otherwise(body)
    whole = F.array_repeat(F.concat(header, body), F.when(kind.between(52, 54), 2).otherwise(1))
    lines = F.when(F.col("id") % 97 == 96, F.concat(whole, F.array(F.lit("continua qui")))).otherwise(whole)
    rows = spark.range(messages).select("id", F.posexplode(lines).alias("pos", "value"))
    return rows.select(F.lit(name).alias("source_file"), (F.col("id") * 4 + F.col("pos") + 1).alias("line_no"), "value")
