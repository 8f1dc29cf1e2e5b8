"""Tables and fixed values of the message model."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType())}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[t]) for n, t in (c.split() for c in columns.split(","))])


MESSAGES = _table(
    "id string, chat_id string, sender_id string, sender_name string, seq long, ts long, ts_local string, local_date string, local_time string,"
    " text string, raw_line string, msg_type string, reply_to_id string, media_ref string, source_file string, line_no long, ingested_at long"
)
RUNS = _table("source_file string, file_hash string, chat_id string, total_lines long, parsed long, inserted long, skipped long, continuations long, status string")
TRANSCRIPTS = _table("message_id string, media_file string, engine string, model string, language string, duration_sec double, text string, created_at long")
VECTORS = _table("id string, kind string, text string, text_hash string, collection string, model string, embedding array<float>, chat_id string, sender_name string, local_date string, start_date string, end_date string, members array<string>")

TEXT_TYPES = ("text", "edited")
INDEXABLE_TYPES = ("text", "edited", "voice")
DEFAULT_EXCLUDE = ("system", "call", "deleted")
NOT_TALK = ("system", "call")
METRICS = ("per_sender", "response_time", "words", "emojis", "volume", "time_of_day", "sessions")

# Words that frequency and topic operators leave out.
STOP_WORDS = frozenset(
    """a ad al alla allo ai agli alle anche ancora avete aveva avevo bene che chi ci cio cioe come con cosa cosi da dal dalla
    dei del della delle di dove e ed era erano essere fa fai fare gli ha hai hanno ho i il in io la le lei lo loro lui ma me mi
    mia mie miei mio ne negli nel nella no noi non o per perche piu più puo puoi qua quando quello questa questo se sei senza si
    siamo sono sta stai su sua sue sul sulla suo suoi te ti tra tu tua tue tuo tuoi un una uno va vi voi è e' ok okay the and you
    lol ahah ahaha haha hahaha ahahah ahahaha ahahahah ahahahaha cmq nn xk xkè xké poi già gia giusto tipo""".split()
)


@dataclass(frozen=True)
class Settings:
    """Defaults that affect results; each has an environment variable THREADLOOM_<NAME>."""

    timezone: str = "Europe/Rome"
    embed_model: str = "hashed-bag"
    embed_dim: int = 64
    window_size: int = 6
    window_stride: int = 3
    max_windows: int = 0

    @classmethod
    def load(cls) -> Settings:
        found = {n: os.environ[f"THREADLOOM_{n.upper()}"] for n in cls.__dataclass_fields__ if f"THREADLOOM_{n.upper()}" in os.environ}
        return cls(**{n: type(getattr(cls, n))(v) for n, v in found.items()})
