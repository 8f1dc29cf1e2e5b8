"""Scalar functions on text, names and dates, as Column expressions."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column, functions as F

from ..schema import STOP_WORDS

# Letters of a word, and what is a link.
WORD = "[0-9a-zàáèéìíòóùúâêîôûäëïöüç']+"
URL = r"https?://\S+|www\.\S+"
#: Lower-case Latin letters with marks, and the letters without: those that decompose into a letter from a to z and combining marks.
ACCENTED = "".join(c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower() and "a" <= normalize("NFD", c)[0] <= "z")
PLAIN = "".join(normalize("NFD", c)[0] for c in ACCENTED)
#: One emoji: a flag, a keycap, or a pictograph with modifiers and joined pictographs.
_ONE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}\x{1F000}-\x{1F2FF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"
EMOJI = rf"([\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_ONE}(?:\x{{200D}}{_ONE})*)"


def all_words(text: Column) -> Column:
    """Every word, in its own case; links are not removed."""
    return F.regexp_extract_all(text, F.lit(f"(?iu)({WORD})"), 1)


def frequency_words(text: Column, min_len: int = 3, stop_words: bool = True) -> Column:
    """Lower-case words without links, of `min_len` letters or more."""
    words = all_words(F.lower(F.regexp_replace(text, f"(?i){URL}", " ")))
    return F.filter(words, lambda w: (F.length(w) >= min_len) & (~w.isin(*sorted(STOP_WORDS)) if stop_words else F.lit(True)))


def phrase_words(text: Column, most: int = 40) -> Column:
    """Words of two letters or more for repeated phrases: the first `most` of a message."""
    return F.slice(F.filter(all_words(F.lower(text)), lambda w: F.length(w) >= 2), 1, most)


def topic_words(text: Column) -> Column:
    return frequency_words(text)


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits, without case and accents."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """How many search_tokens a text has, without making them; marks neither begin nor part one."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{300}-\x{36F}]*"))


def emojis(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMOJI), 1)


def sender_name(sender_id: Column) -> Column:
    """What follows the first `::` of a sender's id; the whole id without one."""
    at = F.instr(sender_id, "::")
    return F.when(at > 0, F.substring(sender_id, at + 2, F.length(sender_id))).otherwise(sender_id)


def clip(text: Column, most: int = 400) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def human_seconds(seconds: Column) -> Column:
    """A duration in its largest unit, to a tenth from minutes on; ties go up: 12s, 1.5m, 2.0h, 3.3d."""

    def tenths(unit: int, sign: str) -> Column:
        n = F.floor((seconds * 20 + unit) / (2 * unit))
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(sign))

    whole = F.concat(F.floor(seconds + 0.5).cast("string"), F.lit("s"))
    return F.when(seconds < 60, whole).when(seconds < 3600, tenths(60, "m")).when(seconds < 86400, tenths(3600, "h")).otherwise(tenths(86400, "d"))


def clock(seconds: Column) -> Column:
    """A duration as two neighbouring units: 12s, 1m05s, 2h03m."""
    n = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.concat(F.floor(n / 60).cast("string"), F.lit("m"), two(n % 60), F.lit("s"))
    hours = F.concat(F.floor(n / 3600).cast("string"), F.lit("h"), two(F.floor(n / 60) % 60), F.lit("m"))
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(n < 3600, minutes).otherwise(hours)


def bar(value: Column, most: Column, width: int = 24) -> Column:
    """A bar of full blocks, `width` of them for `most`; empty where `most` is not above 0."""
    return F.when(most > 0, F.repeat(F.lit("█"), F.bround(value / most * width).cast("int"))).otherwise("")


def week_of_year(day: Column) -> Column:
    """Weeks begin on Mondays; the days before the first one are week 00."""
    return F.lpad(F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("string"), 2, "0")


def period(local_date: Column, bucket: str, week: str = "-W") -> Column:
    """Label of a day, week, month or year; null where the date is not one."""
    day = F.try_to_date(local_date, "yyyy-MM-dd")
    if bucket == "week":
        return F.concat(F.date_format(day, "yyyy"), F.lit(week), week_of_year(day))
    return F.date_format(day, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[bucket])


def weekday(local_date: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(F.try_to_date(local_date, "yyyy-MM-dd")) - 1


def hour(local_time: Column) -> Column:
    return F.substring(local_time, 1, 2).cast("int")


def unquote(name: Column) -> Column:
    """Percent-decoding that keeps `+`."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def message_document(name: Column, text: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(": "), text)).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
