"""Column functions: lenient typing, normalisation, calendar labels, pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value in CSV files.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def null_tokens(c: Column) -> Column:
    """Null where the text is a token for a missing value."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lenient_double(c: Column) -> Column:
    """A number, or null; NaN and infinities are null too."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def lenient_int(c: Column) -> Column:
    """An integer from '4', ' 4 ', '+4' or '4.0'; null from '4.5', '1e3' or text."""
    x = F.trim(c)
    return F.when(x.rlike(r"^[+-]?\d+(\.0+)?$"), F.regexp_replace(x, r"\.0+$", "").try_cast("int"))


def lenient_timestamp(c: Column, form: str | None = None) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(form)) if form else F.try_to_timestamp(F.trim(c))


def date_and_time(date: Column, time: Column) -> Column:
    """'yyyy-MM-dd' and 'HH:mm' joined and parsed; null if either is null or malformed."""
    both = F.when(date.isNotNull() & time.isNotNull(), F.concat_ws(" ", F.trim(date), F.trim(time)))
    return F.coalesce(F.try_to_timestamp(both, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(both, F.lit("yyyy-MM-dd HH:mm:ss")))


def identifier(c: Column) -> Column:
    return F.upper(F.trim(c))


def operator_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def pseudonym(name: Column, salt: str) -> Column:
    """OP_ANON_ and eight hex digits of a salted SHA-256; null stays null."""
    return F.concat(F.lit("OP_ANON_"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), name), 256), 1, 8)))


def badge_hash(name: Column, badge: Column, salt: str = "") -> Column:
    """16 hex digits of a SHA-256 over name and badge; a null counts as the text `none`."""
    parts = [F.coalesce(F.lower(F.trim(c)), F.lit("none")) for c in (name, badge)]
    return F.substring(F.sha2(F.concat(F.lit(salt), F.concat_ws("|", *parts)), 256), 1, 16)


def week_label(t: Column) -> Column:
    """Calendar year and ISO week, as in 2025-W01 for 2025-12-29."""
    return F.concat(F.year(t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def calendar(t: Column) -> dict[str, Column]:
    """year, month, day, hour, day_of_week (Monday 0), is_weekend."""
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "day_of_week": F.weekday(t), "is_weekend": F.weekday(t).isin(5, 6)}


def stopped(pieces: Column) -> Column:
    return F.coalesce(pieces == 0, F.lit(False))


def label_event(severity: Column, least: int = 4) -> Column:
    return F.coalesce(severity >= least, F.lit(False))


def any_of(*flags: Column) -> Column:
    """True if any flag is; nulls count as false."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f.cast("boolean"), F.lit(False))
    return out


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("double"))


def celsius(c: Column, suspect: float = 80.0) -> Column:
    """Fahrenheit readings (those above ``suspect``) in Celsius."""
    return F.when(c > suspect, (c - 32) * 5 / 9).otherwise(c)


def shift_of(t: Column) -> Column:
    h = F.hour(t)
    return F.when((h >= 6) & (h < 14), "matin").when((h >= 14) & (h < 22), "apres-midi").otherwise("nuit")
