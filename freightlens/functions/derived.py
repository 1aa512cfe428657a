"""Derived columns. A missing value and zero are both "nothing" wherever the model divides."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from freightlens.sources.model import CONGESTION_STATES, SEVERITIES


def or_null(x: Column) -> Column:
    """The value as a double; null for null and zero."""
    return F.nullif(x.cast("double"), F.lit(0.0))


def quotient(a: Column, b: Column) -> Column:
    """a / b; null if either is null or zero (density, utilisation, route speed, load per vehicle)."""
    return or_null(a) / or_null(b)


def product(a: Column, b: Column) -> Column:
    """a * b; null if either is null or zero (capacity index, daily load)."""
    return or_null(a) * or_null(b)


def speed_ratio(speed: Column, limit: Column) -> Column:
    """Speed by limit; a zero speed counts, a zero limit doesn't."""
    return speed.cast("double") / or_null(limit)


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage, at most 100; 0 if either is null or zero."""
    return F.least(F.lit(100.0), F.coalesce(quotient(part, whole) * 100, F.lit(0.0)))


def error_rate(errors: Column, loaded: Column) -> Column:
    """Percentage of errors among all records; 0 without records."""
    return F.coalesce(errors.cast("double") / or_null(loaded + errors) * 100, F.lit(0.0))


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).cast("double") / 3.6e9


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end; null while unfinished."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).cast("double") / 6e7


def rounded_mean(total: Column, n: Column, scale: int = 100) -> Column:
    """total / n of whole numbers not below zero in steps of 1 / scale, ties to the even step; null for no rows."""
    twice = F.nullif(2 * n.cast("long"), F.lit(0))
    up = 2 * scale * total.cast("long") + n.cast("long")
    steps = F.floor(up.cast("decimal(38,0)") / twice).cast("long")
    return (steps - F.when((up % twice == 0) & (steps % 2 == 1), 1).otherwise(0)).cast("double") / float(scale)


def congestion_state(level: Column) -> Column:
    """Code of the highest threshold at or below the level; null is unknown."""
    out = F.when(level.isNull(), "unknown")
    for at, code, _ in CONGESTION_STATES:
        out = out.when(level >= at, code)
    return out.otherwise("free")


def congestion_tone(level: Column) -> Column:
    """Tone of the state; null is muted."""
    out = F.when(level.isNull(), "muted")
    for at, _, tone in CONGESTION_STATES:
        out = out.when(level >= at, tone)
    return out.otherwise("ok")


def severity_label(severity: Column) -> Column:
    """Label; null and 0 count as 1; others are unknown."""
    known = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.nullif(severity, F.lit(0)), F.lit(1))), F.lit("unknown"))


def severity_tone(severity: Column) -> Column:
    """Tone by severity: 5, 4, 2 and above."""
    return F.when(severity >= 5, "crit").when(severity >= 4, "alert").when(severity >= 2, "warn").otherwise("ok")


def round_the_clock(hours: Column) -> Column:
    """Whether opening hours name the whole day."""
    return F.coalesce(F.contains(F.lower(hours), F.lit("round the clock")) | (hours == "00:00-24:00"), F.lit(False))


def hazard(hazard_class: Column) -> Column:
    """Whether the class is hazardous."""
    return F.coalesce(hazard_class, F.lit(0)) > 0


# Names of the hazard classes; 0 is no hazard.
HAZARDS = {0: "not hazardous", 1: "explosives", 2: "gases", 3: "flammable liquids", 4: "flammable solids", 5: "oxidisers", 6: "toxic substances", 7: "radioactive material", 8: "corrosives", 9: "other hazards"}


def hazard_label(hazard_class: Column) -> Column:
    """Name of a hazard class; a class without a name is told by its number, a missing one is 0."""
    known = F.create_map(*[F.lit(x) for pair in HAZARDS.items() for x in pair])
    own = F.coalesce(hazard_class.cast("int"), F.lit(0))
    return F.coalesce(F.try_element_at(known, own), F.concat(F.lit("class "), own.cast("string")))


def target_label(target: Column) -> Column:
    """Loader target: a script run, a known table, or the raw name."""
    return F.when(F.startswith(target, F.lit("seed:")), F.concat(F.lit("script "), F.substring_index(target, ":", -1))).otherwise(F.replace(target, F.lit("_"), F.lit(" ")))


def thousands(x: Column, digits: int = 0) -> Column:
    """Digits grouped by blanks, decimal comma."""
    return F.translate(F.format_number(x.cast("double"), digits), ",.", " ,")


def tons(x: Column) -> Column:
    """Tons in the unit that suits: t, kt, Mt."""
    x = x.cast("double")
    return F.when(x >= 1e6, F.concat(thousands(x / 1e6, 2), F.lit(" Mt"))).when(x >= 1e3, F.concat(thousands(x / 1e3, 1), F.lit(" kt"))).otherwise(F.concat(thousands(x, 0), F.lit(" t")))


def lenient_double(x: Column) -> Column:
    """A number with a decimal comma or point; null if it's none."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def plain_decimal(x: Column) -> Column:
    """Text of a decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def yes_no(x: Column) -> Column:
    """Boolean as a word."""
    return F.when(x, "yes").when(~x, "no")


def shortened(x: Column, n: int) -> Column:
    """At most n characters, with an ellipsis if cut; a dash for nothing."""
    return F.when(x.isNull() | (F.trim(x) == ""), "-").when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


# Cyrillic letters written as one Latin letter each, and those written otherwise.
CYRILLIC_ONE = ("абвгдеёзийклмнопрстуфхцыэ", "abvgdeeziyklmnoprstufhcye")
CYRILLIC_MANY = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def slug(x: Column, longest: int = 60) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, at most ``longest`` characters; Cyrillic is transliterated; "report" for nothing."""
    plain = F.translate(F.lower(x), "áàâäãçéèêëíìîïñóòôöõúùûü" + CYRILLIC_ONE[0], "aaaaaceeeeiiiinooooouuuu" + CYRILLIC_ONE[1])
    for letter, latin in ({"ß": "ss"} | CYRILLIC_MANY).items():
        plain = F.replace(plain, F.lit(letter), F.lit(latin))
    parts = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(parts, 1, longest), F.lit("")), F.lit("report"))


def compatible(x: Column) -> Column:
    """Text with compatible forms (wide letters, ligatures, superscripts) replaced by plain ones, which no built-in function does."""
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(plain, "string")(x)


def paragraphs(x: Column) -> Column:
    """Non-empty trimmed paragraphs."""
    return F.filter(F.transform(F.split(x, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")


def id_list(x: Column) -> Column:
    """Numbers of a comma-separated list; other parts are dropped."""
    return F.transform(F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,18}$")), lambda p: p.cast("long"))


def icon(code: Column, known: dict[str, str], default: str) -> Column:
    """Symbol of a code, or the default."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def file_size(size: Column) -> Column:
    """Bytes in the unit that suits."""
    x = size.cast("double")
    return F.when(x >= 1 << 20, F.concat(thousands(x / (1 << 20), 1), F.lit(" MB"))).when(x >= 1 << 10, F.concat(thousands(x / (1 << 10), 1), F.lit(" KB"))).otherwise(F.concat(thousands(x), F.lit(" B")))


def age_days(at: Column, now: Column) -> Column:
    """Whole days since an instant."""
    return F.datediff(now, at)
