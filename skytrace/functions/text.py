"""Names, slugs, units and codes as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix that marks a two-seater in a catalogue's model names.
TANDEM_SUFFIX = "¶tandem"

#: Latin letters with marks and the letters they stand on, by Unicode's decomposition.
_MARKED = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
_MARKED_FROM, _MARKED_TO = ("".join(x) for x in zip(*_MARKED))


def unmarked(text: Column) -> Column:
    """Latin letters without their marks, composed or not."""
    return F.regexp_replace(F.translate(text, _MARKED_FROM, _MARKED_TO), r"\p{M}+", "")


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, one hyphen for each run of anything else, none at the ends."""
    plain = F.translate(unmarked(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def like_escaped(text: str) -> str:
    """A text to be found as it is by ILIKE ... ESCAPE '\\'."""
    for sign in ("\\", "%", "_"):
        text = text.replace(sign, "\\" + sign)
    return text


def contains_ignoring_case(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def model_name(text: Column) -> Column:
    """struct(name, is_tandem) of a catalogue's model."""
    tandem = text.endswith(TANDEM_SUFFIX)
    return F.struct(F.trim(F.when(tandem, F.regexp_replace(text, TANDEM_SUFFIX + "$", "")).otherwise(text)).alias("name"), tandem.alias("is_tandem"))


def country(text: Column) -> Column:
    """Two ASCII capitals, else null."""
    code = F.upper(F.trim(text))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def flag(code: Column) -> Column:
    """The flag of a country code: its letters as regional indicators."""
    signs = F.array(*[F.lit(chr(0x1F1E6 + i)) for i in range(26)])
    at = lambda k: F.element_at(signs, (F.ascii(F.substring(code, k, 1)) - 64).cast("int"))
    return F.when(code.rlike("^[A-Z]{2}$"), F.concat(at(1), at(2)))


def sex(text: Column) -> Column:
    """m, f or d of the usual spellings, else null."""
    # Spellings of each code.
    spelled = {"m": ("m", "male"), "f": ("f", "female"), "d": ("d", "x", "diverse")}
    word, out = F.lower(F.trim(text)), F.lit(None).cast("string")
    for code, words in spelled.items():
        out = F.when(word.isin(*words), code).otherwise(out)
    return out


def email(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def full_name(first: Column, last: Column, login: Column) -> Column:
    """First and last name, whichever there are, else the login."""
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit("")))), F.lit("")), login)


def told_apart(name: Column, key: Column, taken_before: Column) -> Column:
    """A name that another row has taken before, whatever its case, with its key."""
    return F.when(taken_before, F.concat(name, F.lit(" (#"), key.cast("string"), F.lit(")"))).otherwise(name)


def short_id(*keys: Column) -> Column:
    """Eight signs of base64url that name a row by its keys; the same keys give the same name."""
    digest = F.unhex(F.sha2(F.concat_ws("\0", *keys), 256))
    return F.translate(F.substring(F.base64(digest), 1, 8), "+/", "-_")


# --- units ------------------------------------------------------------------------------------------------------------------------

# How many of the second unit make one of the first, by quantity.
_PER = {("m", "ft"): 3.280839895, ("m/s", "fpm"): 196.8503937, ("km/h", "mph"): 0.621371192, ("km", "mi"): 0.621371192}


def converted(value: Column, unit: str, into: str) -> Column:
    """A quantity in another unit of the same kind."""
    return value if unit == into else value * _PER[unit, into] if (unit, into) in _PER else value / _PER[into, unit]


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, its thousands unparted."""
    return F.translate(F.format_number(value, digits), ",", "")


def signed(value: Column, digits: int, by: Column | None = None) -> Column:
    """A number with its sign, a true minus; that of the number before it is rounded, or of `by`. 0 has none."""
    by = value if by is None else by
    return F.concat(F.when(by < 0, "−").when(by > 0, "+").otherwise(""), fixed(F.abs(value), digits))


def distance_text(metres: Column) -> Column:
    """Metres below one kilometre, else kilometres with one decimal."""
    return F.when(metres < 1000, F.concat(F.round(metres).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(fixed(metres / 1000, 1), F.lit(" km")))


def duration_text(seconds: Column) -> Column:
    """HH:MM."""
    minutes = F.floor(seconds / 60)
    return F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)


def local_time_text(epoch: Column, offset_s: Column) -> Column:
    """ISO date and time at a fixed offset from UTC."""
    return F.date_format(F.timestamp_seconds(epoch + offset_s), "yyyy-MM-dd HH:mm:ss")


def preference(own: Column, system: Column, otherwise: str) -> Column:
    """A user's choice; 'system' and null follow the system's, which may be missing too."""
    return F.coalesce(F.nullif(own, F.lit("system")), system, F.lit(otherwise))


# Regions that go by imperial units, and what the units of climb and speed are then and otherwise.
IMPERIAL_REGIONS = ("US", "GB", "LR", "MM")
FOLLOWING = {"vario_unit": ("fpm", "mps"), "speed_unit": ("mph", "kmh")}


def preferences(units: Column, vario_unit: Column, speed_unit: Column, region: Column) -> Column:
    """struct(units, vario_unit, speed_unit) without 'system': units go by the region, and the units of climb and speed by the units that
    came out. Null choices are 'system', a null region is metric."""
    of_region = F.when(region.isin(*IMPERIAL_REGIONS), "imperial")
    own = preference(units, of_region, "metric")
    follow = lambda choice, name: preference(choice, F.when(own == "imperial", FOLLOWING[name][0]), FOLLOWING[name][1])
    return F.struct(own.alias("units"), follow(vario_unit, "vario_unit").alias("vario_unit"), follow(speed_unit, "speed_unit").alias("speed_unit"))
