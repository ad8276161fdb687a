"""Glider kinds, classes and launches from catalogues and from a legacy log's bit fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of each kind, in a catalogue's spelling; the bits of the legacy category and certificate; the legacy
# numbers of flexible hang-glider classes and of launches.
CLASSES = {
    "pg": ("en-a", "en-b", "en-c", "en-d", "ccc"),
    "hg": ("single_surface", "kingpost", "topless", "rigid"),
    "sp": ("thirteen_point_five_metre", "standard", "fifteen_metre", "eighteen_metre", "twenty_metre_two_seater", "open", "club", "microlift", "ultralight"),
}
PARAGLIDER, FLEX_WING, RIGID_WING, SAILPLANE, PARAMOTOR, POWERED = 1, 2, 4, 8, 16, 64
EN_A, EN_B, EN_C, EN_D = 1, 64, 128, 256
FLEX_CLASSES = {1: "kingpost", 2: "topless"}
LAUNCHES = {2: "winch", 4: "aerotow"}


def _has(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(mask) != 0


def _first(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(otherwise).cast("string"))


def glider_class(kind: Column, key: Column) -> Column:
    """A catalogue's class with underscores, null for one that the kind doesn't have."""
    fits = reduce(Column.__or__, [(kind == k) & key.isin(*names) for k, names in CLASSES.items()])
    return F.when(fits, F.translate(key, "-", "_"))


def legacy_kind(category: Column) -> Column:
    """The airframe: a paramotor is a paraglider with an engine; an engine alone tells no airframe."""
    return _first((_has(category, PARAGLIDER), "pg"), (_has(category, FLEX_WING | RIGID_WING), "hg"), (_has(category, SAILPLANE), "sp"), (_has(category, PARAMOTOR), "pg"), otherwise="other")


def legacy_propulsion(category: Column) -> Column:
    return _first((_has(category, PARAMOTOR | POWERED), "powered"), otherwise="free")


def legacy_class(category: Column, certificate: Column, flex_class: Column) -> Column:
    """The highest certificate of a paraglider; rigid, or the flexible class, of a hang glider; else unknown."""
    kind = legacy_kind(category)
    paraglider = _first((_has(certificate, EN_D), "en_d"), (_has(certificate, EN_C), "en_c"), (_has(certificate, EN_B), "en_b"), (_has(certificate, EN_A), "en_a"), otherwise="unknown")
    hang_glider = _first((_has(category, RIGID_WING), "rigid"), *[(flex_class == n, name) for n, name in FLEX_CLASSES.items()], otherwise="unknown")
    return F.when(kind == "pg", paraglider).when(kind == "hg", hang_glider).otherwise("unknown")


def legacy_launch(start: Column) -> Column:
    """Winch or aerotow; everything else starts on foot, engines too."""
    return _first(*[(start == n, name) for n, name in LAUNCHES.items()], otherwise="foot")
