"""Texts of a viewer, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(c: Column) -> Column:
    """Text with the five signs that HTML reads as its own written out; null stays null."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _points(n: Column, mean: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" points"), F.when(mean.isNotNull(), F.concat(F.lit(" · mean confidence "), F.format_string("%.1f", mean))).otherwise(""))


def site_status(maps: Column, n: Column, mean: Column, origin: Column) -> Column:
    """A site's summary; without maps, that there is none yet."""
    some = F.concat(F.lit("**Site:** "), maps.cast("string"), F.lit(" map(s) · "), _points(n, mean), F.lit("  \nOrigin "), origin)
    return F.when(F.coalesce(maps, F.lit(0)) == 0, F.lit("**No site yet.** Waiting for the first batch to be mapped.")).otherwise(some)


def map_status(keyframes: Column, n: Column, mean: Column, origin: Column) -> Column:
    """A map's summary; n is null before it is reconstructed, origin before it is aligned, keyframes where there is no map."""
    head = F.concat(F.lit("**Map:** "), keyframes.cast("string"), F.lit(" keyframe(s)"))
    done = F.concat(head, F.lit(" · "), _points(n, mean), F.lit("  \n"), F.coalesce(F.concat(F.lit("Origin "), origin), F.lit("Not GPS-aligned")))
    return F.when(keyframes.isNull(), F.lit("**No map selected.**")).when(n.isNull(), F.concat(head, F.lit(" · not reconstructed yet"))).otherwise(done)


def batch_status(collected: Column, capacity: Column, busy: Column) -> Column:
    """How full the open batch is."""
    return F.concat(F.lit("**Collecting:** "), collected.cast("string"), F.lit(" / "), capacity.cast("string"), F.lit(" keyframes"), F.when(busy, F.lit("  ·  **mapping in progress**")).otherwise(""))
