"""Column expressions for messy flow tables: all built in, none throws on bad input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.relational import finite
from flowlens.schemas import PROTOCOL_NAMES, WEEKDAYS


def number_or_null(column: Column) -> Column:
    """Text to double; anything unreadable is null, and so is NaN."""
    number = F.trim(column.cast("string")).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def number_or_zero(column: Column) -> Column:
    return F.coalesce(number_or_null(column), F.lit(0.0))


def finite_number(column: Column) -> Column:
    """Text to double with infinities as null."""
    return finite(number_or_null(column))


def text_or_nan(column: Column) -> Column:
    """Trimmed text; a null becomes the text ``nan``."""
    return F.coalesce(F.trim(column.cast("string")), F.lit("nan"))


def _protocols(key_type: str) -> Column:
    pairs = [item for number, name in PROTOCOL_NAMES.items() for item in (F.lit(number).cast(key_type), F.lit(name))]
    return F.create_map(*pairs)


def protocol_name(number: Column) -> Column:
    """Name of a protocol number given as text; other text is kept, empty is ``unk``."""
    text = F.coalesce(number, F.lit(""))
    named = F.try_element_at(_protocols("string"), text)
    return F.coalesce(named, F.when(text == "", "unk").otherwise(text))


def protocol_any(value: Column) -> Column:
    """Protocol from a name or a number in any spelling (``6``, ``6.0``, `` TCP ``); empty is ``unk``."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("nan"))))
    number = F.when(text.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double").try_cast("bigint"))
    named = F.coalesce(F.try_element_at(_protocols("bigint"), number), number.cast("string"))
    return F.coalesce(named, F.when(text == "", "unk").otherwise(text))


def first_filled(*columns: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def transport_by_port(tcp_ports: Sequence[Column]) -> Column:
    """``tcp`` if any TCP port is present, else ``udp``."""
    return F.when(first_filled(*tcp_ports).isNotNull(), "tcp").otherwise("udp")


def weekday_in(name: Column) -> Column:
    """First weekday named in a file name, else ``Unknown``."""
    text = F.lower(name)
    found = None
    for day in WEEKDAYS:
        hit = F.contains(text, F.lit(day.lower()))
        found = F.when(hit, day) if found is None else found.when(hit, day)
    return found.otherwise("Unknown")


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
