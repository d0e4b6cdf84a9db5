"""Epoch seconds from the timestamp shapes found in exports, as Spark SQL expression text."""

from __future__ import annotations

from foldwise.functions.text import let, raw, strip

#: Fixed value: larger numbers are taken as milliseconds.
MILLISECOND_FLOOR = 10_000_000_000

_DATE = r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2}))"
_CLOCK = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(?:([+-])(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?"
ISO = rf"^{_DATE}(?:[\s\S]{_CLOCK}{_OFFSET})?$"
WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def _iso_micros(t: str) -> str:
    def part(i: int) -> str:
        return f"regexp_extract({t}, {raw(ISO)}, {i})"

    def number(i: int) -> str:
        return f"coalesce(try_cast({part(i)} as bigint), 0)"

    day = (
        f"try_cast(concat_ws('-', concat({part(1)}, {part(4)}), concat({part(2)}, {part(5)}), "
        f"concat({part(3)}, {part(6)})) as date)"
    )
    fields = (
        f"named_struct('d', {day}, 'h', {number(7)}, 'm', {number(8)}, 's', {number(9)}, "
        f"'us', coalesce(try_cast(rpad(substring({part(10)}, 1, 6), 6, '0') as bigint), 0), "
        f"'sign', if({part(11)} = '-', -1, 1), 'oh', {number(12)}, 'om', {number(13)}, 'os', {number(14)})"
    )
    seconds = (
        "(cast(unix_date(f.d) as bigint) * 86400 + f.h * 3600 + f.m * 60 + f.s"
        " - f.sign * (f.oh * 3600 + f.om * 60 + f.os))"
    )
    valid = "f.d is not null and f.h < 24 and f.m < 60 and f.s < 60 and f.oh < 24 and f.om < 60"
    value = let(fields, "f", f"case when {valid} then {seconds} * 1000000 + f.us end")
    return f"case when {t} rlike {raw(ISO)} then {value} end"


def _week_micros(t: str) -> str:
    def part(i: int) -> str:
        return f"regexp_extract({t}, {raw(WEEK)}, {i})"

    # Week 1 holds 4 January, the last week of a year 28 December.
    monday = f"cast(date_trunc('week', try_cast(concat({part(1)}, '-01-04') as date)) as date)"
    last = f"weekofyear(try_cast(concat({part(1)}, '-12-28') as date))"
    week = f"try_cast({part(2)} as int)"
    offset = f"(({week} - 1) * 7 + coalesce(try_cast({part(3)} as int), 1) - 1)"
    micros = f"cast(unix_date(date_add({monday}, {offset})) as bigint) * 86400000000"
    return f"case when {t} rlike {raw(WEEK)} and {week} between 1 and {last} then {micros} end"


def epoch_from_text(text: str) -> str:
    """ISO-8601 text (UTC when it names no zone), else a number, else null."""
    dated = let(f"replace({text}, 'Z', '+00:00')", "t", f"coalesce({_iso_micros('t')}, {_week_micros('t')}) / 1000000.0D")
    number = let(
        strip(text), "n", f"case when n rlike {raw(NUMBER)} then try_cast(replace(n, '_', '') as double) end"
    )
    return f"coalesce({dated}, {number})"


def epoch_from_number(number: str) -> str:
    return f"if({number} > {MILLISECOND_FLOOR}, {number} / 1000.0D, {number})"


def to_epoch(value: str) -> str:
    """Epoch seconds of a VARIANT holding a number, a boolean or a string."""
    kind = "substring(schema_of_variant(ev), 1, 6)"
    number = let("try_variant_get(ev, '$', 'double')", "en", epoch_from_number("en"))
    string = epoch_from_text("try_variant_get(ev, '$', 'string')")
    return let(
        value,
        "ev",
        f"case when {kind} = 'STRING' then {string} "
        f"when {kind} not in ('OBJECT', 'ARRAY<', 'VOID') then {number} end",
    )
