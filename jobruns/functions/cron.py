"""Five-field cron expressions in Spark SQL expressions.

Dialect: ``*``, numbers, lists, ranges, steps, month and weekday names, 7 as Sunday; ``L`` as the last day of
the month, ``5#2`` as its second and ``L5`` as its last Friday; ``@hourly``, ``@daily``, ``@midnight``, ``@weekly``,
``@monthly``, ``@yearly`` and ``@annually``. When day of month and weekday are both restricted, either may match.
Seconds and ``W`` count as invalid.

The last day is day 0 of a field's numbers. Weekday n of week k is n + 10 * k, the last one n + 60.

The functions take column *names* and are built as SQL text: these expressions are large, and one
parsed text is much quicker to plan than hundreds of single column calls. They work on one
expression per row; callers apply them to *distinct* expressions and join the outcome back, so the
array work does not grow with the number of jobs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (field, lowest, highest) in the order of the expression; weekday 7 folds onto 0.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
_NAMES = {
    "month": ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    "weekday": ("sun", "mon", "tue", "wed", "thu", "fri", "sat"),
}
_ITEM = r"r'^(\*|[0-9a-z]+)(?:-([0-9a-z]+))?(?:/([0-9]+))?$'"

_ALIASES = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}

# 29 February recurs after eight years at the latest (around 1900 and 2100).
HORIZON_DAYS = 8 * 366
_NEAR_DAYS = 40


def _let(var: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once under the name ``var``."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def _number(token: str, field: str) -> str:
    number = f"CAST(try_to_number({token}, '9999') AS INT)"
    if field not in _NAMES:
        return number
    names = ", ".join(f"'{n}'" for n in _NAMES[field])
    back = 0 if field == "month" else 1
    return f"coalesce({number}, CAST(nullif(array_position(array({names}), {token}), 0) AS INT) - {back})"


def _item_values(item: str, field: str, lo: int, hi: int) -> str:
    """Numbers covered by one list item, null when it is malformed."""
    parts = "struct({})".format(
        ", ".join(
            f"regexp_extract({item}, {_ITEM}, {i}) AS {name}" for i, name in ((1, "start"), (2, "end"), (3, "step"))
        )
    )
    bounds = f"""struct(
        CASE WHEN p.start = '*' THEN {lo} ELSE {_number('p.start', field)} END AS first,
        CASE WHEN p.start = '*' AND p.end <> '' THEN NULL
             WHEN p.end <> '' THEN {_number('p.end', field)}
             WHEN p.start = '*' OR p.step <> '' THEN {hi}
             ELSE {_number('p.start', field)} END AS last,
        CASE WHEN p.step = '' THEN 1 ELSE CAST(try_to_number(p.step, '9999') AS INT) END AS stride)"""
    # Sunday as the end of a range is day 7.
    last = "CASE WHEN b.last = 0 AND b.first > 0 THEN 7 ELSE b.last END" if field == "weekday" else "b.last"
    numbers = f"""CASE WHEN b.first BETWEEN {lo} AND {hi} AND {last} BETWEEN {lo} AND {hi}
             AND b.first <= {last} AND b.stride >= 1
        THEN sequence(b.first, {last}, b.stride) END"""
    plain = _let("p", parts, _let("b", bounds, numbers))
    if field == "day":
        return f"CASE WHEN {item} = 'l' THEN array(0) ELSE {plain} END"
    if field == "weekday":
        nth = f"regexp_extract({item}, r'^([0-7]|[a-z]{{3}})#([1-5])$', 1)"
        week = f"CAST(right({item}, 1) AS INT)"
        return f"""CASE WHEN {item} RLIKE r'#[1-5]$' THEN {_let("wd", _number(nth, field), f"CASE WHEN wd IS NOT NULL THEN array(wd % 7 + 10 * {week}) END")}
            WHEN {item} RLIKE r'^l[0-7]$' THEN array(CAST(right({item}, 1) AS INT) % 7 + 60)
            ELSE {plain} END"""
    return plain


def _field_values(text: str, field: str, lo: int, hi: int) -> str:
    """Ascending distinct numbers of a field, null when any of its items is malformed."""
    numbers = f"flatten(transform(split({text}, ',', -1), item -> {_item_values('item', field, lo, hi)}))"
    if field == "weekday":
        numbers = f"transform({numbers}, n -> CASE WHEN n <= 7 THEN n % 7 ELSE n END)"
    return f"array_sort(array_distinct({numbers}))"


def cron_fields(column: str) -> Column:
    """``struct<minute, hour, day, month, weekday: array<int>, either: boolean>`` or null.

    ``either``: day and weekday are both restricted, so a date qualifies by matching one of them.
    """
    text = rf"lower(regexp_replace({column}, r'(?U)^\s+|\s+$', ''))"
    aliases = " ".join(f"WHEN '{name}' THEN '{meant}'" for name, meant in _ALIASES.items())
    words = _let("e", text, rf"split(CASE e {aliases} ELSE e END, r'\s+', -1)")
    values = "struct({})".format(
        ", ".join(f"{_field_values(f'w[{i}]', n, lo, hi)} AS {n}" for i, (n, lo, hi) in enumerate(FIELDS))
    )
    names = [n for n, _, _ in FIELDS]
    # A list that covers everything counts as "*" when the other field is written with one.
    any_day = "(w[2] = '*' OR size(v.day) = 31 AND contains(w[4], '*'))"
    any_weekday = "(w[4] = '*' OR size(v.weekday) = 7 AND contains(w[2], '*'))"
    checked = "CASE WHEN {} THEN struct({}, NOT {} AND NOT {} AS either) END".format(
        " AND ".join(f"v.{n} IS NOT NULL" for n in names),
        ", ".join(f"v.{n} AS {n}" for n in names),
        any_day,
        any_weekday,
    )
    return F.expr(_let("w", words, f"CASE WHEN size(w) = 5 THEN {_let('v', values, checked)} END"))


def valid_cron(column: str) -> Column:
    """Is the expression acceptable? Never null."""
    return F.coalesce(cron_fields(column).isNotNull(), F.lit(False))


def _matches_day(fields: str, day: str) -> str:
    """Does a date satisfy the day, month and weekday fields?"""
    by_day = f"(array_contains({fields}.day, dayofmonth({day})) OR array_contains({fields}.day, 0) AND {day} = last_day({day}))"
    weekday = f"dayofweek({day}) - 1"
    week = f"(dayofmonth({day}) + 6) DIV 7"
    by_weekday = f"""(array_contains({fields}.weekday, {weekday})
        OR array_contains({fields}.weekday, CAST({weekday} + 10 * ({week}) AS INT))
        OR array_contains({fields}.weekday, {weekday} + 60) AND {day} > date_sub(last_day({day}), 7))"""
    return f"""(array_contains({fields}.month, month({day}))
        AND CASE WHEN {fields}.either THEN {by_day} OR {by_weekday} ELSE {by_day} AND {by_weekday} END)"""


def _minutes(fields: str) -> str:
    return f"flatten(transform({fields}.hour, h -> transform({fields}.minute, m -> h * 60 + m)))"


def _days(fields: str, first: str, last: str) -> str:
    return f"filter(sequence({first}, {last}), d -> {_matches_day(fields, 'd')})"


def minutes_of_day(fields: str) -> Column:
    """Ascending minutes since midnight at which a matching day fires (at most 1440)."""
    return F.expr(_let("f", fields, _minutes("f")))


def days_between(fields: str, first: str, last: str) -> Column:
    """Matching dates from column ``first`` to column ``last``, both included."""
    return F.expr(_let("f", fields, _days("f", first, last)))


def _at(day: str, minute: str) -> str:
    return f"(CAST({day} AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * {minute})"


def at_minute(day: str, minute: str) -> Column:
    """The time ``minute`` minutes into ``day``."""
    return F.expr(_at(day, minute))


def last_before(days: str, minutes: str, at: str) -> Column:
    """The last firing up to time column ``at`` on the ascending ``days``, each with the ascending ``minutes``; null if there is none."""
    today, minute = f"to_date({at})", f"(hour({at}) * 60 + minute({at}))"
    own = f"CASE WHEN array_contains({days}, {today}) THEN {_at(today, f'try_element_at(filter({minutes}, m -> m <= {minute}), -1)')} END"
    earlier = _at(f"try_element_at(filter({days}, d -> d < {today}), -1)", f"try_element_at({minutes}, -1)")
    return F.expr(f"coalesce({own}, {earlier})")


def count_firings() -> Column:
    """How many firings lie after column ``t0`` up to column ``t1``, from columns ``days`` and ``minutes``: every minute
    of every day, without those of the first day up to ``t0`` and those of the last day after ``t1``."""

    def outside(day: str, condition: str) -> str:
        return f"IF(array_contains(days, {day}), size(filter(minutes, m -> {_at(day, 'm')} {condition})), 0)"

    early, late = outside("to_date(t0)", "<= t0"), outside("to_date(t1)", "> t1")
    return F.expr(f"CAST(size(days) AS BIGINT) * size(minutes) - {early} - {late}")


def next_after(fields: str, base: str) -> Column:
    """First firing strictly after time column ``base``; null when there is none within eight years."""
    start = f"(CAST(date_trunc('minute', {base}) AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE)"
    today, minute = f"to_date({start})", f"(hour({start}) * 60 + minute({start}))"
    later_today = f"CASE WHEN {_matches_day('f', today)} THEN get(filter(t, n -> n >= {minute}), 0) END"

    def first_day(days: int) -> str:
        return f"get({_days('f', f'date_add({today}, 1)', f'date_add({today}, {days})')}, 0)"

    # coalesce stops at the first hit, so the long horizon is only walked by rare expressions.
    next_day = f"coalesce({first_day(_NEAR_DAYS)}, {first_day(HORIZON_DAYS)})"
    firing = f"coalesce({_at(today, later_today)}, {_at(next_day, 'get(t, 0)')})"
    return F.expr(_let("f", fields, _let("t", _minutes("f"), firing)))
