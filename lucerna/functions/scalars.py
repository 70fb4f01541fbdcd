"""Scalars of the semantic layer: null is BLANK, text compares without case, logic is two-valued, division never fails."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish names used by formats.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
DAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
ACCENTS = ("áéíóúüñàèìòù", "aeiouunaeiou")


def folded(x: Column) -> Column:
    """Key of a text: case folds, accents do not."""
    return F.lower(x)


def plain(x: Column) -> Column:
    """Key of a name or question: case and accents fold."""
    return F.translate(F.lower(x), *ACCENTS)


def equal(a: Column, b: Column, default) -> Column:
    """=: BLANK equals the type's default (0, "", false)."""
    return F.coalesce(a, F.lit(default)) == F.coalesce(b, F.lit(default))


def same(a: Column, b: Column) -> Column:
    """==: BLANK equals BLANK only."""
    return a.eqNullSafe(b)


def plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def minus(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def negated(a: Column) -> Column:
    return ~F.coalesce(a, F.lit(False))


def choose(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), then).otherwise(otherwise)


def switch(value: Column, *pairs: tuple[Column, Column], otherwise: Column | None = None, text: bool = False) -> Column:
    """BLANK equals BLANK; texts are compared without case."""
    fold = F.lower if text else lambda x: x
    out = otherwise if otherwise is not None else F.lit(None)
    for key, result in reversed(pairs):
        out = F.when(fold(value).eqNullSafe(fold(key)), result).otherwise(out)
    return out


def is_blank(x: Column) -> Column:
    return x.isNull()


def is_number(x: Column) -> Column:
    return F.typeof(x).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$") & x.isNotNull()


def is_text(x: Column) -> Column:
    return (F.typeof(x) == "string") & x.isNotNull()


def is_nontext(x: Column) -> Column:
    return ~is_text(x)


def is_logical(x: Column) -> Column:
    return (F.typeof(x) == "boolean") & x.isNotNull()


def is_error(tried: Column, inputs: Column) -> Column:
    """Spark's try functions give null for an error: one where the inputs are there and the result is not."""
    return inputs.isNotNull() & tried.isNull()


def if_error(tried: Column, inputs: Column, alternative: Column) -> Column:
    return F.when(is_error(tried, inputs), alternative).otherwise(tried)


def first_known(*values: Column) -> Column:
    return F.coalesce(*values)


def user_name() -> Column:
    """USERNAME, USERPRINCIPALNAME, USEROBJECTID: who runs the session."""
    return F.current_user()


def divide(n: Column, d: Column, alternative=None) -> Column:
    return F.when(d.isNull() | (d == 0), F.lit(alternative)).otherwise(n / d)


def modulo(a: Column, b: Column) -> Column:
    """Sign of the divisor."""
    return a - b * F.floor(a / b)


def quotient(a: Column, b: Column) -> Column:
    return truncated(a / b).cast("long")


def truncated(x: Column, digits: int = 0) -> Column:
    f = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * f) / f


def round_up(x: Column, digits: int = 0) -> Column:
    f = 10.0**digits
    return F.signum(x) * F.ceil(F.abs(x) * f) / f


def sign(x: Column) -> Column:
    return F.signum(F.coalesce(x, F.lit(0)))


def integer(x: Column) -> Column:
    return F.floor(x).cast("long")


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the decimal text; an integer if digits <= 0."""
    out = F.round(x.cast("decimal(38,12)"), digits)
    return out.cast("long") if digits <= 0 else out.cast("double")


def round_down(x: Column, digits: int = 0) -> Column:
    return truncated(x, digits)


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def root(x: Column) -> Column:
    """Of a negative number BLANK."""
    return F.when(x >= 0, F.sqrt(x))


def logarithm(x: Column, base: float | None = None) -> Column:
    """LN, or LOG10 with base 10; of no positive number BLANK."""
    return F.when(x > 0, F.ln(x) if base is None else F.log10(x) if base == 10 else F.ln(x) / F.ln(F.lit(base)))


def converted(x: Column, kind: str) -> Column:
    """CONVERT; BLANK where it can't be."""
    to = {"INTEGER": "long", "INT64": "long", "DOUBLE": "double", "DECIMAL": "double", "CURRENCY": "decimal(19,4)", "STRING": "string", "DATETIME": "timestamp_ntz", "BOOLEAN": "boolean"}
    return x.try_cast(to[kind])


def ceiling(x: Column, step: float) -> Column:
    return F.ceil(x / step) * step


def floor(x: Column, step: float) -> Column:
    return F.floor(x / step) * step


def smaller(a: Column, b: Column) -> Column:
    """MIN of two values: BLANK counts only if both are."""
    return F.least(a, b)


def larger(a: Column, b: Column) -> Column:
    """MAX of two values: BLANK counts only if both are."""
    return F.greatest(a, b)


def value(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def currency(x: Column) -> Column:
    return x.cast("decimal(19,4)")


def concatenated(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def combined(delimiter: str, *parts: Column) -> Column:
    return F.concat_ws(delimiter, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def trimmed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def left(text: Column, n: int = 1) -> Column:
    return F.left(text, F.lit(n))


def right(text: Column, n: int = 1) -> Column:
    return F.right(text, F.lit(n))


def middle(text: Column, start: int, n: int) -> Column:
    return F.substring(text, start, n)


def length(text: Column) -> Column:
    return F.length(F.coalesce(text.cast("string"), F.lit("")))


def substituted(text: Column, old: str, new: str) -> Column:
    """Every occurrence, with case."""
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def repeated(text: Column, n: int) -> Column:
    return F.repeat(text, n)


def exact(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def unicode_character(n: Column) -> Column:
    """UNICHAR: the character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def replaced(text: Column, start: int, n: int, new: str) -> Column:
    return F.concat(F.substring(text, 1, start - 1), F.lit(new), F.substring(text, start + n, 1 << 30))


def found(needle: str, text: Column, exact: bool = False, alternative: int | None = None, start: int = 1) -> Column:
    """FIND if exact, else SEARCH: the first place from start on."""
    at = F.locate(needle, text, start) if exact else F.locate(needle.lower(), F.lower(text), start)
    return F.when(at > 0, at).otherwise(F.lit(alternative))


def contains(text: Column, needle: str, exact: bool = False) -> Column:
    return text.contains(needle) if exact else F.lower(text).contains(needle.lower())


def fixed(x: Column, digits: int = 2) -> Column:
    """Grouped decimals with Spanish separators."""
    return F.translate(F.format_number(x, digits), ",.", ".,")


def percent(x: Column, digits: int = 2) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def formatted(x: Column, pattern: str) -> Column:
    """FORMAT of a number: named formats, or digits with "," for groups, "." for decimals and "%"; Spanish separators."""
    pattern = {"General Number": "0.##########", "Fixed": "0.00", "Standard": "#,##0.00", "Percent": "0.00%", "Currency": "#,##0.00 €"}.get(pattern, pattern)
    head = pattern.rstrip("% €")
    digits, scaled = len(head.partition(".")[2]), x * 100 if "%" in pattern else x
    text = F.format_number(F.round(scaled.cast("decimal(38,12)"), digits), digits)
    text = F.translate(text, ",.", ".,") if "," in head else F.translate(text, ".,", ",")
    if head.endswith("#"):
        text = F.regexp_replace(text, ",?0+$", "") if digits else text
    return F.concat(text, F.lit(pattern[len(head) :]))


def formatted_date(d: Column, pattern: str) -> Column:
    """FORMAT of a date: d dd ddd dddd, M MM MMM MMMM, q, yy yyyy, H HH, n nn, s ss; other characters stay."""
    pattern = {"Short Date": "dd/MM/yyyy", "Long Date": "dddd, d MMMM yyyy", "Short Time": "HH:nn", "Long Time": "HH:nn:ss"}.get(pattern, pattern)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    parts = {
        "dddd": day_name(d), "ddd": F.left(day_name(d), F.lit(3)), "dd": two(F.day(d)), "d": F.day(d).cast("string"), "MMMM": month_name(d), "MMM": F.left(month_name(d), F.lit(3)),
        "MM": two(F.month(d)), "M": F.month(d).cast("string"), "q": F.quarter(d).cast("string"), "yyyy": F.year(d).cast("string"), "yy": two(F.year(d) % 100), "HH": two(F.hour(d)),
        "H": F.hour(d).cast("string"), "nn": two(F.minute(d)), "n": F.minute(d).cast("string"), "ss": two(F.second(d)), "s": F.second(d).cast("string"),
    }
    out = [parts[t] if t in parts else F.lit(t) for t in re.findall("d{1,4}|M{1,4}|y{4}|y{2}|H{1,2}|n{1,2}|s{1,2}|q|.", pattern)]
    return F.concat(*out)


def month_name(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1)


def day_name(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, DAYS)), F.weekday(d))


def weekday(d: Column, kind: int = 1) -> Column:
    return {1: F.dayofweek(d), 2: F.weekday(d) + 1, 3: F.weekday(d)}[kind]


def week_number(d: Column) -> Column:
    return F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7) + 1


def date(y: Column, m: Column, d: Column) -> Column:
    """Months and days roll over."""
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)


def time(h: Column, m: Column, s: Column) -> Column:
    """An instant of the day from which serial numbers count."""
    return F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, m, s)


def date_value(text: Column) -> Column:
    """yyyy-MM-dd, dd/MM/yyyy, dd-MM-yyyy, yyyy/MM/dd or yyyyMMdd; else BLANK."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd"))).cast("date")


def today(reference: str) -> Column:
    """TODAY, UTCTODAY: the session's reference date, never the clock."""
    return F.lit(reference).cast("date")


def now(reference: str) -> Column:
    """NOW, UTCNOW: eight o'clock of the reference date."""
    return F.lit(f"{reference} 08:00:00").cast("timestamp_ntz")


def months_later(d: Column, n: int) -> Column:
    """EDATE: clamps to the end of the month."""
    return F.add_months(d, n)


def end_of_month(d: Column, n: int = 0) -> Column:
    return F.last_day(F.add_months(d, n))


def date_difference(a: Column, b: Column, unit: str) -> Column:
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    quarters = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    seconds = F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))
    if unit in ("HOUR", "MINUTE", "SECOND"):
        return truncated(seconds / {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]).cast("long")
    return {"YEAR": F.year(b) - F.year(a), "QUARTER": quarters, "MONTH": months, "WEEK": F.floor(F.datediff(b, a) / 7), "DAY": F.datediff(b, a)}[unit]
