"""Spans of time in Spanish questions, as columns: an ordered cascade of rules from a text to (kind, start, end, months).

Rules come in order and the first that fits decides: two months compared, a range of days, of months, of years, since, a
quarter or semester by number, the running or last one, the last n units, a day, a month with its year, the running or last
unit, then a month or year alone. Spans are [start, end). A named span stays whole, a running one ends today; a month
without a year is its latest one that is not in the future, unless every year is asked for (kind `months`). Texts without a
span, null and empty ones give null.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import plain

# Spanish names of months, numbers, ordinals and units.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
NUMBERS = {"un": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "quince": 15, "veinte": 20, "treinta": 30, "sesenta": 60, "noventa": 90}
ORDINALS = {"primer": 1, "primero": 1, "1er": 1, "1": 1, "q1": 1, "segundo": 2, "2do": 2, "2": 2, "q2": 2, "tercer": 3, "tercero": 3, "3er": 3, "3": 3, "q3": 3, "cuarto": 4, "4to": 4, "4": 4, "q4": 4, "ultimo": 0}
UNITS = {"dia": "day", "dias": "day", "semana": "week", "semanas": "week", "mes": "month", "meses": "month", "trimestre": "quarter", "trimestres": "quarter", "semestre": "semester", "semestres": "semester", "ano": "year", "anos": "year"}
ADJECTIVES = {"diario": "day", "diaria": "day", "semanal": "week", "mensual": "month", "trimestral": "quarter", "semestral": "semester", "anual": "year"}

M = f"({'|'.join(MONTHS)})"
Y = r"((?:19|20)\d{2})"
#: The year behind a month or quarter: a number, or one that counts from today.
REF = rf"(?: (?:de |del |en )?(?:el |la )?(?:(?:ano )?{Y}|(este ano|ano (?:actual|en curso|pasado|anterior|antepasado)))(?= ))?"
EVERY = " (?:todos los anos|cada ano|por ano|historico)(?: |$)"
SIZES = {"month": 1, "quarter": 3, "semester": 6, "year": 12}


def words(text: Column | str) -> Column:
    """Folded words between single spaces, a space at either end."""
    out = F.regexp_replace(plain(F.col(text) if isinstance(text, str) else text), "[^a-z0-9]+", " ")
    out = F.regexp_replace(out, "(?<= |^)([1-4]) (er|ro|do|to) (?=trimestre|semestre)", "$1$2 ")
    return F.regexp_replace(F.concat(F.lit(" "), F.trim(out), F.lit(" ")), " anio(s?)(?= )", " ano$1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value worked out once, however often it is named."""
    return F.transform(F.array(value), body)[0]


class Rules:
    """The rules for one text column and one day. What patterns find is worked out once (`columns`); the rules read it as
    the fields of `found`."""

    def __init__(self, text: Column, today: Date, found: Column):
        self.t, self.today, self.tomorrow, self.columns, self.found = text, today, F.lit(today + timedelta(1)), {}, found

    def first_of_all(self) -> Column:
        """The first rule that fits."""
        rules = (self.comparison, self.days, self.months, self.years, self.since, self.numbered, self.last_units, self.day, self.named_month, self.beside, self.bare)
        return F.coalesce(*(rule() for rule in rules))

    def hit(self, pattern: str, *groups: int) -> list[Column]:
        """Whether the pattern occurs, and its groups ("" if empty), as columns of the first place where it does."""
        name, parts = f"__h{len(self.columns)}", "\u0001".join(f"${g}" for g in groups)
        whole = F.regexp_replace(self.t, f"^.*?{pattern}.*$", parts)
        self.columns[name] = F.when(self.t.rlike(pattern), F.split(whole, "\u0001", -1))
        own = self.found[name]
        return [own.isNotNull(), *(F.coalesce(F.get(own, F.lit(i)), F.lit("")) for i in range(len(groups)))]

    def has(self, pattern: str) -> Column:
        name = f"__h{len(self.columns)}"
        self.columns[name] = self.t.rlike(pattern)
        return self.found[name]

    @staticmethod
    def look(values: dict, key: Column) -> Column:
        return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]

    def month(self, name: Column) -> Column:
        return self.look(MONTHS, name)

    def year(self, number: Column, relative: Column) -> Column:
        y = self.today.year
        return F.when(number != "", number.cast("int")).when(relative.contains("antepasado"), y - 2).when(relative.rlike("pasado|anterior"), y - 1).when(relative != "", y)

    def latest(self, month: Column) -> Column:
        """The year of a month's latest beginning."""
        return F.when(month <= self.today.month, self.today.year).otherwise(self.today.year - 1)

    @staticmethod
    def first(year: Column | int, month: Column | int) -> Column:
        return F.make_date(F.lit(year) if isinstance(year, int) else year, F.lit(month) if isinstance(month, int) else month, F.lit(1))

    def running(self, start: Column, end: Column) -> Column:
        return let(end, lambda e: F.when((start <= F.lit(self.today)) & (self.tomorrow < e), self.tomorrow).otherwise(e))

    @staticmethod
    def span(fits: Column, start: Column, end: Column, compare: bool = False) -> Column:
        none = F.lit(None).cast("array<int>")
        both = F.when(fits, F.struct(F.lit("span").alias("kind"), start.alias("start"), end.alias("end"), none.alias("months"), F.lit(compare).alias("compare")))
        return let(both, lambda p: F.when(p["start"] < p["end"], p))

    @staticmethod
    def any_year(fits: Column, months: Column) -> Column:
        none = F.lit(None).cast("date")
        return F.when(fits, F.struct(F.lit("months").alias("kind"), none.alias("start"), none.alias("end"), months.alias("months"), F.lit(False).alias("compare")))

    def comparison(self) -> Column:
        side = rf"(?:{M}(?: (?:de |del )?{Y})?|(mes (?:pasado|anterior))|(este mes|mes actual))"
        fits, m1, y1, p1, c1, m2, y2, p2, c2 = self.hit(rf" (?:el |la )?{side} (?:contra|frente a|vs|versus|comparad[oa] con|(?:con )?respecto al?) (?:el |la |lo )?(?:de |del )?{side} ", *range(1, 9))
        here, before = Date(self.today.year, self.today.month, 1), (Date(self.today.year, self.today.month, 1) - timedelta(1)).replace(day=1)

        def at(m: Column, y: Column, other: Column, p: Column) -> Column:
            month = self.month(m)
            year = F.when(y != "", y.cast("int")).when(other != "", other.cast("int")).otherwise(self.latest(month))
            return F.when(m != "", self.first(year, month)).when(p != "", F.lit(before)).otherwise(F.lit(here))

        a, b = at(m1, y1, y2, p1), at(m2, y2, y1, p2)
        return self.span(fits & (a != b), F.least(a, b), F.add_months(F.greatest(a, b), 1), True)

    def days(self) -> Column:
        fits, d1, m1, d2, m2, y, rel = self.hit(rf" (?:del|desde el|entre el|de) ([0-3]?\d)(?: de {M})? (?:al|hasta el|y el|a) ([0-3]?\d) de {M}{REF}", 1, 2, 3, 4, 5, 6)
        last = self.month(m2)
        begin = F.coalesce(self.month(m1), last)
        year = F.coalesce(self.year(y, rel), F.lit(self.today.year))
        start = F.try_make_timestamp_ntz(F.when(begin <= last, year).otherwise(year - 1), begin, d1.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        end = F.try_make_timestamp_ntz(year, last, d2.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return self.span(fits, start, F.date_add(end, 1))

    def months(self) -> Column:
        own = rf"{M}(?: (?:de |del )?(?:ano )?{Y})?"
        fits, m1, y1, m2, y2, rel = self.hit(rf"(?: (?:entre|desde|de)(?: (?:el )?mes de)?(?= {M}(?: (?:de |del )?(?:ano )?{Y})? y)|(?= {M}(?: (?:de |del )?(?:ano )?{Y})? (?:a|al|hasta) )) {own} (?:y|a|al|hasta) (?:(?:el )?mes de )?{M}{REF}(?= )", 5, 6, 7, 8, 9)
        loose = self.has(rf" (?:desde|de) {own} y {M} ")
        own_years = F.struct(self.month(m1).alias("a"), self.month(m2).alias("b"), F.when(y1 != "", y1.cast("int")).alias("first"), self.year(y2, rel).alias("last"))
        fits = fits & ~loose
        every = self.has(EVERY)

        def of(x: Column) -> Column:
            a, b, first, last = x["a"], x["b"], x["first"], x["last"]
            known = first.isNotNull() | last.isNotNull()
            # A range without a year is the latest whose last month has begun.
            second = F.when(known, F.coalesce(last, F.when(b >= a, first).otherwise(first + 1))).otherwise(self.latest(b))
            listed = F.when(a <= b, F.sequence(a, b)).otherwise(F.concat(F.sequence(a, F.lit(12)), F.sequence(F.lit(1), b)))

            def dated(y: Column) -> Column:
                start = self.first(F.coalesce(first, F.when(a <= b, y).otherwise(y - 1)), a)
                end = F.add_months(self.first(y, b), 1)
                return self.span(fits & ~(~known & every), start, F.when(known, end).otherwise(self.running(start, end)))

            return F.coalesce(self.any_year(fits & ~known & every, listed), let(second, dated))

        return let(own_years, of)

    def years(self) -> Column:
        fits, y1, y2 = self.hit(rf" (?:entre (?:el )?(?:ano )?{Y} y|(?:desde|de) (?:el )?(?:ano )?{Y} (?:a|al|hasta)) (?:el )?(?:ano )?{Y} ", 1, 3)
        _, other = self.hit(rf" (?:desde|de) (?:el )?(?:ano )?{Y} (?:a|al|hasta) (?:el )?(?:ano )?{Y} ", 1)
        begin = F.when(y1 != "", y1).otherwise(other).cast("int")
        return self.span(fits, self.first(begin, 1), self.first(y2.cast("int") + 1, 1))

    def since(self) -> Column:
        fits, m, y, rel, alone = self.hit(rf" (?:a partir de|desde) (?:el )?(?:(?:mes de )?{M}{REF}|(?:ano )?{Y})(?= )", 1, 2, 3, 4)
        month = self.month(m)
        start = F.when(m != "", self.first(F.coalesce(self.year(y, rel), self.latest(month)), month)).otherwise(self.first(alone.cast("int"), 1))
        return self.span(fits, start, self.tomorrow)

    def numbered(self) -> Column:
        return F.coalesce(self.numbered_unit("trimestre", 3), self.numbered_unit("semestre", 6))

    def numbered_unit(self, unit: str, size: int) -> Column:
        count, current = 12 // size, (self.today.month - 1) // size + 1
        ordinal = f"({'|'.join(sorted(ORDINALS, key=len, reverse=True))})"
        pattern = rf" (?:{ordinal} {unit}|({'q[1-4]' if size == 3 else 'q0'})){REF}(?= )"
        fits, name, short, y, rel = self.hit(pattern, 1, 2, 3, 4)
        ended = (self.today.year, current - 1) if current > 1 else (self.today.year - 1, count)

        def of(x: Column) -> Column:
            index, year = x["index"], x["year"]
            last = (index == 0) & year.isNull()  # the last whole one

            def dated(at: Column) -> Column:
                own = F.when(last, ended[0]).otherwise(F.coalesce(year, F.when(at <= current, self.today.year).otherwise(self.today.year - 1)))

                def from_(start: Column) -> Column:
                    end = F.add_months(start, size)
                    return self.span(fits & (at <= count), start, F.when(year.isNull() | (rel != ""), self.running(start, end)).otherwise(end))

                return let(self.first(own, (at - 1) * size + 1), from_)

            return let(F.when(last, ended[1]).when(index == 0, count).otherwise(index), dated)

        return let(F.struct(self.look(ORDINALS, F.concat(name, short)).alias("index"), self.year(y, rel).alias("year")), of)

    def beside(self) -> Column:
        """The running and the last unit: year (and month of it), quarter, semester, month, week."""
        day, out = self.today, []
        _, asked = self.hit(rf" {M} ", 1)
        spans = [(" (?:ano antepasado) ", day.year - 2), (" (?:ano (?:pasado|anterior)) ", day.year - 1), (" (?:este ano|ano (?:actual|en curso)|lo que va (?:del|de este) ano|presente ano) ", day.year)]
        for pattern, y in spans:
            fits, start = self.has(pattern), self.first(y, 1)
            inside = self.first(y, self.month(asked))
            out.append(self.span(fits & (asked != ""), inside, F.add_months(inside, 1)))
            out.append(self.span(fits, start, self.running(start, F.add_months(start, 12))))
        for unit, size in (("trimestre", 3), ("semestre", 6), ("mes", 1)):
            now = F.lit(Date(day.year, (day.month - 1) // size * size + 1, 1))
            out.append(self.span(self.has(rf" {unit} (?:pasado|anterior) "), F.add_months(now, -size), now))
            out.append(self.span(self.has(rf" (?:este {unit}|{unit} (?:actual|en curso)|lo que va del {unit}) "), now, self.running(now, F.add_months(now, size))))
        monday = day - timedelta(day.weekday())
        out.append(self.span(self.has(" semana (?:pasada|anterior) "), F.lit(monday - timedelta(7)), F.lit(monday)))
        out.append(self.span(self.has(" (?:esta semana|semana (?:actual|en curso)) "), F.lit(monday), self.tomorrow))
        for pattern, n in ((" (?:anteayer|antier) ", 2), (" ayer ", 1), (" hoy ", 0)):
            plain_day = self.has(pattern) & ~self.has(" hasta hoy ")
            out.append(self.span(plain_day, F.lit(day - timedelta(n)), F.lit(day - timedelta(n - 1))))
        return F.coalesce(*out)

    def last_units(self) -> Column:
        number = rf"(\d{{1,3}}|{'|'.join(NUMBERS)})"
        fits, n1, n2, unit = self.hit(rf" (?:(?:ultim[oa]s|pasad[oa]s) {number}|{number} ultim[oa]s) ({'|'.join(UNITS)}) ", 1, 2, 3)
        text = F.when(n1 != "", n1).otherwise(n2)
        n, kind = F.coalesce(self.look(NUMBERS, text), text.try_cast("int")), self.look(UNITS, unit)
        days = self.span(fits & kind.isin("day", "week"), F.date_add(self.tomorrow, -n * F.when(kind == "week", 7).otherwise(1)), self.tomorrow)
        whole = []
        for k, size in SIZES.items():
            now = F.lit(Date(self.today.year, (self.today.month - 1) // size * size + 1, 1))
            whole.append(self.span(fits & (kind == k), F.add_months(now, -n * size), now))
        return F.coalesce(days, *whole)

    def day(self) -> Column:
        fits, d, m, y, rel = self.hit(rf" ([0-3]?\d) de {M}{REF}(?= )", 1, 2, 3, 4)
        month = self.month(m)
        year = F.coalesce(self.year(y, rel), self.latest(month))
        at = F.try_make_timestamp_ntz(year, month, d.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return self.span(fits, at, F.date_add(at, 1))

    def named_month(self) -> Column:
        fits, m, y, rel = self.hit(rf" {M} (?:de |del |en )?(?:el |la )?(?:(?:ano )?{Y}|(este ano|ano (?:actual|en curso|pasado|anterior|antepasado)))(?= )", 1, 2, 3)
        start = self.first(self.year(y, rel), self.month(m))
        return self.span(fits, start, F.add_months(start, 1))

    def bare(self) -> Column:
        (_, m), (_, y) = self.hit(rf" {M} ", 1), self.hit(rf" {Y} ", 1)
        month = self.month(m)
        both = self.span((m != "") & (y != ""), self.first(y.cast("int"), month), F.add_months(self.first(y.cast("int"), month), 1))
        year = self.span(y != "", self.first(y.cast("int"), 1), self.first(y.cast("int") + 1, 1))
        start = self.first(self.latest(month), month)
        every = self.has(EVERY)
        return F.coalesce(both, year, self.any_year((m != "") & every, F.array(month)), self.span(m != "", start, self.running(start, F.add_months(start, 1))))


def period(df: DataFrame, text: str, today: str, name: str = "period") -> DataFrame:
    """With (kind, start, end, months, compare) of each question, or null. Rules are tried row by row, in a function of the
    row's findings: as one projection of all rules they would be too much code for one method."""
    day, folded = Date.fromisoformat(today), F.col("__folded")
    asked = Rules(folded, day, F.col("__found"))
    asked.first_of_all()
    found = F.struct(*(c.alias(n) for n, c in asked.columns.items()))
    df = df.withColumn("__folded", words(text)).withColumn("__found", found)
    return df.withColumn(name, F.transform(F.array("__found"), lambda h: Rules(folded, day, h).first_of_all())[0]).drop("__folded", "__found")


def granularity(text: Column | str, compared: Column | None = None) -> Column:
    """The unit that a question groups by: by unit, unit by unit, a course with an adjective, or the month if months are
    compared."""
    t = words(text)
    by = F.regexp_extract(t, rf" por (?:cada )?({'|'.join(UNITS)}) (?!de )", 1)
    each = F.regexp_extract(t, r" (dia|semana|mes|trimestre|semestre|ano) a \1 ", 1)
    course = F.regexp_extract(t, rf" (?:evolucion|tendencia|comportamiento|serie|historico|desglose) ({'|'.join(ADJECTIVES)}) ", 1)
    adverb = F.regexp_extract(t, rf" ({'|'.join(ADJECTIVES)})mente ", 1)
    return F.coalesce(Rules.look(UNITS, by), Rules.look(UNITS, each), Rules.look(ADJECTIVES, course), Rules.look(ADJECTIVES, adverb), F.when(compared if compared is not None else F.lit(False), "month"))
