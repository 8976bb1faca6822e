"""Rules on free texts: markers, codes, months and dates, units, polarity, tracks, responsible parties and states."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names of the sources, in the form of a heading and of a date.
MONTHS = {"январь": 1, "февраль": 2, "март": 3, "апрель": 4, "май": 5, "июнь": 6, "июль": 7, "август": 8, "сентябрь": 9, "октябрь": 10, "ноябрь": 11, "декабрь": 12}
MONTHS_OF = {"января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12}
#: Kinds of places whose code is a kind and a number, a blank may stand between; with the last kind a hyphen too.
PLACES = ("УУСА", "УУТЭ", "УТП", "УТ", "УП", "ОПВ", "ОПН", "КР", "КМ")
HYPHEN_PLACES = ("КД",)
#: Units and how they are written.
UNITS = {"м3": ("м3", "м 3", "куб.м"), "м2": ("м2", "м 2", "кв.м"), "м": ("м", "мп", "пог.м", "п.м"), "т": ("т", "тн"), "шт": ("шт",), "стык": ("стык",), "рез": ("рез",), "компл": ("компл", "комп", "комплект"), "конс": ("конс", "констр", "конструкция")}
#: What a track may say.
TRACKS = {"не треб.": "not_required", "не вып.": "not_done", "да": "done", "вып.": "done", "выполн.": "done", "факт": "fact"}


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """The table's value of a key, null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def without_markers(text: Column, markers: Sequence[str]) -> Column:
    """text without the markers that it begins with, each taken once and in their order, and the blanks after them."""
    for m in markers:
        text = F.when(text.startswith(m), F.ltrim(F.substring(text, len(m) + 1, 1 << 30))).otherwise(text)
    return text


def place_code(name: Column) -> Column:
    """The first place's code in a name, in upper case and without blanks."""
    found = F.regexp_extract(name, rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_])((?:(?:{'|'.join(PLACES)})\s?|(?:{'|'.join(HYPHEN_PLACES)})[\s-]?)\d+(?:\.\d+)?|ТЭЦ)(?![\p{{L}}\p{{N}}_])", 1)
    return F.nullif(F.replace(F.upper(found), F.lit(" "), F.lit("")), F.lit(""))


def end_of_months(text: Column, year: int) -> Column:
    """The last day of the last month that a text names."""
    named = F.array_compact(F.array(*(F.when(F.lower(text).contains(m), n) for m, n in MONTHS.items())))
    return F.last_day(F.make_date(F.lit(year), F.array_max(named), F.lit(1)))


def dotted_date(text: Column) -> Column:
    """The first date of a text in digits (5.8.26 or 05.08.2026; years under 100 are of this century)."""
    part = lambda k: F.regexp_extract(text, r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})", k)
    year = part(3).try_cast("int")
    return F.try_make_timestamp(F.when(year < 100, year + 2000).otherwise(year), part(2).try_cast("int"), part(1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def written_date(text: Column) -> Column:
    """The first date of a text by its month's name (5 августа 2026), else the first one in digits."""
    part = lambda k: F.regexp_extract(text, r"(\d{1,2})[»\s]+(\p{L}+)\s+(\d{4})", k)
    by_name = F.try_to_date(F.concat_ws("-", part(3), F.lpad(lookup(F.lower(part(2)), MONTHS_OF).cast("string"), 2, "0"), F.lpad(part(1), 2, "0")))
    return F.coalesce(by_name, dotted_date(text))


def unit_and_factor(unit: Column) -> tuple[Column, Column]:
    """A unit's canonical name and the number before it (100 м3: м3 and 100), 1 without one."""
    low = F.regexp_replace(F.lower(F.trim(unit)), r"\.+$", "")
    number, rest = F.regexp_extract(low, r"^(\d[\d\s]*)", 1), F.trim(F.regexp_replace(low, r"^\d[\d\s]*", ""))
    has = (number != "") & (rest != "")
    name = F.when(has, rest).otherwise(low)
    known = lookup(name, {alias: unit for unit, names in UNITS.items() for alias in names})
    return F.coalesce(known, F.nullif(name, F.lit(""))), F.when(has, F.replace(number, F.lit(" "), F.lit("")).cast("double")).otherwise(F.lit(1.0))


def polarity(words: Column, takes_away: Iterable[str], puts_up: Iterable[str]) -> Column:
    """neg or pos if some word begins as those that take away or put up, and none as the others."""
    begins = lambda stems: F.exists(words, lambda w: F.array_contains(F.array(*(w.startswith(s) for s in stems)), True))
    away, up = begins(list(takes_away)), begins(list(puts_up))
    return F.when(away & ~up, "neg").when(up & ~away, "pos")


def groups_of(words: Column, groups: Sequence[Iterable[str]]) -> Column:
    """The numbers of the groups of which a word set has some word."""
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(words, F.array(*(F.lit(w) for w in g))), k) for k, g in enumerate(groups))))


def material_conflict(a: Column, b: Column, groups: Sequence[Iterable[str]]) -> Column:
    """Whether both word sets name materials and none of the same group."""
    return (F.size(groups_of(a, groups)) > 0) & (F.size(groups_of(b, groups)) > 0) & ~F.arrays_overlap(groups_of(a, groups), groups_of(b, groups))


def track(text: Column, allow_fact: bool) -> Column:
    """What a track says: unknown without a text, other for what has no rule."""
    found = lookup(F.lower(F.trim(text)), TRACKS if allow_fact else {k: v for k, v in TRACKS.items() if v != "fact"})
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").otherwise(F.coalesce(found, F.lit("other")))


def responsible(text: Column, names: Mapping[str, str]) -> dict[str, Column]:
    """names (known parties, each once, in their order), note (what stands in brackets) and unmapped (parties without a name)."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)", ""), r"\+"), lambda p: F.trim(p)), lambda p: p != "")
    known = F.array_distinct(F.array_compact(F.transform(parts, lambda p: lookup(F.lower(p), names))))
    notes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda n: F.trim(n))
    return {"names": F.array_join(known, "; "), "note": F.nullif(F.array_join(notes, "; "), F.lit("")), "unmapped": F.array_join(F.filter(parts, lambda p: lookup(F.lower(p), names).isNull()), "; ")}


def closed_on(text: Column) -> Column:
    """The first date in the 25 characters after a word for removed that the word for going to does not stand before; null without one."""
    parts = F.split(text, r"(?iu)снят[оа](?![\p{L}\p{N}_])", -1)
    word = 5  # characters of that word
    start = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(p)) + word * i
    going = lambda i: F.regexp_extract(F.element_at(parts, i), r"(?iu)(\S*?)[,;]*\s*$", 1)
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (i < F.size(parts)) & (F.lower(going(i)) != "будет"))
    return F.get(F.array_compact(F.transform(hits, lambda i: dotted_date(F.substring(text, start(i) + 1, F.lit(25))))), F.lit(0))


def sentences(text: Column) -> Column:
    """The parts of a text by ends of sentences and dashes of lists."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;!?])\s+|\n+|(?:^|\s)[-–]\s+"), lambda p: F.trim(p)), lambda p: p != "")


def act_reference(text: Column) -> dict[str, Column]:
    """number and date of an act that a text refers to (4183-12, 05.08.2026)."""
    return {"act_no": F.nullif(F.regexp_extract(text, r"(\d{3,}-\d+)", 1), F.lit("")), "act_date": written_date(text)}


def ring_class(percent: Column) -> Column:
    return F.when(percent < 50, "warning").when(percent >= 80, "success").otherwise("plain")
