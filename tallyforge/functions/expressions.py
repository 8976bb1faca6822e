"""Derived values: statuses, costs, stages, classes, parsed cells.  Each is one Column expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that count as done, and change statuses that count as resolved.
DONE = ("done_physically", "submitted", "accepted", "closed", "cancelled")
RESOLVED = ("approved", "rejected", "cancelled", "closed")
STAGES = ("forming", "sent", "checked", "ks2_signed", "paid")


def work_status(pct: Column) -> Column:
    """Status from a percentage; unknown or 0 is not started."""
    return F.when(pct.isNull() | (pct == 0), "not_started").when(pct >= 100, "done_physically").otherwise("in_progress")


def overdue_days(due: Column, answered: Column, status: Column, today: Column) -> Column:
    """Days past due; null if answered, resolved, without a due date or not yet due."""
    return F.when(answered.isNull() & ~F.coalesce(status.isin(*RESOLVED), F.lit(False)) & (due < today), F.datediff(today, due))


def removed(is_active: Column, resolved: Column) -> Column:
    return ~is_active | F.coalesce(resolved, F.lit(False))


def folder_cost(estimate: Column, amount: Column) -> Column:
    return F.coalesce(estimate, amount)


def folder_stage(sent: Column, checked: Column, signed: Column, paid: Column) -> Column:
    """The last stage with a date."""
    return F.when(paid.isNotNull(), "paid").when(signed.isNotNull(), "ks2_signed").when(checked.isNotNull(), "checked").when(sent.isNotNull(), "sent").otherwise("forming")


#: Statuses under way, beside those that say that a signature is under way.
UNDER_WAY = ("signed in pencil", "in progress", "returned", "agreed to sign")


def status_tier(status: Column) -> Column:
    """0 none or unknown, 1 under way, 2 signed.  A pencil signature shares the prefix but is none."""
    s = F.lower(F.trim(status))
    return F.when(s.isin(*UNDER_WAY) | s.contains("for signature"), 1).when(s.startswith("signed"), 2).otherwise(0)


def group_status(members: Column, signed: Column, usual: Column) -> Column:
    """None, signed, signed n%, or the usual status."""
    return F.when(members == 0, "none").when(signed == members, "signed").when(signed > 0, F.concat(F.lit("signed "), F.bround(100.0 * signed / members).cast("int").cast("string"), F.lit("%"))).otherwise(F.coalesce(usual, F.lit("none")))


def violation_status(is_removed: Column, rejected: Column, fixed: Column, needs_design: Column) -> Column:
    """Ordered rules: rejected is looked at before ready."""
    return F.when(is_removed, "closed").when(F.coalesce(rejected, F.lit(False)), "rejected").when(F.coalesce(fixed, F.lit(False)) & ~F.coalesce(needs_design, F.lit(False)), "ready").when(F.coalesce(needs_design, F.lit(False)), "needs_design").otherwise("open")


def pipe_stage(ks2: Column, signed: Column, estimate: Column, sent: Column, check: Column) -> Column:
    """The stage of a folder in the pipe of execution: billed, signed with or without an estimate, checked, formed."""
    return F.when(ks2.isNotNull(), "ks2_current").when(signed.isNotNull() & estimate.isNotNull(), "ks2_next").when(signed.isNotNull(), "signed").when(sent.isNotNull() | check.isNotNull(), "checking").otherwise("formed")


def finding_state(is_removed: Column, rejected: Column, physical: Column, design: Column, documents: Column) -> Column:
    """The state of a finding by its three tracks: ready where each is done or not required, waiting for the design where that is not done or the physical one says fact."""
    over = lambda track: F.coalesce(track.isin("done", "not_required"), F.lit(False))
    waits = F.coalesce(design == "not_done", F.lit(False)) | F.coalesce(physical == "fact", F.lit(False))
    return F.when(is_removed, "closed").when(F.coalesce(rejected, F.lit(False)), "rejected").when(over(physical) & over(design) & over(documents), "ready").when(waits, "needs_rd").otherwise("open")


def deviation_class(days: Column) -> Column:
    return F.when(days <= 0, "ok").when(days <= 7, "risk").otherwise("danger")


def cell_colour(blocked: Column, stopper: Column, status: Column) -> Column:
    """A blocker shows first, then a stop factor, then the status."""
    return F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.coalesce(stopper, F.lit(False)), "stopped").otherwise(F.element_at(F.array(F.lit("empty"), F.lit("amber"), F.lit("green")), status_tier(status) + 1))


def decode(code: Column, labels: Mapping[str, str], default: str | None = None) -> Column:
    """A label from a small fixed dictionary; else the default, else the code."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default) if default is not None else code)


def tidy(text: Column) -> Column:
    """Lower case, no-break spaces and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "\u00a0\u202f", "  ")), r"\s+", " "))


def crew(text: Column) -> Column:
    """A struct of value, raw, needs_review from a crew cell: 12, 10-15 (the upper one), '12 people'; other text keeps raw and asks for review."""
    t = tidy(text)
    value = F.coalesce(F.regexp_extract(t, r"^\d+\s*[-–]\s*(\d+)$", 1).try_cast("int"), F.regexp_extract(t, r"^(\d+)(?:\.0+)?(?:\s*(?:people|person|pers|чел)\.?)?$", 1).try_cast("int"))
    return F.struct(value.alias("value"), F.when(value.isNull(), text).alias("raw"), (value.isNull() & (F.coalesce(t, F.lit("")) != "")).alias("needs_review"))


def number_or_raw(text: Column) -> Column:
    """A struct of value and raw; a decimal comma is read."""
    value = F.replace(F.translate(text, " \u00a0\u202f", ""), F.lit(","), F.lit(".")).try_cast("decimal(18,4)")
    return F.struct(value.alias("value"), F.when(value.isNull(), text).alias("raw"))


def money(amount: Column) -> Column:
    """Thousands by no-break spaces, decimals after a comma."""
    return F.translate(F.format_number(amount, 2), ",.", "\u00a0,")


def first_match(text: Column, rules: Mapping[str, str], default: str) -> Column:
    """The label of the first pattern that is found."""
    out = F.lit(default)
    for label, pattern in reversed(rules.items()):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


#: WMO weather codes that are named apart.
WEATHER = {0: "clear", 1: "mostly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog", 51: "light drizzle", 53: "drizzle", 55: "heavy drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 71: "light snow", 73: "snow", 75: "heavy snow", 80: "showers", 95: "thunderstorm"}


def weather_text(code: Column, temperature: Column, precipitation: Column) -> Column:
    """'rain, +4°, 2.0 mm'; null without a reading."""
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WEATHER.items() for x in kv)), code.cast("int")), F.concat(F.lit("code "), code.cast("string")))
    wet = F.when(precipitation > 0, F.format_string(", %.1f mm", precipitation.cast("double"))).otherwise("")
    return F.concat(name, F.format_string(", %+d°", F.round(temperature).cast("int")), wet)
