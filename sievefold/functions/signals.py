"""The four signal axes and the duration of a listing, from its text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B0, B1, WS, flexible

# Phrases by axis value.  Words may be joined by blanks, hyphens or nothing.
UNPAID = ("unpaid", "voluntary", "volunteer", "no remuneration", "for course credit", "course credit", "academic credit", "work integrated learning", "industry based learning", "university placement", "student placement", "expenses only", "reimbursement only")
PAID = ("paid internship", "paid placement", "hourly rate", "per hour", "salary", "remuneration", "competitive pay", "award wage", "penalty rates", "superannuation")
HYBRID = ("hybrid", "days in the office", "days in office", "flexible working arrangement")
REMOTE = ("remote", "fully remote", "remote first", "work from home", "wfh", "telecommute")
ONSITE = ("on site", "onsite", "in person", "in the office", "office based", "based on campus")
CASUAL = ("casual",)
PART_TIME = ("part time", "0.5 fte", "0.6 fte", "0.8 fte", "a few days a week")
FULL_TIME = ("full time", "38 hours", "40 hours", "1.0 fte")
CONTRACT = ("fixed term", "contract role", "contract position", "max term")
INTERNSHIP = ("internship", "internships", "intern", "placement", "cadetship", "cadet", "trainee", "traineeship", "work experience", "vacation program", "vacationer", "summer program")
WEEKS_PER_MONTH = 4.345
SEMESTER_WEEKS = 16


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """One alternation for an axis value; letters may not touch it, digits may."""
    return f"(?i)(?<![a-z])(?:{'|'.join(flexible(p) for p in phrases)})(?![a-z])"


def says(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike(phrase_pattern(phrases))


def compensation(text: Column, salary_min: Column, predicted: Column) -> Column:
    """Unpaid wins; then a stated salary (an estimate is none); then paid phrases."""
    stated = F.coalesce((salary_min > 0) & ~F.coalesce(predicted, F.lit(False)), F.lit(False))
    return F.when(says(text, UNPAID), "unpaid").when(stated | says(text, PAID), "paid").otherwise("unknown")


def work_mode(text: Column) -> Column:
    remote, onsite = says(text, REMOTE), says(text, ONSITE)
    return F.when(says(text, HYBRID) | (remote & onsite), "hybrid").when(remote, "remote").when(onsite, "onsite").otherwise("unknown")


def commitment(text: Column) -> Column:
    order = ((CASUAL, "casual"), (PART_TIME, "part_time"), (CONTRACT, "contract"), (FULL_TIME, "full_time"))
    found = F.lit("unknown")
    for phrases, value in reversed(order):
        found = F.when(says(text, phrases), value).otherwise(found)
    return found


def role_type(text: Column) -> Column:
    return F.when(says(text, INTERNSHIP), "internship").otherwise("job")


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def duration_weeks(text: Column) -> Column:
    """Weeks that a text states: range (its lower end), weeks, months, days, semester."""
    t = F.lower(text)
    space = f"[{WS}]*"
    ranged = rf"(\d{{1,2}}){space}(?:-|–|to){space}(\d{{1,2}}){space}(week|month)s?"
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("int")
    months = lambda n: js_round(n * F.lit(WEEKS_PER_MONTH)).cast("int")
    low = number(ranged)
    weeks, month, days = (number(rf"(\d{{1,{k}}}){space}{unit}") for k, unit in ((3, "week"), (2, "month"), (3, "day")))
    return F.coalesce(
        F.when(low.isNotNull(), F.when(F.regexp_extract(t, ranged, 3) == "month", months(low)).otherwise(low)),
        weeks, months(month), F.greatest(F.lit(1), js_round(days / 7).cast("int")) + F.lit(0) * days,
        F.when(t.rlike(f"{B0}semester{B1}"), F.lit(SEMESTER_WEEKS)),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))
