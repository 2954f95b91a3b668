"""Search criteria as data: one filter, its keywords and its preference weights.

Criteria are rows, loaded per run and turned into plan literals; changing a row changes
the next plan and no code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

from pyspark.sql import DataFrame, SparkSession

AXES = ("compensation", "work_mode", "commitment", "role_type")
#: Every value that a signal axis can take.
AXIS_VALUES = {
    "compensation": ("unpaid", "paid", "unknown"),
    "work_mode": ("onsite", "hybrid", "remote", "unknown"),
    "commitment": ("part_time", "casual", "contract", "full_time", "unknown"),
    "role_type": ("internship", "job", "unknown"),
}
MULTIPLIER_MIN, MULTIPLIER_MAX = 0.75, 1.35


@dataclass(frozen=True)
class Keyword:
    term: str
    kind: str  # include, exclude, exclude_work_rights
    weight: float = 1.0
    whole_word: bool = False
    case_sensitive: bool = False
    category: str = "domain"  # domain or structural
    match_scope: str = "text"  # text or title
    is_active: bool = True


@dataclass(frozen=True)
class Filter:
    name: str = "Melbourne — IT & cyber"
    center_label: str = "Melbourne VIC 3000"
    center_lat: float = -37.8136
    center_lng: float = 144.9631
    radius_km: int = 50
    min_duration_weeks: int = 6
    max_duration_weeks: int | None = None
    exclude_sponsorship_required: bool = True
    max_listing_age_days: int = 30
    keep_unknown_location: bool = True


@dataclass(frozen=True)
class Criteria:
    filter: Filter = field(default_factory=Filter)
    keywords: tuple[Keyword, ...] = ()
    #: (dimension, value, weight); missing pairs weigh 1
    preferences: tuple[tuple[str, str, float], ...] = ()

    def of(self, kind: str) -> list[Keyword]:
        return [k for k in self.keywords if k.is_active and k.kind == kind]

    def with_filter(self, **changes) -> Criteria:
        return replace(self, filter=replace(self.filter, **changes))


# The seeded criteria, in their natural order.
# (term, weight, whole word)
_INCLUDE = (
    ("IT", 1.0, True),
    ("Information Technology", 1.1, False),
    ("Data Entry", 1.0, False),
    ("Cyber Security", 1.5, False),
    ("Cybersecurity", 1.5, False),
    ("Information Security", 1.4, False),
    ("InfoSec", 1.3, False),
    ("Network Security", 1.3, False),
    ("Blue Team", 1.5, False),
    ("SOC Analyst", 1.5, False),
    ("Security Operations", 1.4, False),
    ("Incident Response", 1.35, False),
    ("Threat Intelligence", 1.3, False),
    ("Digital Forensics", 1.3, False),
    ("SIEM", 1.3, True),
    ("Splunk", 1.2, True),
    ("Security Analyst", 1.4, False),
    ("Penetration Testing", 1.2, False),
    ("GRC", 1.15, True),
    ("Identity and Access", 1.15, False),
    ("Help Desk", 1.2, False),
    ("Helpdesk", 1.2, False),
    ("Service Desk", 1.2, False),
    ("IT Support", 1.3, False),
    ("Desktop Support", 1.2, False),
    ("Technical Support", 1.1, False),
    ("Systems Administrator", 1.1, False),
    ("Network Administrator", 1.1, False),
    ("Internship", 1.25, False),
    ("Intern", 1.15, True),
    ("Trainee", 1.1, False),
    ("Cadet", 1.1, False),
    ("Work Experience", 1.1, False),
    ("Vulnerability Management", 1.2, False),
    ("Vulnerability Assessment", 1.2, False),
    ("Web Developer", 1.15, False),
    ("Software Engineer", 1.15, False),
    ("Software Developer", 1.15, False),
    ("Junior Developer", 1.2, False),
    ("Graduate Developer", 1.15, False),
    ("Full Stack", 1.1, False),
    ("Frontend Developer", 1.05, False),
    ("Backend Developer", 1.05, False),
    ("DevSecOps", 1.45, False),
    ("DevOps", 1.3, False),
    ("Site Reliability", 1.2, False),
    ("Cloud Engineer", 1.2, False),
    ("AWS", 1.1, True),
    ("Azure", 1.1, True),
    ("Network Engineer", 1.25, False),
    ("Database Administrator", 1.1, False),
    ("Systems Analyst", 1.1, False),
    ("Application Support", 1.2, False),
    ("Technical Analyst", 1.1, False),
    ("QA Engineer", 1.05, False),
    ("Software Testing", 1.05, False),
)
_EXCLUDE_TEXT = (
    "Security Guard",
    "Security Officer",
    "Crowd Control",
    "Concierge",
    "Loss Prevention",
    "Patrol",
    "Cash in Transit",
    "Door Supervisor",
    "Sales Representative",
    "Business Development Manager",
    "Head of",
    "Principal Consultant",
    "Chief Information Security Officer",
)
_EXCLUDE_DOMAIN_TITLE = (
    "Nurse",
    "Nursing",
    "Midwife",
    "Paramedic",
    "Pharmacist",
    "Physiotherapist",
    "Psychologist",
    "Therapist",
    "Dentist",
    "General Practitioner",
    "Support Worker",
    "Disability Support",
    "Aged Care",
    "Personal Care",
    "Social Worker",
    "Harm Reduction",
    "Cleaner",
    "Cleaning",
    "Chef",
    "Cook",
    "Barista",
    "Bartender",
    "Waiter",
    "Waitress",
    "Housekeeper",
    "Kitchen Hand",
    "Sales Assistant",
    "Retail Assistant",
    "Store Manager",
    "Forklift",
    "Warehouse Operator",
    "Truck Driver",
    "Delivery Driver",
    "Educator",
    "Childcare",
    "Teacher",
    "Tutor",
    "Lecturer",
)
_EXCLUDE_SENIOR_TITLE = (
    "Senior",
    "Snr",
    "Sr",
    "Lead",
    "Principal",
    "Manager",
    "Director",
    "Chief",
    "Supervisor",
    "Architect",
    "Executive",
    "Superintendent",
    "Foreman",
    "Vice President",
    "Partner",
)
_WORK_RIGHTS = (
    "must be an Australian Citizen",
    "Australian Citizenship is required",
    "Permanent Residents only",
    "NV1",
    "NV2",
    "Baseline Clearance",
    "Negative Vetting",
    "AGSVA",
    "Security Clearance",
    "Graduate Program",
    "Graduate Programme",
    "visa sponsorship",
    "sponsorship is not available",
    "unrestricted work rights",
)
_WORK_RIGHTS_WORDS = {"NV1", "NV2", "AGSVA"}
_STRUCTURAL = {"internship", "intern", "trainee", "traineeship", "cadet", "cadetship", "work experience"}
_PREFERENCES = (
    ("compensation", "unpaid", 1.35), ("compensation", "paid", 1.0), ("compensation", "unknown", 1.0),
    ("work_mode", "onsite", 1.3), ("work_mode", "hybrid", 1.1), ("work_mode", "remote", 0.85), ("work_mode", "unknown", 1.0),
    ("commitment", "part_time", 1.3), ("commitment", "casual", 1.25), ("commitment", "contract", 1.0), ("commitment", "full_time", 0.85), ("commitment", "unknown", 1.0),
    ("role_type", "internship", 1.2), ("role_type", "job", 1.0), ("role_type", "unknown", 1.0),
)
# The criteria of the expected-outcome table, as (kind, term, whole word, scope).
_TEST = (
    ("include", "IT", True, "text"),
    ("include", "Cyber Security", False, "text"),
    ("include", "Information Security", False, "text"),
    ("include", "SOC Analyst", False, "text"),
    ("include", "Blue Team", False, "text"),
    ("include", "IT Support", False, "text"),
    ("include", "Help Desk", False, "text"),
    ("include", "Helpdesk", False, "text"),
    ("include", "Service Desk", False, "text"),
    ("include", "Data Entry", False, "text"),
    ("include", "Internship", False, "text"),
    ("include", "Intern", True, "text"),
    ("include", "Work Experience", False, "text"),
    ("exclude", "Security Guard", False, "text"),
    ("exclude", "Cleaner", False, "title"),
    ("exclude", "Nurse", False, "title"),
    ("exclude", "Security Officer", False, "text"),
    ("exclude", "Crowd Control", False, "text"),
    ("exclude", "Loss Prevention", False, "text"),
    ("exclude_work_rights", "must be an Australian Citizen", False, "text"),
    ("exclude_work_rights", "Baseline Clearance", False, "text"),
    ("exclude_work_rights", "Graduate Program", False, "text"),
    ("exclude_work_rights", "visa sponsorship", False, "text"),
)


def acronym(term: str) -> bool:
    """All-capital initialisms are matched with exact case."""
    return bool(re.fullmatch(r"[A-Z0-9]{2,6}", term))


def _category(term: str) -> str:
    return "structural" if term.lower() in _STRUCTURAL else "domain"


def seed_criteria() -> Criteria:
    """The production criteria: 56 include, 66 exclude and 14 work-rights terms."""
    words = [Keyword(t, "include", weight, word, acronym(t), _category(t)) for t, weight, word in _INCLUDE]
    words += [Keyword(t, "exclude") for t in _EXCLUDE_TEXT]
    words += [Keyword(t, "exclude", match_scope="title") for t in _EXCLUDE_DOMAIN_TITLE]
    words += [Keyword(t, "exclude", whole_word=True, category="structural", match_scope="title") for t in _EXCLUDE_SENIOR_TITLE]
    words += [Keyword(t, "exclude_work_rights", whole_word=t in _WORK_RIGHTS_WORDS, case_sensitive=acronym(t)) for t in _WORK_RIGHTS]
    return Criteria(Filter(), tuple(words), _PREFERENCES)


def small_criteria() -> Criteria:
    """The criteria of the expected-outcome table."""
    words = [Keyword(t, kind, whole_word=word, case_sensitive=acronym(t), category=_category(t), match_scope=scope) for kind, t, word, scope in _TEST]
    return Criteria(Filter(), tuple(words), _PREFERENCES)


def multiplier_of(values: tuple[str, ...], preferences: tuple[tuple[str, str, float], ...]) -> tuple[Decimal, bool]:
    """Clamped product of the four weights at two decimals, and whether it was clamped.

    The product is IEEE double in fixed axis order, and rounding works on its exact
    binary value (1.3 * 0.85 gives 1.10, not 1.11)."""
    weight = {(d, v): w for d, v, w in preferences}
    raw = 1.0
    for axis, value in zip(AXES, values, strict=True):
        raw *= weight.get((axis, value), 1.0)
    held = min(MULTIPLIER_MAX, max(MULTIPLIER_MIN, raw))
    return Decimal(held).quantize(Decimal("0.01"), ROUND_HALF_UP), held != float(Decimal(raw).quantize(Decimal("0.0001"), ROUND_HALF_UP))


#: Stands for axis values that aren't among AXIS_VALUES.
OTHER = "other"


def multiplier_table(spark: SparkSession, preferences: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """All combinations of axis values, and of ``OTHER`` for any further value, which weighs
    1, with their multiplier: a broadcast dimension of a few hundred rows."""
    rows = [(*v, *multiplier_of(v, preferences)) for v in product(*((*AXIS_VALUES[a], OTHER) for a in AXES))]
    return spark.createDataFrame(rows, ", ".join(f"{a} string" for a in AXES) + ", multiplier decimal(4,2), clamped boolean")


def keyword_rows(spark: SparkSession, criteria: Criteria) -> DataFrame:
    schema = "ordinal int, term string, kind string, weight decimal(4,2), whole_word boolean, case_sensitive boolean, category string, match_scope string, is_active boolean"
    rows = [(i, k.term, k.kind, Decimal(str(k.weight)).quantize(Decimal("0.01")), k.whole_word, k.case_sensitive, k.category, k.match_scope, k.is_active) for i, k in enumerate(criteria.keywords)]
    return spark.createDataFrame(rows, schema)


def preference_rows(spark: SparkSession, criteria: Criteria) -> DataFrame:
    return spark.createDataFrame([(d, v, float(w), True) for d, v, w in criteria.preferences], "dimension string, value string, weight double, is_active boolean")


def load_criteria(filters: DataFrame, keywords: DataFrame, preferences: DataFrame) -> Criteria:
    """The one active filter with its active keywords (in ``ordinal`` order) and preferences."""
    active = filters.where("is_active").limit(2).collect()
    if len(active) != 1:
        raise ValueError(f"exactly one criteria set must be active, found {len(active)}")
    f = active[0]
    names = set(Filter.__dataclass_fields__)
    fields = {k: (float(v) if k in ("center_lat", "center_lng") and v is not None else v) for k, v in f.asDict().items() if k in names}
    own = lambda df: df.where((df["filter_id"] == f["id"]) & df["is_active"])
    words = own(keywords).orderBy("ordinal").collect()
    prefs = own(preferences).orderBy("dimension", "value").collect()
    return Criteria(
        Filter(**fields),
        tuple(Keyword(r.term, r.kind, float(r.weight), r.whole_word, r.case_sensitive, r.category, r.match_scope) for r in words),
        tuple((r.dimension, r.value, float(r.weight)) for r in prefs),
    )
