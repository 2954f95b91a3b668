"""DuckDB SQL of the listing queries, generated from the same criteria.

RE2 has neither look-around nor back-references, so guards consume a character, which is
the same for a yes-or-no test.
"""

from __future__ import annotations

from .criteria import AXES, AXIS_VALUES, MULTIPLIER_MAX, MULTIPLIER_MIN, Criteria, Keyword
from .functions import geo, signals
from .functions.text import escape_re
from .functions.urls import TRACKING
from .sources.listing_view import NOW, listings_sql, sql_text

_GAP = r"[\s-]*"


def _flexible(term: str) -> str:
    return _GAP.join(escape_re(w) for w in term.split())


def _says(text: str, phrases: tuple[str, ...]) -> str:
    alts = "|".join(_flexible(p) for p in phrases)
    return f"regexp_matches({text}, '(?i)(^|[^a-z])(?:{alts})($|[^a-z])')"


def _hit(k: Keyword) -> str:
    body = _flexible(k.term)
    pattern = f"(^|[^A-Za-z0-9])(?:{body})($|[^A-Za-z0-9])" if k.whole_word else body
    flag = "" if k.case_sensitive else "(?i)"
    return f"regexp_matches({'title' if k.match_scope == 'title' else 'text'}, {sql_text(flag + pattern)})"


def _hits(words: list[Keyword], make=lambda t: t) -> str:
    if not words:
        return "[]::VARCHAR[]"
    return "list_filter([" + ", ".join(f"CASE WHEN {_hit(k)} THEN {sql_text(make(k.term))} END" for k in words) + "], lambda x: x IS NOT NULL)"


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"{sql_text(k)}: {{'name': {sql_text(p[0])}, 'state': {sql_text(p[1])}, 'lat': {p[2]}::DOUBLE, 'lng': {p[3]}::DOUBLE}}" for k, p in pairs.items()) + "}"


_STATES = "|".join(geo.STATES)
STATE = f"CASE WHEN regexp_matches(location_raw, '(?i)\\b({_STATES})\\b') THEN upper(regexp_extract(location_raw, '(?i)\\b({_STATES})\\b', 1)) " + " ".join(f"WHEN regexp_matches(location_raw, '(?i)\\b{n}\\b') THEN '{s}'" for n, s in geo.STATE_NAMES) + " END"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '\\b\\d{{4}}\\b', '', 'g'), '(?i)\\b({_STATES})\\b', '', 'g')"
_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_NAME = lambda x: _TRIM(f"regexp_replace(regexp_replace(lower({x}), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')")
FIRST = f"nullif({_TRIM(_STRIP('regexp_split_to_array(location_raw, $$[,/|]$$)[1]'))}, '')"
LOCAL = f"coalesce(({STATE}) IS NOT NULL OR regexp_matches(location_raw, '(?i)\\baustralia') OR regexp_matches(location_raw, '(^|\\D)\\d{{4}}($|\\D)'), false)"


def located() -> str:
    """l: listings with their place and distance columns."""
    by_name, by_code, alias = geo.indexes()
    return f"""base AS MATERIALIZED ({listings_sql()}),
l1 AS (SELECT *, regexp_extract(location_raw, '\\b(\\d{{4}})\\b', 1) AS code,
 list_filter([{_NAME(_STRIP('s'))} for s in regexp_split_to_array(location_raw, '[,/|]')], lambda s: s <> '') AS segs, {_NAME('location_raw')} AS whole FROM base),
l2 AS (SELECT *, {_map(by_code)}[code] AS p1, list_filter([{_map(by_name)}[s] for s in segs], lambda p: p IS NOT NULL)[1] AS p2,
 coalesce({_map(alias)}[whole], list_filter([{_map(alias)}[s] for s in segs], lambda p: p IS NOT NULL)[1]) AS p3 FROM l1),
l3 AS (SELECT *, CASE WHEN latitude IS NOT NULL THEN 'coordinates' WHEN p1 IS NOT NULL THEN 'postcode' WHEN p2 IS NOT NULL THEN 'suburb' WHEN p3 IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS location_method,
 coalesce(p1, p2, p3) AS p FROM l2),
l4 AS (SELECT *, CASE WHEN latitude IS NOT NULL THEN latitude ELSE p.lat END AS lat, CASE WHEN latitude IS NOT NULL THEN longitude ELSE p.lng END AS lng,
 CASE WHEN location_method IN ('coordinates', 'unresolved') THEN {FIRST} ELSE p.name END AS suburb,
 CASE WHEN location_method IN ('coordinates', 'unresolved') THEN {STATE} ELSE p.state END AS state FROM l3)"""


def distance(lat: float, lng: float) -> str:
    h = f"pow(sin(radians(lat - ({lat})) / 2), 2) + pow(sin(radians(lng - {lng}) / 2), 2) * cos(radians({lat})) * cos(radians(lat))"
    return f"round({2 * geo.EARTH_RADIUS_KM} * asin(sqrt({h})), 2)"


def signals_sql() -> str:
    """The axis expressions over text, salary_min, salary_is_predicted and hints."""
    s = signals
    cascade = lambda pairs, other: "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in pairs) + f" ELSE '{other}' END"
    stated = "coalesce(salary_min > 0 AND NOT coalesce(salary_is_predicted, false), false)"
    remote, onsite = _says("text", s.REMOTE), _says("text", s.ONSITE)
    ranged = r"(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s*(week|month)s?"
    number = lambda p: f"nullif(regexp_extract(lower(text), '{p}', 1), '')::INT"
    months = lambda n: f"floor({n} * {s.WEEKS_PER_MONTH}::DOUBLE + 0.5)::INT"
    low, week, month, day = (number(p) for p in (ranged, r"(\d{1,3})\s*week", r"(\d{1,2})\s*month", r"(\d{1,3})\s*day"))
    return f"""{cascade([(_says('text', s.UNPAID), 'unpaid'), (f"{stated} OR {_says('text', s.PAID)}", 'paid')], 'unknown')} AS compensation,
 {cascade([(f"{_says('text', s.HYBRID)} OR ({remote} AND {onsite})", 'hybrid'), (remote, 'remote'), (onsite, 'onsite')], 'unknown')} AS work_mode,
 coalesce(hint_commitment, {cascade([(_says('text', s.CASUAL), 'casual'), (_says('text', s.PART_TIME), 'part_time'), (_says('text', s.CONTRACT), 'contract'), (_says('text', s.FULL_TIME), 'full_time')], 'unknown')}) AS commitment,
 {cascade([(_says('text', s.INTERNSHIP), 'internship')], 'job')} AS role_type,
 coalesce(CASE WHEN {low} IS NOT NULL THEN CASE WHEN regexp_extract(lower(text), '{ranged}', 3) = 'month' THEN {months(low)} ELSE {low} END END,
  {week}, {months(month)}, CASE WHEN {day} IS NOT NULL THEN greatest(1, floor({day} / 7.0::DOUBLE + 0.5)::INT) END, CASE WHEN regexp_matches(lower(text), '\\bsemester\\b') THEN {s.SEMESTER_WEEKS} END) AS duration_weeks"""


def multiplier_sql(c: Criteria) -> str:
    weight = {(d, v): w for d, v, w in c.preferences}
    factors = " * ".join("CASE " + axis + " " + " ".join(f"WHEN '{v}' THEN {weight.get((axis, v), 1.0)}::DOUBLE" for v in AXIS_VALUES[axis]) + " END" for axis in AXES)
    return f"printf('%.2f', least({MULTIPLIER_MAX}::DOUBLE, greatest({MULTIPLIER_MIN}::DOUBLE, {factors})))::DECIMAL(4,2)"


TEXT = "array_to_string(list_filter([title, company, description], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS text"
_NUM = lambda x: f"regexp_replace({x}::VARCHAR, '\\.0$', '')"


def prefiltered(c: Criteria, name: str = "pf", source: str = "l4") -> str:
    """CTEs that end in ``name``: the pre-filter's result for every listing of ``source``."""
    f = c.filter
    include = c.of("include")
    domain = ", ".join(sql_text(k.term) for k in include if k.category == "domain")
    structural = ", ".join(sql_text(k.term) for k in include if k.category == "structural") or "NULL"
    shown = "coalesce(location_raw, 'null')"
    unknown = f"CASE WHEN NOT {LOCAL} THEN 'non_australian_location: \"' || {shown} || '\"' END" if f.keep_unknown_location else f"'location_unresolved: could not place \"' || {shown} || '\"'"
    days = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_date)) / 86400000000.0::DOUBLE"
    longest = "" if f.max_duration_weeks is None else f", CASE WHEN duration_weeks > {f.max_duration_weeks} THEN 'too_long: ~' || duration_weeks || 'w (maximum {f.max_duration_weeks}w)' END"
    return f"""{name}_1 AS (SELECT *, {distance(f.center_lat, f.center_lng)} AS distance_km, {TEXT} FROM {source}),
{name}_2 AS (SELECT *, {signals_sql()}, {_hits(c.of('exclude'), lambda t: f'excluded_keyword: "{t}"')} AS ex, {_hits(c.of('exclude_work_rights') if f.exclude_sponsorship_required else [], lambda t: f'work_rights: "{t}"')} AS wr, {_hits(include)} AS inc FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN len(list_filter(inc, lambda t: t NOT IN ({structural}))) > 0 THEN 'text' WHEN provider_matched_term IN ({domain}) THEN 'provider' ELSE 'none' END AS keyword_match_source FROM {name}_2),
{name}_4 AS (SELECT *, list_filter([CASE WHEN distance_km IS NULL THEN {unknown} WHEN distance_km > {f.radius_km} THEN 'out_of_radius: ' || {_NUM('distance_km')} || 'km from {f.center_label} (limit {f.radius_km}km)' END]
  || ex || wr || [CASE WHEN keyword_match_source = 'none' THEN 'no_domain_keyword_match' END, CASE WHEN {days} > {f.max_listing_age_days} THEN 'too_old: posted ' || floor({days} + 0.5)::BIGINT || 'd ago (limit {f.max_listing_age_days}d)' END,
  CASE WHEN duration_weeks < {f.min_duration_weeks} THEN 'too_short: ~' || duration_weeks || 'w (minimum {f.min_duration_weeks}w)' END{longest}], lambda r: r IS NOT NULL) AS reasons,
  CASE WHEN keyword_match_source = 'provider' AND NOT list_contains(inc, provider_matched_term) THEN list_append(inc, provider_matched_term) ELSE inc END AS matched_keywords,
  {multiplier_sql(c)} AS preference_multiplier FROM {name}_3),
{name} AS MATERIALIZED (SELECT *, CASE WHEN len(reasons) = 0 THEN 'passed' ELSE 'rejected' END AS status FROM {name}_4)"""


def fit(base: str = "base_score", mult: str = "preference_multiplier") -> str:
    return f"least(100, greatest(0, floor({base} * {mult}::DOUBLE + 0.5)::INT))"


# Filler words of titles.
_TITLE_NOISE = "job|jobs|vacancy|vacancies|position|opportunity|opportunities|role|hiring|urgent|new|apply now|m/f/d"


def fingerprint(title: str, company: str) -> str:
    part = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\b(?:{_TITLE_NOISE})\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    return f"sha256({part(title)} || '|' || {part(company)})"


def canonical(url: str) -> str:
    """For absolute http(s) URLs without ports and user names."""
    names = ", ".join(sql_text(t) for t in TRACKING)
    rest = f"regexp_replace(regexp_replace({url}, '(?i)^https?://', ''), '#.*$', '')"
    host = f"regexp_replace(lower(regexp_extract({rest}, '^[^/?]*', 0)), '^www\\.', '')"
    path = f"coalesce(nullif(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), ''), '/')"
    pairs = f"list_filter(string_split(regexp_extract({rest}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({names}) AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_'))"
    query = f"array_to_string(list_sort([CASE WHEN contains(p, '=') THEN p ELSE p || '=' END for p in {pairs}]), '&')"
    tail = f"CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    return f"'https://' || {host} || {tail} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"
