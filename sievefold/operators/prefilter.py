"""The rule-based pre-filter: a row-local plan that keeps every reason for rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..criteria import AXES, AXIS_VALUES, OTHER, Criteria, multiplier_table
from ..functions import geo, signals
from ..functions.keywords import hits
from ..functions.text import listing_text, number_text

#: Columns that the pre-filter adds.
RESULT = ("status", "reasons", "matched_keywords", "keyword_match_source", "distance_km", "suburb", "state", "location_method", *AXES, "duration_weeks", "preference_multiplier")


def _reasons(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def _once(c: Column) -> Column:
    """The column itself; the optimizer won't copy it into a filter above, where all of
    it would be computed a second time."""
    return F.when(F.monotonically_increasing_id() >= 0, c)  # always true, but not deterministic


def location_reason(c: Criteria, raw: Column, distance: Column) -> Column:
    f = c.filter
    shown = F.coalesce(raw, F.lit("null"))
    unknown = (
        F.when(~geo.has_local_signal(raw), F.concat(F.lit('non_australian_location: "'), shown, F.lit('"')))
        if f.keep_unknown_location
        else F.concat(F.lit('location_unresolved: could not place "'), shown, F.lit('"'))
    )
    far = F.concat(F.lit("out_of_radius: "), number_text(distance), F.lit(f"km from {f.center_label} (limit {f.radius_km}km)"))
    return F.when(distance.isNull(), unknown).when(distance > f.radius_km, far)


def duration_reasons(c: Criteria, weeks: Column) -> list[Column]:
    f = c.filter
    short = F.when(weeks < f.min_duration_weeks, F.concat(F.lit("too_short: ~"), weeks.cast("string"), F.lit(f"w (minimum {f.min_duration_weeks}w)")))
    if f.max_duration_weeks is None:
        return [short]
    return [short, F.when(weeks > f.max_duration_weeks, F.concat(F.lit("too_long: ~"), weeks.cast("string"), F.lit(f"w (maximum {f.max_duration_weeks}w)")))]


def age_reason(c: Criteria, posted: Column, now: Column) -> Column:
    days = (F.unix_micros(now) - F.unix_micros(posted)) / F.lit(86_400_000_000.0)
    limit = c.filter.max_listing_age_days
    return F.when(days > limit, F.concat(F.lit("too_old: posted "), signals.js_round(days).cast("string"), F.lit(f"d ago (limit {limit}d)")))


def prefilter(listings: DataFrame, criteria: Criteria, now: str) -> DataFrame:
    """Adds RESULT to listings (title, company, description, location_raw, latitude,
    longitude, salary_min, salary_is_predicted, posted_date, provider_matched_term,
    hint_commitment, hint_work_mode, hint_role_type).

    Reasons are collected in the order location, excludes, work rights, keywords, age,
    duration.  The one join is to the combinations of axis values; a value of none weighs 1.
    """
    c, f = criteria, criteria.filter
    base = [x for x in listings.columns if x not in RESULT]
    moment = F.lit(now).cast("timestamp")
    text, title = F.col("_text"), F.col("title")
    x = listings.select(*base).withColumns({"_text": _once(listing_text()), "_loc": _once(geo.resolve_location("location_raw", "latitude", "longitude")), "_low_title": F.lower("title")})
    x = x.withColumn("_low_text", F.lower("_text"))
    subjects = (title, text, F.col("_low_title"), F.col("_low_text"))
    x = x.withColumns(
        {
            "distance_km": geo.distance_from(f.center_lat, f.center_lng, F.col("_loc.lat"), F.col("_loc.lng")),
            "suburb": F.col("_loc.suburb"),
            "state": F.col("_loc.state"),
            "location_method": F.col("_loc.method"),
            "compensation": signals.compensation(text, F.col("salary_min"), F.col("salary_is_predicted")),
            "work_mode": F.coalesce("hint_work_mode", signals.work_mode(text)),
            "commitment": F.coalesce("hint_commitment", signals.commitment(text)),
            "role_type": F.coalesce("hint_role_type", signals.role_type(text)),
            "duration_weeks": _once(signals.duration_weeks(text)),
            "_excluded": hits(c.of("exclude"), *subjects),
            "_rights": hits(c.of("exclude_work_rights") if f.exclude_sponsorship_required else [], *subjects),
            "_included": hits(c.of("include"), *subjects),
        }
    )
    domain = sorted({k.term for k in c.of("include") if k.category == "domain"})
    structural = {k.term for k in c.of("include")} - set(domain)
    term = F.col("provider_matched_term")
    in_text = F.exists("_included", lambda t: ~t.isin(*structural)) if structural else F.size("_included") > 0
    by_provider = F.coalesce(term.isin(*domain), F.lit(False)) if domain else F.lit(False)
    x = x.withColumn("keyword_match_source", F.when(in_text, "text").when(by_provider, "provider").otherwise("none"))
    added = (F.col("keyword_match_source") == "provider") & ~F.array_contains("_included", F.coalesce(term, F.lit("")))
    tag = lambda name, items: F.transform(items, lambda t: F.concat(F.lit(f'{name}: "'), t, F.lit('"')))
    reasons = F.concat(
        _reasons(location_reason(c, F.col("location_raw"), F.col("distance_km"))),
        tag("excluded_keyword", F.col("_excluded")),
        tag("work_rights", F.col("_rights")),
        _reasons(
            F.when(F.col("keyword_match_source") == "none", F.lit("no_domain_keyword_match")),
            age_reason(c, F.col("posted_date").cast("timestamp"), moment),
            *duration_reasons(c, F.col("duration_weeks")),
        ),
    )
    x = x.withColumns({"reasons": _once(reasons), "matched_keywords": F.when(added, F.array_append("_included", term)).otherwise(F.col("_included"))})
    weights = F.broadcast(multiplier_table(listings.sparkSession, c.preferences))
    known = lambda a: F.when(x[a].isin(*AXIS_VALUES[a]), x[a]).otherwise(OTHER)
    x = x.join(weights.select("multiplier", *(F.col(a).alias(f"_{a}") for a in AXES)), [known(a) == F.col(f"_{a}") for a in AXES], "left")
    return x.select(
        *base,
        F.when(F.size("reasons") == 0, "passed").otherwise("rejected").alias("status"),
        *(r for r in RESULT if r not in ("status", "preference_multiplier")),
        F.col("multiplier").alias("preference_multiplier"),
    )


def fit_score(base: Column, multiplier: Column) -> Column:
    """Base score times multiplier, rounded, within 0 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), signals.js_round(base * multiplier.cast("double")).cast("int")))


def reason_key(reason: Column) -> Column:
    return F.trim(F.split_part(reason, F.lit(":"), F.lit(1)))
