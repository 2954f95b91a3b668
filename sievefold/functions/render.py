"""Message rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hosts import let
from .signals import js_round
from .text import WS, js_trim, non_empty
from .urls import link_host

MAX_MESSAGE, MAX_REASONING = 4096, 600
ACTIONS = {"applied": "a", "dismissed": "d", "saved": "s"}


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_ASTRAL = r"[\x{10000}-\x{10ffff}]"


def units(c: Column) -> Column:
    """A text's length as the messenger counts it: in UTF-16 units, of which characters
    beyond the first plane, such as pictures, take two."""
    return F.length(c) + F.regexp_count(c, F.lit(_ASTRAL))


def take_units(c: Column, limit: Column) -> Column:
    """The first characters that have ``limit`` units together; none is halved."""
    some = F.substring(c, F.lit(1), limit)
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))

    def step(s: Column, ch: Column) -> Column:
        n = s["n"] + F.when(ch.rlike(_ASTRAL), 2).otherwise(1)
        return F.struct(n.alias("n"), F.when(n <= limit, F.concat(s["text"], ch)).otherwise(s["text"]).alias("text"))

    return F.when(units(some) <= limit, some).otherwise(F.aggregate(F.split(some, ""), start, step)["text"])


def truncate(c: Column, limit: Column | int) -> Column:
    """Trimmed; if longer than the limit in units, cut at the last blank beyond 60 % of it."""
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def ended(cut: Column) -> Column:
        head = F.substring(cut, F.lit(1), F.length(cut) - F.instr(F.reverse(cut), " "))  # before the last blank
        short = F.when(cut.contains(" ") & (units(head) > limit * 0.6), head).otherwise(cut)
        return F.concat(F.regexp_replace(short, rf"[{WS}]+$", ""), F.lit("…"))

    return let(js_trim(c), lambda t: F.when(units(t) <= limit, t).otherwise(let(take_units(t, limit), ended)))


def truncate_escaped(c: Column, limit: Column | int) -> Column:
    """As truncate, without half an entity at the end."""
    return F.regexp_replace(truncate(c, limit), "(?i)&[a-z]{0,4}$", "")


def posted_text(value: Column) -> Column:
    """``19 Aug 2026`` in UTC; text that is no time stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(value), "d MMM yyyy"), value)


def label(c: Column) -> Column:
    return F.when(c == "full_time", "full-time").when(c == "part_time", "part-time").when(c == "onsite", "on-site").otherwise(c)


def _joined(parts: list[Column], by: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), by)


def facts_line(category: Column, *axes: Column, weeks: Column) -> Column:
    known = [F.when(non_empty(a) & (a != "unknown"), label(a)) for a in (category, *axes)]
    return _joined([*known, F.when(weeks.isNotNull(), F.concat(F.lit("~"), weeks.cast("string"), F.lit(" weeks")))], " · ")


def place_line(suburb: Column, distance: Column) -> Column:
    return _joined([F.when(non_empty(suburb), suburb), F.concat(js_round(distance).cast("string"), F.lit(" km away"))], " · ")


def score_explanation(base: Column, multiplier: Column) -> Column:
    raw = js_round(base * multiplier.cast("double"))
    text = F.concat(base.cast("string"), F.lit(" resume match × "), multiplier.cast("decimal(4,2)").cast("string"), F.lit(" preference"))
    return F.when(raw > 100, F.concat(text, F.lit(" = "), raw.cast("string"), F.lit(", capped at 100"))).otherwise(text)


def match_card(m: dict[str, Column]) -> Column:
    """The message of one match from its columns; the reasoning takes what room is left."""
    line = lambda shown, text: F.when(non_empty(shown), text)
    place, facts = place_line(m["suburb"], m["distance_km"]), facts_line(m["category"], m["compensation"], m["work_mode"], m["commitment"], weeks=m["duration_weeks"])
    head = [
        F.concat(F.lit("<b>"), m["fit_score"].cast("string"), F.lit("</b> · <b>"), escape_html(m["title"]), F.lit("</b>")),
        line(m["company"], escape_html(m["company"])),
        line(place, F.concat(F.lit("📍 "), escape_html(place))),
        line(facts, F.concat(F.lit("💼 "), escape_html(facts))),
    ]
    tail = [
        F.concat(F.lit("\n<i>"), score_explanation(m["base_score"], m["multiplier"]), F.lit("</i>")),
        line(m["posted"], F.concat(F.lit("<i>posted "), escape_html(posted_text(m["posted"])), F.lit("</i>"))),
        F.concat(F.lit('\n<a href="'), escape_html(m["url"]), F.lit('">Open on '), escape_html(link_host(m["url"])), F.lit(" →</a>")),
    ]
    # each part is bound once: columns repeat whatever they are used for
    fixed = F.struct(_joined(head, "\n").alias("head"), _joined(tail, "\n").alias("tail"))
    room = lambda x: F.least(F.lit(MAX_REASONING), F.lit(MAX_MESSAGE - 9) - units(x["head"]) - units(x["tail"]))
    why = lambda n: F.when(n > 0, let(escape_html(F.coalesce(m["reasoning"], F.lit(""))), lambda t: truncate_escaped(t, n)))
    whole = lambda x, w: _joined([x["head"], F.when(non_empty(w), F.concat(F.lit("\n"), w)), x["tail"]], "\n")
    return let(fixed, lambda x: let(let(room(x), why), lambda w: whole(x, w)))


def encode_callback(decision: Column, match_id: Column) -> Column:
    code = F.lit(None).cast("string")
    for k, v in ACTIONS.items():
        code = F.when(decision == k, v).otherwise(code)
    return F.concat(code, F.lit(":"), match_id)


def decode_callback(data: Column) -> Column:
    """struct(decision, match_id), null for anything unknown."""
    pattern = r"(?i)^([ads]):([0-9a-f-]{36}|-?\d{1,19})$"  # a match's uuid, or its number here
    code = F.regexp_extract(data, "^(.):", 1)
    decision = F.lit(None).cast("string")
    for k, v in ACTIONS.items():
        decision = F.when(code == v, k).otherwise(decision)
    return F.when(data.rlike(pattern) & decision.isNotNull(), F.struct(decision.alias("decision"), F.regexp_extract(data, pattern, 2).alias("match_id")))


# What the buttons and the settled cards say.
BUTTONS = {"applied": "✅ Applied", "saved": "⭐ Save", "dismissed": "🗑 Dismiss"}
OUTCOMES = {"applied": "✅ Marked as applied", "saved": "⭐ Saved for later", "dismissed": "🗑 Dismissed"}


def match_keyboard(match_id: Column, decisions: tuple[str, ...] = ("applied", "saved", "dismissed")) -> Column:
    """One row of buttons as JSON."""
    button = lambda d: F.struct(F.lit(BUTTONS[d]).alias("text"), encode_callback(F.lit(d), match_id).alias("callback_data"))
    return F.to_json(F.array(F.array(*map(button, decisions))))


def keyboard_after(decision: Column, match_id: Column) -> Column:
    """The buttons that stay once a decision is recorded: a saved match may still be applied
    for or dismissed, the other decisions are final (null)."""
    return F.when(decision == "saved", match_keyboard(match_id, ("applied", "dismissed")))


def with_decision(text: Column, decision: Column) -> Column:
    """The message with the decision as its last line, in place of an earlier one; null for
    an unknown decision."""
    marks = "|".join(t.split(" ")[0] for t in OUTCOMES.values())
    outcome = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))[decision]
    return truncate(F.concat(F.regexp_replace(text, rf"\n*(?:{marks}) [^\n\r\u2028\u2029]*\z", ""), F.lit("\n\n"), outcome), MAX_MESSAGE)


def filters_message(f: dict[str, Column]) -> Column:
    """The active criteria as one message: name, center_label, radius_km, threshold, and the
    arrays include, exclude (terms) and preferences (axis, value, weight)."""
    t = lambda k: f[k].cast("string")
    head = lambda name, k: F.concat(F.lit(f"<b>{name}</b> ("), F.size(f[k]).cast("string"), F.lit(")"))
    terms = lambda k, limit: or_else(escape_html(truncate(F.array_join(f[k], ", "), limit)), "  none")
    told = F.transform(F.filter(f["preferences"], lambda p: p["weight"] != 1), lambda p: F.concat(F.lit("  "), p["axis"], F.lit("="), label(p["value"]), F.lit(" ×"), F.format_string("%.2f", p["weight"].cast("double"))))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<b>"), escape_html(f["name"]), F.lit("</b>")),
        F.concat(t("radius_km"), F.lit(" km around "), escape_html(f["center_label"])),
        F.concat(F.lit("Notify at fit ≥ "), t("threshold")), F.lit(""),
        head("Include", "include"), terms("include", 700), F.lit(""),
        head("Exclude", "exclude"), terms("exclude", 500), F.lit(""),
        F.lit("<b>Preference weights</b>"), or_else(escape_html(F.array_join(told, "\n")), "  all neutral"), F.lit(""),
        F.lit("<i>Edit these in the database — they are read fresh on every poll, so no restart is needed.</i>"),
    )


def or_else(c: Column, text: str) -> Column:
    return F.when(non_empty(c), c).otherwise(F.lit(text))


def score_colour(score: Column) -> Column:
    return F.when(score >= 85, "green").when(score >= 70, "blue").when(score >= 50, "amber").otherwise("grey")


_ICONS = {"applied": "✅", "saved": "⭐", "dismissed": "🗑", "notified": "📨", "new": "·"}


def history_line(score: Column, title: Column, company: Column, status: Column) -> Column:
    icon = F.lit("·")
    for k, v in _ICONS.items():
        icon = F.when(status == k, v).otherwise(icon)
    head = F.concat(icon, F.lit(" <b>"), score.cast("string"), F.lit("</b> "), escape_html(truncate(title, 60)))
    return F.concat(head, F.when(non_empty(company), F.concat(F.lit("\n     "), escape_html(truncate(company, 50)))).otherwise(F.lit("")))


def stats_message(s: dict[str, Column]) -> Column:
    """The pipeline's numbers as one message, from the columns of pipeline_stats and the
    settings row (threshold, spent, spend_cap, notified, notify_cap, paused)."""
    t = lambda k: s[k].cast("string")
    money = lambda k, d: F.format_string(f"%.{d}f", s[k].cast("double"))
    decisions = F.concat_ws(" · ", *(F.concat(F.lit(f"{k} "), t(f"n_{k}")) for k in ("new", "notified", "saved", "applied", "dismissed")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<b>Pipeline</b>"), F.when(s["paused"], " — ⏸ paused").otherwise("")), F.lit(""),
        F.concat(F.lit("Listings   "), t("listings_total"), F.lit(" stored · "), t("listings_passed"), F.lit(" passed the filter · "), t("duplicates"), F.lit(" near-duplicates")),
        F.concat(F.lit("Scored     "), t("scored"), F.lit(" · "), t("awaiting_score"), F.lit(" awaiting")),
        F.concat(F.lit("Above "), t("threshold"), F.lit("   "), t("above_threshold")), F.lit(""),
        F.concat(F.lit("Decisions  "), decisions), F.lit(""),
        F.concat(F.lit("Spend      $"), money("spent", 4), F.lit(" of $"), money("spend_cap", 2), F.lit(" today")),
        F.concat(F.lit("Notified   "), t("notified"), F.lit(" of "), t("notify_cap"), F.lit(" today")),
    )
