"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(name: Column) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over all members of two arrays without repeats; null when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def predicate_name(text: Column) -> Column:
    """Lower case with runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(F.trim(F.lower(text)), r"[\s-]+", "_")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def interval_seconds(text: Column) -> Column:
    """Seconds of ``30s``, ``5m``, ``1h`` or ``1d``; null for anything else."""
    n = F.regexp_extract(text, r"^(\d+)([smhd])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    return F.when(n != "", n.cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based SHA-1 identifier in a namespace given as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def mention_context(content: Column, mention: Column, around: int = 100) -> Column:
    """The text around the first mention, or the mention and the head of the text."""
    spot = F.instr(F.lower(content), F.lower(mention))
    start = F.greatest(spot - around, F.lit(1))
    return F.when(spot > 0, F.substring(content, start, spot + F.length(mention) + around - start)).otherwise(F.concat(mention, F.lit(" "), F.substring(content, F.lit(1), F.lit(200))))


def sanitise(text: Column, hard: int = 3000, soft: int = 2000) -> Column:
    """Unix line ends, no control characters but tab and line end, at most two line ends in a row, capped length."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    clean = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    return F.when(F.length(clean) > hard, F.concat(F.substring(clean, 1, soft), F.lit("\n[truncated]"))).otherwise(clean)


def assistant_turn(text: Column) -> Column:
    """Whether a line opens with an assistant's label."""
    return text.rlike(r"(?im)^\s*(assistant|ai|bot)\s*:")


#: Irregular verbs, each with its other forms.
IRREGULAR_VERBS = """
be was is, bear bore, begin began begun, bend bent, break broke broken, bring brought, build built, buy bought, catch caught,
choose chose chosen, come came, deal dealt, draw drew drawn, drink drank drunk, drive drove driven, feel felt, fight fought,
find found, fly flew flown, freeze froze frozen, get got gotten, give gave given, go went, grow grew grown, have has had,
hold held, keep kept, know knew known, lead led, leave left, lend lent, lose lost, make made, mean meant, meet met,
ring rang rung, rise rose risen, run ran, say said, seek sought, sell sold, send sent, shine shone, sing sang sung, sit sat,
speak spoke spoken, spend spent, stand stood, swear swore sworn, swim swam swum, take took taken, teach taught, tear tore torn,
tell told, think thought, throw threw thrown, understand understood, visit visited visiting, wake woke woken, wear wore worn,
write wrote written
"""
IRREGULAR = {form: verb for verb, *forms in (line.split() for line in IRREGULAR_VERBS.split(",")) for form in forms}

#: What an ending becomes, the first that fits: a pattern of the whole word and the base form.
ENDINGS = [
    (r"^(.)ying$", "$1ie"),
    (r"^(.+y)ing$", "$1"),
    (r"^(.*([^aeiou]))\2ing$", "$1"),
    (r"^(.+[aeiou][vtczgs])ing$", "$1e"),
    (r"^(..+)ing$", "$1"),
    (r"^.?ing$|^.ed$|^.s$|ss$", "$0"),
    (r"^(..+)ied$", "$1y"),
    (r"^(.*([^aeiou]))\2ed$", "$1"),
    (r"^(.*(?:[aiou]s|[aiou]r|[aiu]g|[aiu]d|[aeiu]t|[aio]v|[ai]c|iz|in|[pbt]l|[rn][cs]|lv))ed$", "$1e"),
    (r"^(..+)ed$", "$1"),
    (r"^(..+)ies$", "$1y"),
    (r"^(.*(?:ch|sh|ss)|.+[xz])es$", "$1"),
    (r"^(..+)s$", "$1"),
]


def lemma(verb: Column) -> Column:
    """The base form of a verb in lower case without outer blanks: an irregular form by table, else by its ending."""
    word = F.lower(F.trim(verb))
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    base = word
    for pattern, to in reversed(ENDINGS):
        base = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, to) if to != "$0" else word).otherwise(base)
    return F.coalesce(F.element_at(table, word), base)


_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: What a due date looks like, in the order in which it is looked for.
DUE = [
    r"(?i)(tomorrow|today|tonight)",
    r"(?i)(next\s+\w+day)",
    r"(?i)(in\s+\d+\s+(?:hour|day|week)s?)",
    r"(?i)(by\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday))",
    r"(?i)(at\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?)",
]


def due_phrase(text: Column) -> Column:
    """The phrase of a due date in a text by the first pattern that finds one; null when none does."""
    more = [r"\b(\d{4}-\d{2}-\d{2})\b", r"(?i)\b(on\s+(?:" + "|".join(_DAYS) + r"))\b"]  # dates written out, and days
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in [*DUE, *more]])


def due_at(phrase: Column, now: Column) -> Column:
    """The instant a due phrase means, seen from ``now``: mornings at 9:00, tonight at 17:00; null when it means none."""
    phrase, day = F.lower(phrase), F.date_trunc("day", now)
    n = F.coalesce(F.nullif(F.regexp_extract(phrase, r"^in (\d+) ", 1), F.lit("")).cast("int"), F.lit(0))
    unit = F.regexp_extract(phrase, r"^in \d+ (hour|day|week)", 1)
    name = F.regexp_extract(phrase, r"(" + "|".join(_DAYS) + r")$", 1)
    on_day = F.coalesce(*[F.when(name == d, F.next_day(now.cast("date"), d[:3]).cast("timestamp")) for d in _DAYS])
    hours = lambda h: F.make_dt_interval(hours=h)
    return (
        F.when(phrase == "tomorrow", day + F.make_dt_interval(days=F.lit(1), hours=F.lit(9)))
        .when(phrase == "today", day + hours(F.lit(9)))
        .when(phrase == "tonight", day + hours(F.lit(17)))
        .when(unit == "hour", now + hours(n))
        .when(unit == "day", now + F.make_dt_interval(days=n))
        .when(unit == "week", now + F.make_dt_interval(days=n * 7))
        .when(name != "", on_day + hours(F.lit(9)))
        .when(phrase.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(phrase, F.lit("yyyy-MM-dd")) + hours(F.lit(9)))
    )


#: Names of priorities, dependencies, conflicts and severities; anything else is the last one.
PRIORITIES = {"high": ["high", "urgent", "critical", "important", "asap", "immediately"], "low": ["low", "eventually", "someday"], "medium": []}
DEPENDENCIES = {"blocking": ["blocking", "block", "must_complete", "hard"], "prerequisite": ["prerequisite", "prereq", "soft", "should_complete"], "related": []}
CONFLICTS = {"temporal": ["temporal", "time", "schedule", "overlap"], "resource": ["resource", "same_resource"], "priority": ["priority", "competing"], "logical": []}
SEVERITIES = {"critical": ["critical", "urgent", "blocking"], "high": ["high", "important"], "low": ["low", "minor"], "medium": []}


def one_of(text: Column, names: dict[str, list[str]]) -> Column:
    """The key under which a text is listed; the last key for anything else."""
    low, found = F.lower(F.trim(text)), F.lit(list(names)[-1])
    for key, words in reversed(list(names.items())[:-1]):
        found = F.when(low.isin(words), key).otherwise(found)
    return found


def priority(text: Column) -> Column:
    """high, medium or low; anything unknown is medium."""
    return one_of(text, PRIORITIES)


#: Predicates that deny each other.
ANTONYMS = [("employed", "unemployed"), ("active", "inactive"), ("alive", "dead"), ("married", "single"), ("open", "closed"), ("online", "offline"), ("enabled", "disabled")]
#: Fixed value: the pattern of a slot and its value.
SLOT = r"(?i)^\s*([A-Za-z][A-Za-z _-]{1,40}?)\s*(?::|is|=|—|-)\s*(.+)$"


def object_name(text: Column) -> Column:
    """Lower case with runs of blanks as one."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def slot_value(text: Column) -> Column:
    """A (slot, value) struct of ``slot: value``, ``slot is value`` and the like; null for anything else."""
    slot = F.regexp_replace(F.trim(F.lower(F.regexp_extract(text, SLOT, 1))), r"[\s_-]+", " ")
    value = F.trim(F.lower(F.regexp_extract(text, SLOT, 2)))
    return F.when((slot != "") & (value != ""), F.struct(slot.alias("slot"), value.alias("value")))


def antonyms(a: Column, b: Column) -> Column:
    """Whether two predicates deny each other."""
    pair = F.concat_ws("|", F.least(predicate_name(a), predicate_name(b)), F.greatest(predicate_name(a), predicate_name(b)))
    return pair.isin(["|".join(sorted(p)) for p in ANTONYMS])


def delimited(text: Column, tag: str, attributes: dict[str, Column] | None = None) -> Column:
    """``<tag len="n" name="value">text</tag>``: attributes escaped, the tag's own end inside the text broken."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i)</\\s*({tag[0]})({tag[1:]})\\s*>", "</$1\u200b$2>")
    held = F.concat(F.lit(' len="'), F.length(safe).cast("string"), F.lit('"'))
    for name, value in (attributes or {}).items():
        escaped = F.coalesce(value.cast("string"), F.lit(""))
        for mark, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
            escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
        held = F.concat(held, F.lit(f' {name}="'), escaped, F.lit('"'))
    return F.concat(F.lit(f"<{tag}"), held, F.lit(">"), safe, F.lit(f"</{tag}>"))


def cron(text: Column) -> Column:
    """The cron line of an interval that divides its unit; null for others."""
    s = interval_seconds(text)
    return (
        F.when((s >= 86400) & (s % 86400 == 0), F.format_string("0 0 */%d * *", ((s - s % 86400) / 86400).cast("int")))
        .when((s >= 3600) & (s % 3600 == 0), F.format_string("0 */%d * * *", ((s - s % 3600) / 3600).cast("int")))
        .when((s >= 60) & (s % 60 == 0), F.format_string("*/%d * * * *", ((s - s % 60) / 60).cast("int")))
    )
