"""Column rules of the normalise job and small scalar helpers. Each takes and returns Columns and gives NULL where nothing is found."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing words that do not tell one project from another, in the order they are tried.
ENTITY_NOISE = (
    r"\bco[- ]?op(?:erative)?\s*housing\s*society\b\.?",
    r"\bchs\b\.?",
    r"\bsociety\b\.?",
    r"\bapartments?\b\.?",
    r"\bphase\s*-?\s*(?:\d+|[ivx]+)\b\.?",
    r"\b(?:[a-z]|\d+)\s*wing\b\.?",
    r"\bwing\s*-?\s*(?:[a-z]|\d+)\b\.?",
)
# Country codes that count as a contact abroad.
COUNTRY_CODES = r"(\+1|\+44|\+971|\+61|\+65)[\s-]?\d"

# White space of every script, and the four separators of ASCII.
SPACE = r"(?U)[\s\x1C-\x1F]+"
# The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Half-up rounding in double arithmetic, for values from 0 up."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def filled(c: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(c, F.lit(""))


def first_text(*columns: Column) -> Column:
    return F.coalesce(*map(filled, columns))


def price_inr(c: Column) -> Column:
    # Fixed value: how prices are written.
    pattern = r"(?i)([\d.]+)\s*(Lac|Cr)"
    unit = F.when(F.lower(found(c, pattern, 2)) == "cr", 1e7).otherwise(1e5)
    return F.floor(found(c, pattern).try_cast("double") * unit + 0.5).cast("long")


def area_sqft(c: Column) -> Column:
    # Fixed value: how areas are written.
    return F.replace(found(c, r"(?i)([\d,]+)\s*sqft"), F.lit(",")).try_cast("long")


def bhk(c: Column) -> Column:
    # Fixed value: how room counts are written.
    return found(c, r"(?i)(\d+)\s*BHK").try_cast("int")


def role(c: Column) -> Column:
    prefix = F.lower(stripped(F.substring_index(c, ":", 1)))
    return F.when(prefix == "owner", "owner").when(prefix.isin("dealer", "agent", "builder"), "agent").otherwise("unknown")


def mentions(c: Column, word: str) -> Column:
    return F.coalesce(F.lower(c).contains(word), F.lit(False))


def days_since(c: Column, as_of: Column) -> Column:
    """Age in days from 'today', 'yesterday', 'N hours / days / weeks / months ago' or a date like ``May 07, '26``, in that order."""
    text = F.lower(F.trim(c))
    # The patterns run only on texts that hold their unit.
    n = lambda unit: F.when(text.contains(unit), found(text, rf"(\d+)\s*{unit}").try_cast("decimal(30,0)"))
    # Fixed value: how absolute dates are written.
    date = r"([A-Za-z]{3})\s+(\d{1,2}),?\s*'?(\d{2,4})"

    def absolute(parts: Column) -> Column:
        year = parts[2]
        posted = F.concat_ws(" ", parts[0], parts[1], F.when(F.length(year) == 4, year).otherwise((year.cast("int") + 2000).cast("string")))
        age = F.date_diff(as_of, F.try_to_date(posted, "MMM d yyyy"))
        return F.when(age >= 0, age).when(age < 0, 0)

    # The parts of a date are taken out once, as one text.
    parts = F.split(F.regexp_replace(F.regexp_substr(c, F.lit(date)), date, "$1 $2 $3"), " ")
    dated = F.transform(F.array(parts), lambda p: F.when(p.isNotNull(), absolute(p)))[0]
    return (
        F.when(text.contains("today"), 0)
        .when(text.contains("yesterday"), 1)
        .when(text.contains("hour") & found(text, r"(\d+)\s*hour").isNotNull(), 0)
        .otherwise(F.coalesce(n("day"), n("week") * 7, n("month") * 30, dated).try_cast("int"))
    )


def possession_status(c: Column) -> Column:
    text = F.lower(c)
    return F.when(text.contains("ready"), "ready_to_move").when(text.contains("under construction"), "under_construction").otherwise("unknown")


def intl_contact_hint(*texts: Column) -> Column:
    return F.concat_ws(" ", *texts).rlike(COUNTRY_CODES)


def poster_name(c: Column) -> Column:
    """The text after the first colon."""
    colon = F.instr(c, ":")
    return filled(stripped(F.when(colon > 0, F.substr(c, colon + 1))))


def stripped(c: Column) -> Column:
    """Without white space at both ends, a space or not."""
    return F.btrim(c, F.lit(SPACES))


def name_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, SPACE, " ")))


def entity_key(c: Column, patterns: Sequence[str] = ENTITY_NOISE) -> Column:
    """The name key without trailing noise words, stripped in sweeps until one changes nothing; it never becomes empty, because a character before the noise is kept."""

    def sweep(x: Column) -> Column:
        return reduce(lambda y, pattern: F.regexp_replace(y, rf"^(.*?\S)\s*(?:{pattern})$", "$1"), patterns, x)

    def step(a: Column, _: Column) -> Column:
        swept = F.transform(F.array(sweep(a["name"])), lambda y: F.struct(y.alias("name"), (y == a["name"]).alias("stable")))
        return F.when(a["stable"], a).otherwise(swept[0])

    def to_the_end(x: Column) -> Column:
        # A sweep that changes a name takes three characters or more.
        sweeps = F.sequence(F.lit(0), F.floor(F.length(x) / 3).cast("int"))
        return F.aggregate(sweeps, F.struct(x.alias("name"), F.lit(False).alias("stable")), step, lambda a: a["name"])

    noisy = lambda x: x.rlike(rf"(?:{'|'.join(patterns)})$")
    # Most names end in no noise word and take no sweep, and of the others most are done after one.
    once = F.transform(F.array(sweep(c)), lambda y: F.when(noisy(y), to_the_end(y)).otherwise(y))[0]
    return F.when(noisy(c), once).otherwise(c)


def slug(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))


def listing_url(base: str, area: Column, city: Column, page: Column) -> Column:
    url = F.concat(F.lit(base), slug(area), F.lit("-"), slug(city))
    return F.when(page == 1, url).otherwise(F.concat(url, F.lit("/page-"), page.cast("string")))


def name_from_url(url: Column, city: Column, areas: Column) -> Column:
    """A title-cased name from a link's last segment, without the id, the city and the longest of the area suffixes.

    Links without a scheme are taken as well, those with another one than http or https are not.
    """
    segment = F.regexp_extract(url, r"[^/]*$", 0)
    last = F.regexp_replace(segment, r"(?i)-pdpid-[a-z0-9]+$", "")
    no_city = F.when(F.endswith(last, F.concat(F.lit("-"), city)), F.left(last, F.length(last) - F.length(city) - 1)).otherwise(last)
    fits = F.filter(areas, lambda a: F.endswith(no_city, F.concat(F.lit("-"), a)))
    longest = F.coalesce(F.array_max(F.transform(fits, lambda a: F.length(a))) + 1, F.lit(0))
    name = F.btrim(F.left(no_city, F.length(no_city) - longest), F.lit("-"))
    foreign = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~url.rlike("(?i)^https?:")
    usable = url.contains("/") & segment.contains("-") & ~foreign
    return F.when(usable, filled(F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))))


def strip_tokens(c: Column, tokens: Sequence[str] | Column) -> Column:
    """Lower-cased text without any of the tokens, taken out one after another."""
    text = F.lower(F.coalesce(c, F.lit("")))
    if isinstance(tokens, Column):
        return F.aggregate(tokens, text, lambda t, x: F.replace(t, F.lower(x), F.lit("")))
    return reduce(lambda t, x: F.replace(t, F.lit(x.lower()), F.lit("")), tokens, text)


def significant_words(c: Column, stopwords: Sequence[str]) -> Column:
    """Distinct words of three letters or more that are no stopwords; all words if none is left."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    strong = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(stopwords)))
    return F.array_distinct(F.when(F.size(strong) > 0, strong).otherwise(words))


def any_keyword(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (mentions(c, w) for w in words))


def matched_keywords(c: Column, words: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))


def lead_tier(score: Column) -> Column:
    return F.when(score >= 60, "hot").when(score >= 30, "warm").otherwise("cold")


def sample_confidence(n: Column) -> Column:
    return F.when(n < 3, "low").when(n < 10, "medium").otherwise("high")


def display_score(c: Column) -> Column:
    return round_half_up(c * 10, 1)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, 0 where either text is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longer), F.lit(0.0))
