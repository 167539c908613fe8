"""Column expressions of the scalar rules; built-in functions only, but for ``exact_round``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BAD, BOOST, DECAY, GOOD, INITIAL_WEIGHTS, PENALTY, TIERS, WEIGHT_HIGH, WEIGHT_LOW


def strip(c: Column) -> Column:
    """Without white space, Unicode's too, at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def half_up(c: Column, places: int = 4) -> Column:
    """Rounded by floor(x + 1/2) at so many decimal places: the same bits in every engine with IEEE doubles."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / F.lit(scale)


@F.pandas_udf(T.DoubleType())
def exact_round(x: pd.Series) -> pd.Series:
    """Rounded to 4 places as Python does, by the exact value of the double."""
    return x.map(lambda v: round(v, 4), na_action="ignore")


# --- keyword scores


def terms_of(query: str | None) -> list[str]:
    """The words of a literal query, lower-cased; repeated ones count as often."""
    return (query or "").lower().split()


def terms_column(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def hits(lowered: Column, terms: list[str]) -> Column:
    """How many of these literal terms are substrings; unrolled, so that it stays in generated code."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(t)).cast("int") for t in terms], F.lit(0))


def hits_column(lowered: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(lowered, t)))


_OFFSET = r"[T ][0-9]{2}:.*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def instant(ts: Column) -> Column:
    """The instant of an ISO time with an offset; null for any other text."""
    parsed = F.try_to_timestamp(F.regexp_replace(ts, "Z$", "+00:00"))
    return F.when(ts.rlike(_OFFSET), parsed)


def normal_time(ts: Column) -> Column:
    """Offset times of other forms (basic format, minutes, hour-only offsets) in the form that ``instant`` reads; the rest as it is."""
    t = F.regexp_replace(ts, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?", "$1-$2-$3T$4:$5:$6")
    t = F.regexp_replace(t, r"(T\d{2}:\d{2}):?(Z|[+-]\d{2}(?::?\d{2})?)$", "$1:00$2")
    return F.regexp_replace(t, r"(T[\d:.]+[+-]\d{2})$", "$1:00")


def age_days(ts: Column, now: Column) -> Column:
    """Whole days of 24 hours from an offset time until now, 0 if later; null without an offset."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(instant(ts))) / F.lit(86400e6)))


def recency(ts: Column, now: Column) -> Column:
    """DECAY to the power of the age in days; 1 for a time that is missing, without an offset or not a time."""
    return F.coalesce(F.pow(F.lit(DECAY), age_days(ts, now)), F.lit(1.0))


# --- weights and routing


def clamp(w: Column) -> Column:
    return F.greatest(F.lit(WEIGHT_LOW), F.least(F.lit(WEIGHT_HIGH), w))


def lookup(table: dict, key: Column) -> Column:
    """The value of a key in a constant map; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def initial_weight(explicit: Column, entry_type: Column) -> Column:
    """The given weight, else that of the entry type, else 1; within bounds."""
    return clamp(F.coalesce(explicit, lookup(INITIAL_WEIGHTS, entry_type), F.lit(1.0)))


def route(tier: Column, entry_type: Column) -> Column:
    """The file of an entry: its type's, or the tier's first for an unknown type; null for an unknown tier."""
    known = {f"{t}/{k}": f for t, files in TIERS.items() for k, f in files.items()}
    return F.coalesce(lookup(known, F.concat(tier, F.lit("/"), entry_type)), lookup({t: next(iter(files.values())) for t, files in TIERS.items()}, tier))


def file_order(file: Column) -> Column:
    return lookup({f: i for i, f in enumerate(f for files in TIERS.values() for f in files.values())}, file)


def detect_type(tier: Column, keys: Column) -> Column:
    """The entry type that a payload's keys show."""
    has = lambda k: F.array_contains(keys, k)
    return F.when((tier == "episodic") & has("type"), "experience").when((tier == "semantic") & has("subject"), "fact").when((tier == "procedural") & has("skill_name"), "skill").otherwise("unknown")


def reinforce(w: Column, task_score: Column, exact: bool = False) -> Column:
    """The weight after one outcome: boosted above GOOD, lessened below BAD, else decayed; clamped and rounded to 4 places."""
    new = clamp(w * F.when(task_score > GOOD, F.lit(BOOST)).when(task_score < BAD, F.lit(PENALTY)).otherwise(F.lit(DECAY)))
    return exact_round(new) if exact else half_up(new)


def reinforce_all(w: Column, ordered_scores: Column) -> Column:
    """The weight after outcomes in this order."""
    return F.aggregate(ordered_scores, w.cast("double"), lambda acc, s: reinforce(acc, s))


# --- documents


def tokens(text: Column) -> Column:
    """An estimate: a token for every four code points."""
    return F.floor(F.length(text) / 4).cast("int")


def unthink(text: Column) -> Column:
    """Without <think> parts, stripped."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def parent_path(path: Column) -> Column:
    p = F.regexp_replace(F.rtrim(path, F.lit("/")), r"/?[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def depth(path: Column) -> Column:
    p = F.btrim(path, F.lit("/"))
    return (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("int")


def safe_title(title: Column) -> Column:
    return F.substring(F.regexp_replace(title, r"(?U)[^\w\-.]", "_"), 1, 80)


def l2_path(path: Column, title: Column) -> Column:
    """The key of a full text: hierarchy and safe title. Documents of equal path and title share it."""
    p = F.btrim(path, F.lit("/"))
    return F.concat(F.when(p == "", "").otherwise(F.concat(p, F.lit("/"))), safe_title(title), F.lit(".md"))


def fallback_abstract(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit(": "), F.substring(strip(F.translate(F.substring(text, 1, 2000), "\n", " ")), 1, 300))


def extract(title: Column, text: Column, sentences: int = 3) -> Column:
    """An overview without a model: the title, then each Markdown heading of the text with the first sentences below it; without headings the text's first sentences."""
    first = lambda part: F.regexp_extract(strip(part), rf"(?s)(?:[^.!?]+(?:[.!?]+|$)){{1,{sentences}}}", 0)
    head = lambda part: strip(F.substring_index(part, "\n", 1))
    body = lambda part: F.substr(part, F.length(F.substring_index(part, "\n", 1)) + 2)
    parts = F.split(F.concat(F.lit("\n"), text), r"\n#{1,6} ", -1)
    below = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: strip(F.concat(F.lit("## "), head(p), F.lit("\n"), first(body(p)))))
    return strip(F.array_join(F.concat(F.array(F.concat(F.lit("# "), title)), F.filter(F.array(first(F.get(parts, F.lit(0)))), lambda x: x != ""), below), "\n\n"))


def word_count(text: Column) -> Column:
    return F.size(terms_column(text))


def title_case(stem: Column) -> Column:
    """A file stem as a title: ``_`` and ``-`` become spaces and each run of letters is capitalised."""
    words = F.regexp_extract_all(F.translate(stem, "_-", "  "), F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def clip(text: Column, n: int, mark: str = "...") -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, mark).otherwise(""))


def headline(text: Column) -> Column:
    return F.translate(F.substring(text, 1, 120), "\n", " ")


def reduction_percent(l0: Column, l1: Column, l2: Column) -> Column:
    return (1 - (l0 + l1) / F.greatest(l2, F.lit(1))) * 100


def label(title: Column, skill_name: Column, subject: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(skill_name, F.lit("")), subject, F.lit("untitled"))


def tags_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def by_presence(first: Column, second: Column, key: str, default: Column, kind: str = "string") -> Column:
    """A key of the first JSON object if it is there, null too, else of the second, else the default."""
    path = lambda c: F.try_variant_get(F.try_parse_json(c), f"$.{key}", kind)
    has = lambda c: F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))
    return F.when(has(first), path(first)).when(has(second), path(second)).otherwise(default)


# --- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 less the cosine distance, 0 at least and for a vector of zeros; norms may be given."""
    return F.greatest(F.lit(0.0), F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)))
