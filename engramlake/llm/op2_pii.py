"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score.

Every kind is found in one row with built-in functions: splitting a text by a pattern gives the
stretches between its leftmost non-overlapping matches, extracting gives the matches, and running
lengths of both give positions in code points. Possessive quantifiers and look-behind keep the
patterns linear on long runs of matching characters; they find the same spans as the plain forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, sums_before, table

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern(lengths: dict[int, str]) -> str:
    """As many characters as a country's IBANs have, whole or in groups of four; what follows is no part of it."""
    groups = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    each = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{groups(n)}" for n, c in lengths.items())
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{each})(?![A-Za-z0-9])"


#: kind: (pattern, what a text must contain for the pattern to be worth running, context words)
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|reply|from"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|host|server|address|login"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+", None, "card|visa|master|credit|payment"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", "tel|phone|call|mobile|fax"),
    "iban": (iban_pattern(IBAN_LENGTHS), None, "iban|bank|account|konto|transfer"),
}
BASE = ("email", "ip", "card", "phone")
#: The score of a confirmed span, without and with a context word in the CONTEXT characters before it.
PLAIN, NEAR, CONTEXT = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}, 0.15, 40


def luhn(digits: Column) -> Column:
    """The Luhn test of a string of digits: every second digit from the right is doubled, less 9 if above 9."""
    right = F.reverse(F.split(digits, ""))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(right, lambda d, i: F.when(i % 2 == 1, double(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda acc, v: acc + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """The mod-97 test: the first four characters go to the end, letters become 10 to 35, the rest is 1."""
    turned = F.split(F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4)), "")
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    step = lambda acc, v: F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97
    return F.aggregate(F.transform(turned, value), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return {
        "email": F.lit(True),
        "ip": m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"),
        "card": F.when(n.between(16, 19), luhn(F.regexp_replace(m, "[^0-9]", ""))).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
        "iban": mod97(F.replace(m, F.lit(" "), F.lit(""))),
    }[kind]


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def with_spans(rows: DataFrame, kind: str) -> DataFrame:
    """rows (with text) and a column named by the kind: its confirmed spans in the text, by start; code points, end exclusive.

    Matches and the stretches between them are found once each; nothing after that looks at the text, so
    the time is that of the text and its matches, however many they are.
    """
    pattern, need, words = KINDS[kind]
    text, none = F.col("text"), F.array().cast("array<string>")
    may = (F.contains(text, F.lit(need)) & text.rlike(pattern)) if need else text.rlike(pattern)
    out = once(rows, _may=may)
    out = once(out, _found=F.when(F.col("_may"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), _gaps=F.when(F.col("_may"), F.split(text, pattern, -1)).otherwise(none))
    out = once(out, _pairs=F.zip_with("_found", F.slice("_gaps", 1, F.size("_found")), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.lower(F.right(gap, F.lit(CONTEXT))).alias("before"))))
    out = once(out, _sizes=F.transform("_pairs", lambda x: x["gap"] + F.length(x["m"])))
    out = once(out, _before=sums_before("_sizes"))

    def span(x: Column, before: Column) -> Column:
        start = (before + x["gap"]).cast("int")
        score = F.lit(PLAIN[kind]) + F.when(x["before"].rlike(rf"\b(?:{words})"), F.lit(NEAR)).otherwise(F.lit(0.0))
        return F.when(_confirmed(kind, x["m"]), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), score.alias("score")))

    spans = F.filter(F.zip_with("_pairs", "_before", span), lambda x: x.isNotNull())
    return out.select(*rows.columns, spans.cast(SPAN).alias(kind))


def find_pii(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Every row of docs as struct ``row``, and for each kind its spans in a column of that name.

    A null or empty text has no spans. Rows are independent, so repeated rows repeat and nothing is shuffled;
    an empty table gives no rows. A very long text is searched whole, in time that grows with it and its matches.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for k in kinds:
        rows = with_spans(rows, k)
    return rows.select("row", *kinds)


def joined(*kinds: str) -> Column:
    """kind:start:end of these columns' spans, comma-joined."""
    return F.array_join(F.transform(reduce(F.concat, [F.col(k) for k in kinds]) if len(kinds) > 1 else F.col(kinds[0]), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = once(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")), _base=joined(*BASE))
    return out.select(
        "row.doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2("_base", 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.concat(*KINDS), lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sql() -> str:
    """The base kinds by their plain patterns; IBANs from runs of letters and digits that add up to a country's length and pass mod-97."""
    digits, bare = "regexp_replace(m, '[^0-9]', '', 'g')", "replace(m, ' ', '')"
    value = "(CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN (CASE WHEN substr({digits}, i, 1)::INT > 4 THEN 2 * substr({digits}, i, 1)::INT - 9 ELSE 2 * substr({digits}, i, 1)::INT END) ELSE substr({digits}, i, 1)::INT END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: {value}::BIGINT)), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1",
    }
    score = lambda k: f"{PLAIN[k]}::DOUBLE + CASE WHEN regexp_matches(lower(right(gap, {CONTEXT})), '\\b(?:{KINDS[k][2]})') THEN {NEAR}::DOUBLE ELSE 0::DOUBLE END"
    parts = []
    for n, (k, p) in enumerate(_PLAIN.items()):
        parts.append(f"""
SELECT doc_id, {n} AS ord, '{k}' AS kind, start, start + length(m) AS stop, {score(k)} AS score FROM (
  SELECT doc_id, matches[i] AS m, gaps[i] AS gap, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(matches[1:i-1], lambda g: length(g))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS matches, string_split_regex(t, '{p}') AS gaps FROM t))
) WHERE {ok[k]}""")
    sizes = ", ".join(f"('{c}', {n})" for n, cs in IBAN_LENGTHS.items() for c in cs.split())
    parts.append(f"""
SELECT doc_id, {len(_PLAIN)} AS ord, 'iban' AS kind, start, start + length(m) AS stop, {score('iban')} AS score FROM (
  SELECT doc_id, m, start, substr(t, coalesce(lag(start + length(m)) OVER (PARTITION BY doc_id ORDER BY start), 0) + 1, start - coalesce(lag(start + length(m)) OVER (PARTITION BY doc_id ORDER BY start), 0)) AS gap FROM (
    SELECT doc_id, t, array_to_string(runs[k:k + 2 * more], '') AS m, length(array_to_string(runs[1:k - 1], '')) AS start, size
    FROM (SELECT doc_id, t, runs, k, unnest(range(0, 10)) AS more FROM (SELECT doc_id, t, runs, unnest(range(1, len(runs) + 1)) AS k FROM (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS runs FROM t WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}}'))) WHERE regexp_matches(runs[k], '^[A-Z]{{2}}[0-9]{{2}}'))
    JOIN (VALUES {sizes}) z(country, size) ON runs[k][1:2] = country WHERE k + 2 * more <= len(runs)
  ) WHERE regexp_full_match(m, '[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]{{4}})*( ?[A-Z0-9]{{1,3}})?') AND length({bare}) = size
) WHERE {ok['iban']}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)})
, g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in BASE)},
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (WHERE ord < 4) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans, max(score) AS max_score FROM s GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(max_score, 0)::DOUBLE AS max_score
FROM t LEFT JOIN g USING (doc_id)
"""


SQL = {"op2_pii": _sql()}
