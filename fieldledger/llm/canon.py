"""Mapping freely typed values to a list of canonical entries, in SQL only.

Pigeonhole join: each reference string is cut into k + 1 segments; k edits cannot touch all of
them, so a typed string within k edits holds at least one segment, at a position shifted by no
more than the edits before and after it allow. Equality on (length, segment number, segment
text) finds the candidates, the built-in levenshtein with threshold k verifies them, and an
anti-join reports what matched nothing.

Typed values are first counted, so a value typed a million times is matched once. Ornaments
around a name (`County of`, `, VA`, `near`) and short forms of its words are fixed tables;
both sides are compared as lower-case letters only, so spaces, hyphens and dots don't count.

The longest allowed distance is k, and a third of the reference's length. Of several entries
the least (distance, wrong kind, entry id) wins. Null and blank values are no case; a value
with no letters matches nothing. Entries, and values without their ornaments, of fewer than three letters
match nothing, for at that length every edit names another place. Very long values only meet references of
their own length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import split_join
from ..session import cut

EDITS = 3

# fixed values: short forms of words in place names
SHORT_FORMS = {
    "court house": ["courthouse", "ch"], "heights": ["hts", "hgts"], "junction": ["jct", "jctn"], "mills": ["mls", "mill"], "grove": ["grv", "gr"],
    "springs": ["spgs", "spg", "sprgs"], "crossing": ["xing", "crsg"], "falls": ["fls"], "station": ["sta", "stn"], "corner": ["cor"], "landing": ["lndg", "ldg"],
    "village": ["vlg"], "point": ["pt"], "beach": ["bch"], "hill": ["hl"], "park": ["pk"], "lake": ["lk"], "valley": ["vly"],
    "north": ["n", "no"], "south": ["s", "so"], "east": ["e"], "west": ["w"], "fort": ["ft"], "saint": ["st"], "mount": ["mt"], "new": ["nw"], "port": ["pt"],
}
# fixed values: what stands before and after a name, as letters only; True marks a city
BEFORE = {"jurisdiction": {"countyof": False, "coof": False, "cityof": True}, "city": {"townof": False, "cityof": False, "near": False, "nr": False}}
AFTER = {
    "jurisdiction": {"county": False, "co": False, "cnty": False, "countypart": False, "va": False, "countyva": False, "cityof": True, "indcity": True, "city": True, "cit": True},
    "city": {"area": False, "outside": False, "va": False, "town": False, "city": False},
}


def _ornaments(table: dict[str, dict[str, bool]]) -> str:
    return "map(" + ", ".join(f"'{f}', array({', '.join(f"struct('{w}' AS w, {str(c).lower()} AS city)" for w, c in {'': False, **ws}.items())})" for f, ws in table.items()) + ")"


def _spellings(n: str, first: bool) -> str:
    """SQL: the spellings of lower-case `n`, each short form put in place of its first, or of its last word."""
    pairs = [(w, s) for w, ss in SHORT_FORMS.items() for s in ss]
    if first:
        put = [f"CASE WHEN {n} LIKE '{w} %' THEN concat('{s} ', substring({n}, {len(w) + 2})) END" for w, s in pairs]
    else:
        put = [f"CASE WHEN {n} LIKE '% {w}' THEN concat(left({n}, length({n}) - {len(w)}), '{s}') END" for w, s in pairs]
    return f"array_compact(array({n}, " + ", ".join(put) + "))"


MATCH = """
WITH entry AS (
  SELECT field, ref_id, is_city, lower(name) AS name FROM {refs} WHERE name IS NOT NULL
), spelled AS (
  SELECT DISTINCT field, ref_id, is_city, regexp_replace(s, '[^a-z]', '') AS ref
  FROM (SELECT field, ref_id, is_city, said FROM entry LATERAL VIEW explode(FIRST_WORDS) x AS said) AS e
  LATERAL VIEW explode(LAST_WORDS) y AS s
), ref AS (SELECT *, length(ref) AS len FROM spelled WHERE length(ref) >= 3
), piece AS (
  SELECT field, ref_id, is_city, ref, len, i,
         substring(ref, cast(floor(i * len / (EDITS + 1)) AS int) + 1, cast(floor((i + 1) * len / (EDITS + 1)) - floor(i * len / (EDITS + 1)) AS int)) AS seg
  FROM ref LATERAL VIEW explode(sequence(0, EDITS)) p AS i
), squashed AS (SELECT field, value, regexp_replace(lower(value), '[^a-z]', '') AS s FROM {typed}
), led AS (
  SELECT field, value, b.city AS lead_city, substring(s, length(b.w) + 1) AS s FROM squashed
  LATERAL VIEW explode(filter(BEFORE[field], x -> startswith(s, x.w))) e AS b
), form AS (
  SELECT DISTINCT field, value, lead_city OR a.city AS says_city, left(s, length(s) - length(a.w)) AS form FROM led
  LATERAL VIEW explode(filter(AFTER[field], x -> endswith(s, x.w))) e AS a WHERE length(s) - length(a.w) >= 3
), probe AS (
  SELECT DISTINCT field, form, len, i,
         substring(form, cast(floor(i * len / (EDITS + 1)) AS int) + 1 + shift, cast(floor((i + 1) * len / (EDITS + 1)) - floor(i * len / (EDITS + 1)) AS int)) AS seg
  FROM (SELECT DISTINCT field, form, length(form) AS m FROM form)
  LATERAL VIEW explode(sequence(greatest(m - EDITS, 3), m + EDITS)) l AS len
  LATERAL VIEW explode(sequence(0, EDITS)) p AS i
  LATERAL VIEW explode(CASE WHEN greatest(-i, m - len - (EDITS - i)) <= least(i, m - len + (EDITS - i))
                            THEN sequence(greatest(-i, m - len - (EDITS - i)), least(i, m - len + (EDITS - i))) END) q AS shift
  WHERE cast(floor(i * len / (EDITS + 1)) AS int) + shift >= 0
), candidate AS (
  SELECT DISTINCT p.field, p.form, r.ref, r.ref_id, r.is_city FROM probe p JOIN piece r
  ON p.field = r.field AND p.len = r.len AND p.i = r.i AND p.seg = r.seg
), verified AS (
  SELECT field, form, ref_id, is_city, levenshtein(form, ref, EDITS) AS dist, length(ref) AS len FROM candidate
), close AS (SELECT * FROM verified WHERE dist >= 0 AND dist * 3 <= len
), best AS (
  SELECT f.field, f.value, min(struct(c.dist, f.says_city <> c.is_city AS wrong_kind, c.ref_id)) AS b
  FROM form f JOIN close c ON f.field = c.field AND f.form = c.form GROUP BY f.field, f.value
)
SELECT field, value, b.ref_id, b.dist FROM best
UNION ALL
SELECT t.field, t.value, NULL, NULL FROM {typed} t LEFT ANTI JOIN best ON t.field = best.field AND t.value = best.value
"""


def match_typed(typed: DataFrame, refs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(field, value, ref_id, dist) of each distinct typed (field, value); ref_id is null where nothing matches.

    `refs` has field, ref_id, name and is_city; of a city and another place of one name the
    other is meant, unless the value says it is a city.
    """
    sql = MATCH.replace("FIRST_WORDS", _spellings("name", True)).replace("LAST_WORDS", _spellings("said", False)).replace("BEFORE", _ornaments(BEFORE)).replace("AFTER", _ornaments(AFTER)).replace("EDITS", str(edits))
    return typed.sparkSession.sql(sql, typed=typed, refs=refs)


def map_values(rows: DataFrame, refs: DataFrame, literals: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, field, ref_id, dist) of each row of (id, field, value) whose value is not blank and no literal entry."""
    cases = rows.filter("id IS NOT NULL AND trim(value) <> ''").join(literals.select("field", "value").distinct(), ["field", "value"], "left_anti")
    counted = cut(cases.groupBy("field", "value").agg(F.count("*").alias("n")))
    found = cut(match_typed(counted.select("field", "value"), refs, edits))
    return split_join(cases, found.join(counted, ["field", "value"]), ["field", "value"], "n").select("id", "field", "ref_id", "dist")
