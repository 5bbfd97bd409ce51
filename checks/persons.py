"""Person names: splitting, compatibility, linking, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Check, table
from clinspark.functions import names
from clinspark.operators import persons

GIVEN = ("Jan", "Johan", "J.", "Anna", "A.M.", "Marie Anne", "", "anna", "J. P.", "M.", "Jan Pieter", "Piet", "E.")
SURNAMES = ("Jansen", "de Vries", "van der Berg", "Smit", "JANSEN")


def people(spark, folder):
    """A person per customer: given names by key, surnames that a block of 40 customers shares, so the
    number of surnames grows with the table; every nation is a scope."""
    key = F.col("c_custkey")
    given = F.get(F.array(*map(F.lit, GIVEN)), (key % len(GIVEN)).cast("int"))
    surname = F.get(F.array(*map(F.lit, SURNAMES)), (F.floor(key / 7) % len(SURNAMES)).cast("int"))
    family = F.concat(surname, F.lit("-"), F.floor(key / 40).cast("string"))
    return table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("scope"),
        F.trim(F.concat_ws(" ", given, family)).alias("entity"),
        F.when(key % 17 == 0, "LOCATION").otherwise("PERSON").alias("type"),
        F.concat(F.lit("[PERSON_"), F.floor(key / 2).cast("string"), F.lit("]")).alias("replacement"),
        key.alias("seq"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


PEOPLE_CTE = f"""people AS (SELECT c_mktsegment AS scope, trim(concat_ws(' ', ({_sql_list(GIVEN)})[c_custkey % {len(GIVEN)} + 1],
   ({_sql_list(SURNAMES)})[c_custkey // 7 % {len(SURNAMES)} + 1] || '-' || (c_custkey // 40))) AS entity,
  CASE WHEN c_custkey % 17 = 0 THEN 'LOCATION' ELSE 'PERSON' END AS type, '[PERSON_' || (c_custkey // 2) || ']' AS replacement, c_custkey AS seq FROM customer),
tok AS (SELECT *, list_filter(regexp_split_to_array(entity, '\\s+'), lambda x: x <> '') AS t FROM people),
cut AS (SELECT *, coalesce(list_min(list_filter(range(1, len(t)), lambda i: lower(t[i]) IN ('van', 'de', 'der', 'den', 'ter', 'ten', 'op', 'in', 'het'))), len(t)) AS c FROM tok),
parts AS (SELECT *, t[1:c - 1] AS given, array_to_string(t[c:], ' ') AS surname FROM cut)"""


def split_names(spark, folder):
    parts = people(spark, folder).select("seq", names.split_name("entity").alias("n"))
    return parts.select("seq", F.array_join("n.given", "|").alias("given"), F.col("n.surname").alias("surname"))


SPLIT_SQL = f"WITH {PEOPLE_CTE} SELECT seq, array_to_string(given, '|') AS given, surname FROM parts"

_PAIR = """len(list_filter(range(1, least(len(a.given), len(b.given)) + 1), lambda i: NOT CASE
  WHEN regexp_matches(a.given[i], '^[A-Z](\\.|$)') OR regexp_matches(b.given[i], '^[A-Z](\\.|$)')
  THEN lower(substr(regexp_replace(a.given[i], '[^A-Za-z]', '', 'g'), 1, 1)) = lower(substr(regexp_replace(b.given[i], '[^A-Za-z]', '', 'g'), 1, 1))
  ELSE lower(a.given[i]) = lower(b.given[i]) END)) = 0"""


def compatible_neighbours(spark, folder):
    """Whether each person may be the same as the person seven keys later."""
    base = people(spark, folder).select("seq", names.split_name("entity").alias("n"))
    later = base.select((F.col("seq") - 7).alias("seq"), F.col("n").alias("m"))
    return base.join(later, "seq").select("seq", names.names_compatible(F.col("n"), F.col("m")).alias("same"))


COMPATIBLE_SQL = f"""
WITH {PEOPLE_CTE} SELECT a.seq, lower(a.surname) = lower(b.surname) AND {_PAIR} AS same FROM parts a JOIN parts b ON b.seq = a.seq + 7"""

def _component_cte(also: str = "") -> str:
    return f"""{PEOPLE_CTE},
p AS (SELECT *, lower(surname) AS s FROM parts WHERE type = 'PERSON' AND surname <> ''),
links AS (SELECT a.scope, a.seq AS u, b.seq AS v FROM p a JOIN p b ON a.scope = b.scope AND a.s = b.s AND a.seq <> b.seq AND {_PAIR}{also}),
reach AS (SELECT scope, u, v FROM links UNION SELECT r.scope, r.u, l.v FROM reach r JOIN links l ON l.scope = r.scope AND l.u = r.v),
comp AS (SELECT scope, u AS node, least(u, min(v)) AS component FROM reach GROUP BY scope, u)"""


COMPONENT_CTE = _component_cte()
STRICT_CTE = _component_cte(" AND (len(a.given) = 0) = (len(b.given) = 0)")


def person_components(spark, folder):
    everyone = people(spark, folder).filter("type = 'PERSON'")
    return persons.connected_components(persons.namesake_links(everyone, ["scope"]), ["scope"])


COMPONENTS_SQL = f"WITH RECURSIVE {COMPONENT_CTE} SELECT * FROM comp"


def resolve_persons(spark, folder):
    resolved, _ = persons.resolve_persons(people(spark, folder), ["scope"])
    return resolved


def merged_persons(spark, folder):
    _, merged = persons.resolve_persons(people(spark, folder), ["scope"])
    return merged


def resolve_persons_strict(spark, folder):
    """Bare surnames stay apart from full names."""
    resolved, _ = persons.resolve_persons(people(spark, folder), ["scope"], strict=True)
    return resolved


def _resolve_cte(links: str) -> str:
    return f"""{links},
m AS (SELECT c.scope, component, count(*) AS n, count(DISTINCT replacement) AS reps,
  first(replacement ORDER BY len(t) DESC, length(entity) DESC, seq) AS anchor
  FROM comp c JOIN parts ON parts.scope = c.scope AND parts.seq = c.node GROUP BY c.scope, component)"""


def _resolve_sql(links: str) -> str:
    return f"""
WITH RECURSIVE {_resolve_cte(links)} SELECT p.scope, p.entity, p.type, p.seq, coalesce(anchor, p.replacement) AS replacement
FROM people p LEFT JOIN comp c ON c.scope = p.scope AND c.node = p.seq LEFT JOIN m ON m.scope = p.scope AND m.component = c.component AND reps > 1"""


RESOLVE_SQL, RESOLVE_STRICT_SQL = _resolve_sql(COMPONENT_CTE), _resolve_sql(STRICT_CTE)
MERGED_SQL = f"WITH RECURSIVE {_resolve_cte(COMPONENT_CTE)} SELECT scope, CAST(sum(n - 1) AS BIGINT) AS merged FROM m WHERE reps > 1 GROUP BY scope"

CHECKS = {
    "split_name": Check(split_names, SPLIT_SQL),
    "names_compatible": Check(compatible_neighbours, COMPATIBLE_SQL),
    "namesake_components": Check(person_components, COMPONENTS_SQL),
    "resolve_persons": Check(resolve_persons, RESOLVE_SQL),
    "resolve_persons_strict": Check(resolve_persons_strict, RESOLVE_STRICT_SQL),
    "merged_persons": Check(merged_persons, MERGED_SQL),
}
