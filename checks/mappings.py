"""Minting, counters, edits, renumbering and table form of mappings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import Check, quoted, table
from checks.detections import WORDS_CTE, _words
from checks.texts import TYPE_SQL, TYPES, conversations
from clinspark.operators import mapping as mappings
from clinspark.operators.rewriting import longest_first
from clinspark.plans.anonymize import extend_mapping
from clinspark.sinks.mapping_files import mapping_documents


# --- minting -------------------------------------------------------------------------------------
def first_sightings(spark, folder):
    return mappings.first_sightings(_words(spark, folder), ["conv_id"], ["turn", "pos"])


FIRST_SQL = f"""
WITH {WORDS_CTE} SELECT conv_id, turn, pos, entity, type FROM words
QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity) ORDER BY turn, pos) = 1"""


def mint_per_conversation(spark, folder):
    minted = mappings.mint_replacements(
        first_sightings(spark, folder), ["conv_id"], ["turn", "pos"], small_scopes=True
    )
    return minted.select("conv_id", "entity", "type", "replacement")


MINT_SQL = f"""
WITH {WORDS_CTE}, f AS (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity) ORDER BY turn, pos) = 1)
SELECT conv_id, entity, type, '[' || type || '_' || row_number() OVER (PARTITION BY conv_id, type ORDER BY turn, pos) || ']' AS replacement FROM f"""


def mint_global(spark, folder):
    sightings = mappings.first_sightings(_words(spark, folder), [], ["conv_id", "turn", "pos"])
    minted = mappings.mint_replacements(sightings, [], ["conv_id", "turn", "pos"])
    return minted.select("entity", "type", "replacement")


MINT_GLOBAL_SQL = f"""
WITH {WORDS_CTE}, f AS (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY lower(entity) ORDER BY conv_id, turn, pos) = 1)
SELECT entity, type, '[' || type || '_' || row_number() OVER (PARTITION BY type ORDER BY conv_id, turn, pos) || ']' AS replacement FROM f"""


def _user_mapping(spark, folder):
    """The mapping after the user turns of every conversation."""
    words = _words(spark, folder).join(
        conversations(spark, folder).filter("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"]
    )
    return extend_mapping(words, ["conv_id"], ["turn", "pos"], small_scopes=True)


def extended_mapping(spark, folder):
    """Assistant turns extend the mapping of the user turns: old tags stay, numbers continue."""
    words = _words(spark, folder).join(
        conversations(spark, folder).filter("role <> 'user'").select("conv_id", "turn"), ["conv_id", "turn"]
    )
    known = _user_mapping(spark, folder)
    return extend_mapping(words, ["conv_id"], ["turn", "pos"], known, small_scopes=True)


USER_CTE = f"""{WORDS_CTE}, said AS (SELECT w.*, role = 'user' AS user_turn FROM words w JOIN conversations USING (conv_id, turn)),
u AS (SELECT * FROM said WHERE user_turn QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity) ORDER BY turn, pos) = 1),
um AS (SELECT conv_id, entity, type, row_number() OVER (PARTITION BY conv_id, type ORDER BY turn, pos) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS seq FROM u)"""
def renumber_global(spark, folder):
    """A shared mapping without numbers is numbered by the first places of its entities."""
    order = ["conv_id", "turn", "pos"]
    words = _words(spark, folder)
    known = mappings.first_sightings(words, [], order).select(
        "entity", "type", F.concat(F.lit("["), "type", F.lit("_"), F.lower("entity"), F.lit("]")).alias("replacement"),
        F.lit(0).cast("bigint").alias("seq"),
    )
    return mappings.renumber_shared(known, words, order).select("entity", "type", "replacement")


EXTENDED_CTE = f"""{USER_CTE},
a AS (SELECT * FROM said s WHERE NOT user_turn AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = s.conv_id AND lower(u.entity) = lower(s.entity))
  QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity) ORDER BY turn, pos) = 1),
am AS (SELECT conv_id, entity, type, row_number() OVER (PARTITION BY conv_id, type ORDER BY turn, pos)
    + coalesce((SELECT max(n) FROM um WHERE um.conv_id = a.conv_id AND um.type = a.type), 0) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) + coalesce((SELECT max(seq) FROM um WHERE um.conv_id = a.conv_id), 0) AS seq FROM a),
every AS (SELECT * FROM um UNION ALL SELECT * FROM am)"""
EXTENDED_SQL = f"""
WITH {EXTENDED_CTE} SELECT conv_id, entity, type, '[' || type || '_' || n || ']' AS replacement, CAST(seq AS BIGINT) AS seq FROM every"""


def new_entities(spark, folder):
    fresh = mappings.new_entities(_words(spark, folder), _user_mapping(spark, folder), ["conv_id"])
    return fresh.select("conv_id", "turn", "pos", "entity", "type")


NEW_SQL = f"""
WITH {USER_CTE} SELECT conv_id, turn, pos, entity, type FROM words w
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = w.conv_id AND lower(u.entity) = lower(w.entity))"""


def rebuild_counters(spark, folder):
    return mappings.rebuild_counters(extended_mapping(spark, folder), ["conv_id"])


COUNTERS_SQL = f"WITH {EXTENDED_CTE} SELECT conv_id, type, max(n) AS last_number FROM every GROUP BY ALL"


# --- table form ----------------------------------------------------------------------------------
def _customer_sheet(spark, folder):
    """A mapping sheet: two spellings of a customer map to one entity, some replacements are blank."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("row"),
        F.concat(F.lit(" "), F.substring_index("c_name", "#", 1), F.lit(" "), (key - key % 10 + key % 7).cast("string")).alias("Original text"),
        F.when(key % 11 == 0, F.lit("")).otherwise(F.lower("c_mktsegment")).alias("Entity Type"),
        F.when(key % 4 == 0, F.concat(F.lit("["), "c_mktsegment", F.lit("_"), (key % 20).cast("string"), F.lit("]"))).alias("Replace by"),
    )


def mapping_from_table(spark, folder):
    return mappings.mapping_from_table(_customer_sheet(spark, folder), "row")


SHEET_CTE = """sheet AS (SELECT c_custkey AS seq, 'Customer ' || (c_custkey - c_custkey % 10 + c_custkey % 7) AS entity,
  c_mktsegment AS type, CASE WHEN c_custkey % 4 = 0 THEN '[' || c_mktsegment || '_' || (c_custkey % 20) || ']' END AS given
  FROM customer WHERE c_custkey % 11 <> 0),
used AS (SELECT type, max(CAST(regexp_extract(given, '_([0-9]+)\\]$', 1) AS BIGINT)) AS last FROM sheet WHERE given IS NOT NULL GROUP BY type),
named AS (SELECT seq, entity, sheet.type, coalesce(given, '[' || sheet.type || '_' ||
  (row_number() OVER (PARTITION BY sheet.type, given IS NULL ORDER BY seq) + coalesce(last, 0)) || ']') AS replacement
  FROM sheet LEFT JOIN used ON used.type = sheet.type),
mapping AS (SELECT entity, arg_max(type, seq) AS type, arg_max(replacement, seq) AS replacement, min(seq) AS seq FROM named GROUP BY entity)"""
FROM_TABLE_SQL = f"WITH {SHEET_CTE} SELECT entity, type, replacement, seq FROM mapping"


def mapping_table(spark, folder):
    return mappings.mapping_table(mapping_from_table(spark, folder))


MAPPING_TABLE_SQL = f"""
WITH {SHEET_CTE} SELECT entity AS "Entity", type AS "Type", replacement AS "Replacement" FROM mapping ORDER BY 2, 1"""


def mapping_json(spark, folder):
    """JSON documents of at most 40 entities; reading them back gives the mapping."""
    parts = mapping_documents(mapping_from_table(spark, folder), [], 40)
    schema = "version int, entities map<string, struct<type:string, replacement:string>>, counters map<string, bigint>"
    read = parts.select("part", F.from_json("json", schema).alias("d"))
    return read.select("part", F.explode(F.map_entries("d.entities")).alias("e")).select(
        "part", F.col("e.key").alias("entity"), "e.value.type", "e.value.replacement"
    )


MAPPING_JSON_SQL = f"""
WITH {SHEET_CTE} SELECT CAST((row_number() OVER (ORDER BY seq) - 1) // 40 AS INTEGER) AS part, entity, type, replacement FROM mapping"""


def entity_inventory(spark, folder):
    return mappings.entity_inventory(mapping_from_table(spark, folder), [])


INVENTORY_SQL = f"""
WITH {SHEET_CTE} SELECT replacement, arg_min(type, seq) AS type, count(*) AS entities FROM mapping GROUP BY replacement"""


def longest_first_entries(spark, folder):
    entries = extended_mapping(spark, folder).groupBy("conv_id").agg(
        F.collect_list(F.struct("entity", "replacement", "seq")).alias("entries")
    )
    return entries.select(
        "conv_id", F.array_join(F.transform(longest_first(F.col("entries")), lambda e: e["entity"]), " ").alias("ordered")
    )


LONGEST_SQL = f"""
WITH {EXTENDED_CTE} SELECT conv_id, string_agg(entity, ' ' ORDER BY length(entity) DESC, seq) AS ordered FROM every GROUP BY conv_id"""


# --- edits ---------------------------------------------------------------------------------------
def _edits(spark, folder):
    """Edits of the customer mapping, one scope per nation, from orders in key order."""
    key = F.col("o_orderkey")
    op = F.get(F.array(*map(F.lit, ["add", "replace", "delete", "retype", "add", "replace", "add"])), (key % 7).cast("int"))
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").alias("scope"), key.alias("edit_no"),
            F.when(key % 1009 == 0, "clear").otherwise(op).alias("op"),
            F.when(key % 13 == 0, F.concat(F.lit("New "), (key % 50).cast("string"))).when(key % 17 == 0, "[AB_1]").when(key % 19 == 0, "x").otherwise(F.col("c_name")).alias("entity"),
            F.lower("o_orderpriority").alias("type"),
            F.when(key % 3 == 0, F.concat(F.lit("[TAG_"), (key % 40).cast("string"), F.lit("]"))).when(key % 3 == 1, F.concat(F.lit("[BUILDING_"), (key % 9).cast("string"), F.lit("]"))).alias("replacement"),
        )
    )


def _base_mapping(spark, folder):
    segment = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("scope"), F.col("c_name").alias("entity"), F.col("c_mktsegment").alias("type"),
        mappings.tag("c_mktsegment", F.row_number().over(segment)).alias("replacement"), F.col("c_custkey").alias("seq"),
    )


def edit_mapping(spark, folder):
    edited = mappings.edit_mapping(_base_mapping(spark, folder), _edits(spark, folder), ["scope"])
    return edited.drop("seq")


EDITS_CTE = """base AS (SELECT c_nationkey AS scope, c_name AS entity, c_mktsegment AS type, c_custkey AS seq,
  '[' || c_mktsegment || '_' || row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) || ']' AS replacement FROM customer),
raw AS (SELECT c_nationkey AS scope, o_orderkey AS no, CASE WHEN o_orderkey % 1009 = 0 THEN 'clear' ELSE
   (['add', 'replace', 'delete', 'retype', 'add', 'replace', 'add'])[o_orderkey % 7 + 1] END AS op,
  CASE WHEN o_orderkey % 13 = 0 THEN 'New ' || (o_orderkey % 50) WHEN o_orderkey % 17 = 0 THEN '[AB_1]' WHEN o_orderkey % 19 = 0 THEN 'x' ELSE c_name END AS entity,
  upper(o_orderpriority) AS type,
  CASE WHEN o_orderkey % 3 = 0 THEN '[TAG_' || (o_orderkey % 40) || ']' WHEN o_orderkey % 3 = 1 THEN '[BUILDING_' || (o_orderkey % 9) || ']' END AS replacement
  FROM orders JOIN customer ON o_custkey = c_custkey),
edits AS (SELECT * FROM raw WHERE op IN ('clear', 'delete', 'retype') OR (op = 'replace' AND replacement IS NOT NULL)
  OR (op = 'add' AND length(entity) >= 2 AND NOT regexp_matches(entity, '^\\[[A-Z]+_[0-9]+\\]$'))),
grp AS (SELECT scope, replacement, arg_min(type, seq) AS gtype FROM base GROUP BY ALL),
used AS (SELECT scope, type, max(CAST(regexp_extract(replacement, '_([0-9]+)\\]$', 1) AS BIGINT)) AS last FROM base GROUP BY ALL),
minted AS (SELECT e.scope, no, row_number() OVER (PARTITION BY e.scope, e.type ORDER BY no) + coalesce(last, 0) AS n
  FROM edits e LEFT JOIN used u ON u.scope = e.scope AND u.type = e.type WHERE op = 'add' AND e.replacement IS NULL),
full_edits AS (SELECT e.scope, e.no, e.op, e.entity, coalesce(CASE WHEN e.op IN ('add', 'replace') THEN gtype END, e.type) AS type,
   coalesce(e.replacement, '[' || e.type || '_' || n || ']') AS replacement, gtype IS NOT NULL AS aliased
  FROM edits e LEFT JOIN grp g ON g.scope = e.scope AND g.replacement = e.replacement LEFT JOIN minted m ON m.scope = e.scope AND m.no = e.no),
cleared AS (SELECT scope, max(no) AS c FROM full_edits WHERE op = 'clear' GROUP BY scope),
live AS (SELECT f.* FROM full_edits f LEFT JOIN cleared USING (scope) WHERE op <> 'clear' AND (c IS NULL OR no > c)),
del AS (SELECT scope, entity, max(no) AS d FROM live WHERE op = 'delete' GROUP BY ALL),
act AS (SELECT l.* FROM live l LEFT JOIN del ON del.scope = l.scope AND del.entity = l.entity WHERE op <> 'delete' AND (d IS NULL OR no > d)),
eff AS (SELECT scope, entity, min(no) FILTER (op = 'add') AS added, arg_max(replacement, no) FILTER (op IN ('add', 'replace')) AS r,
  arg_max(type, no) FILTER (op IN ('add', 'retype') OR (op = 'replace' AND aliased)) AS t FROM act GROUP BY ALL),
alive AS (SELECT b.* FROM base b WHERE NOT EXISTS (SELECT 1 FROM cleared c WHERE c.scope = b.scope)
  AND NOT EXISTS (SELECT 1 FROM del WHERE del.scope = b.scope AND del.entity = b.entity))"""
EDIT_SQL = f"""
WITH {EDITS_CTE} SELECT coalesce(a.scope, e.scope) AS scope, coalesce(a.entity, e.entity) AS entity,
  coalesce(e.t, a.type) AS type, coalesce(e.r, a.replacement) AS replacement
FROM alive a FULL JOIN eff e ON e.scope = a.scope AND e.entity = a.entity
WHERE a.replacement IS NOT NULL OR e.added IS NOT NULL"""


def alias_types(spark, folder):
    edits = _edits(spark, folder).select("scope", "edit_no", "type", "replacement").filter("replacement IS NOT NULL")
    return mappings.lookup_replacement_type(edits, _base_mapping(spark, folder), ["scope"])


ALIAS_SQL = f"""
WITH {EDITS_CTE} SELECT r.scope, r.no AS edit_no, coalesce(gtype, lower(r.type)) AS type, r.replacement
FROM raw r LEFT JOIN grp g ON g.scope = r.scope AND g.replacement = r.replacement WHERE r.replacement IS NOT NULL"""


def renumber(spark, folder):
    """Tags given in alphabetical order are renumbered by first occurrence; short words share tags."""
    scope = ["conv_id", "turn"]
    words = _words(spark, folder).select(*scope, "entity", "type").distinct()
    by_name = Window.partitionBy(*scope).orderBy("entity")
    made = words.withColumn("seq", F.row_number().over(by_name).cast("bigint")).withColumn(
        "replacement",
        F.when(F.length("entity") < 4, F.concat(F.lit("[SHORT_"), F.length("entity").cast("string"), F.lit("]"))).otherwise(mappings.tag("type", F.col("seq"))),
    )
    return mappings.renumber(made, conversations(spark, folder), scope)


RENUMBER_SQL = f"""
WITH {WORDS_CTE}, d AS (SELECT DISTINCT conv_id, turn, entity, type FROM words),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY entity) AS seq FROM d),
r AS (SELECT *, CASE WHEN length(entity) < 4 THEN '[SHORT_' || length(entity) || ']' ELSE '[' || type || '_' || seq || ']' END AS rep FROM m),
g AS (SELECT r.conv_id, r.turn, rep, arg_min(type, seq) AS type, min(seq) AS seq,
  min(CASE WHEN instr(text, entity) > 0 THEN instr(text, entity) ELSE 4611686018427387904 END) AS first_at
  FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn GROUP BY ALL),
n AS (SELECT conv_id, turn, rep, '[' || type || '_' || row_number() OVER (PARTITION BY conv_id, turn, type ORDER BY first_at, seq) || ']' AS new FROM g)
SELECT r.conv_id, r.turn, entity, type, CAST(seq AS BIGINT) AS seq, new AS replacement FROM r JOIN n USING (conv_id, turn, rep)"""

CHECKS = {
    "first_sightings": Check(first_sightings, FIRST_SQL),
    "mint_replacements": Check(mint_per_conversation, MINT_SQL),
    "mint_replacements_global": Check(mint_global, MINT_GLOBAL_SQL),
    "new_entities": Check(new_entities, NEW_SQL),
    "extend_mapping": Check(extended_mapping, EXTENDED_SQL),
    "renumber_global": Check(renumber_global, MINT_GLOBAL_SQL),
    "rebuild_counters": Check(rebuild_counters, COUNTERS_SQL),
    "mapping_from_table": Check(mapping_from_table, FROM_TABLE_SQL),
    "mapping_table": Check(mapping_table, MAPPING_TABLE_SQL),
    "mapping_json": Check(mapping_json, MAPPING_JSON_SQL),
    "entity_inventory": Check(entity_inventory, INVENTORY_SQL),
    "longest_first": Check(longest_first_entries, LONGEST_SQL),
    "edit_mapping": Check(edit_mapping, EDIT_SQL),
    "alias_types": Check(alias_types, ALIAS_SQL),
    "renumber_mapping": Check(renumber, RENUMBER_SQL),
}
