"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.bit_sliced_topk import top_k
from clinspark.llm.common import staged, table, utf8
from clinspark.llm.decontamination import contamination
from clinspark.llm.exact_dedup import exact_dedup
from clinspark.llm.fill_in_middle import fill_in_middle
from clinspark.llm.language_ppm import fit, held_out, predict
from clinspark.llm.license_scan import TEMPLATES, license_scan
from clinspark.llm.merkle_manifest import merkle_proofs
from clinspark.llm.mixing import mix_sources, word_count
from clinspark.llm.packing import pack_documents
from clinspark.llm.repeated_windows import remove_repeats
from clinspark.llm.sharding import shard_records
from clinspark.llm.simhash_tiles import simhash_groups
from clinspark.llm.warc_index import capture_histories

Query = Callable[[SparkSession, str], DataFrame]


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_quality``: 2 for documents labelled good, 0.5 for bad, 1 without a label."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("_label")
    )
    weight = F.when(F.col("_label") == 1, 2.0).when(F.col("_label") == 0, 0.5).otherwise(1.0)
    return docs.join(known, "doc_id", "left").withColumn("_quality", weight).drop("_label")


def op1_warc_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    # The table has no capture time: one second per page from the start of 2024.
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page_id", F.lit(100_000_000)))
    return capture_histories(pages, captured).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_bit_sliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup(docs, hash_all=True, with_text=False).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256")
    )


def op4_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def tokenizer_file(name: str) -> str:
    """Where an installed public tokenizer file is, on this machine as on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_pack_histogram(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    packed = pack_documents(docs, tokenizer_file("word_bpe_49k.json"), digest=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("size"))
    sized = staged(quality_weight(docs, table(spark, folder, "labels")), "mix-sizes")
    mixed = mix_sources(sized, F.col("_quality"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    data = utf8("text")
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    return shard_records(docs, order=["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents").select("doc_id", "text"))


def op9_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op10_simhash_tiles(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle_proofs(table(spark, folder, "documents"), tamper=tampered)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    moved = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"), with_text=False)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Query] = {
    "op1_warc_index_merge": op1_warc_index_merge,
    "op2_bit_sliced_topk": op2_bit_sliced_topk,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_repeated_windows": op4_repeated_windows,
    "op5_pack_histogram": op5_pack_histogram,
    "op6_mix_sources": op6_mix_sources,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_license_scan": op8_license_scan,
    "op9_language_ppm": op9_language_ppm,
    "op10_simhash_tiles": op10_simhash_tiles,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_decontamination": op13_decontamination,
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({n}, {_quoted(name)}, {_quoted(text)})" for n, (name, text) in enumerate(TEMPLATES))

# Four base-32 digits for each five hexadecimal ones.
_BASE32 = " || ".join(
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hash[{5 * at + 1}:{5 * at + 5}])::BIGINT >> {shift}) & 31) + 1]"
    for at in range(8)
    for shift in (15, 10, 5, 0)
)



def _leaf(text: str) -> str:
    """The SQL of a leaf whose text is the expression ``text``."""
    values = [f"{name}::VARCHAR" for name in ("doc_id", "source", "lang", "n_chars")] + [text]
    fields = (f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')" for value in values)
    return f"sha256({' || '.join(fields)})"


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# CRC-32 of decimal digits, bit by bit over the reversed polynomial.
_CRC32 = """xor(list_reduce(
    list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::BIGINT),
    lambda crc, byte: list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                                  xor(crc, byte)), 4294967295::BIGINT), 4294967295)"""


def _climb(name: str, leaves: str) -> str:
    """All levels over ``leaves`` (k, pos, digest, n): runs of 16 become one until one is left."""
    return f"""{name}(lvl, k, pos, digest, n) AS (
  SELECT 0, k, pos, digest, n FROM {leaves}
  UNION ALL
  SELECT lvl + 1, k, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY lvl, k, pos // 16, n
), {name}_runs AS (
  SELECT lvl, k, pos // 16 AS run, list(digest ORDER BY pos) AS members FROM {name} WHERE n > 1 GROUP BY ALL
)"""


def _fold(name: str, start: str, runs: str) -> str:
    """From each (key, k, pos, proof, digest) up over the runs: siblings collected, digest folded."""
    return f"""{name}(lvl, key, k, pos, proof, digest) AS (
  SELECT 0, key, k, pos, proof, digest FROM {start}
  UNION ALL
  SELECT f.lvl + 1, key, f.k, f.pos // 16,
         proof || array_to_string(members[:f.pos % 16] || members[f.pos % 16 + 2:], ''),
         sha256(array_to_string(members[:f.pos % 16] || [digest] || members[f.pos % 16 + 2:], ''))
  FROM {name} f JOIN {runs} r ON f.lvl = r.lvl AND f.k = r.k AND f.pos // 16 = r.run
), {name}_end AS (
  SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY key ORDER BY lvl DESC) = 1
)"""


ORACLES = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS k, row_number() OVER () AS key,
         {_leaf("text")} AS leaf,
         CASE WHEN {_CRC32.format("(doc_id::VARCHAR)")} % 5 = 0
              THEN {_leaf(f"translate(text, {_ALPHABET})")} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d
), start AS (SELECT k, pos, leaf AS digest, n FROM leaves
), {_climb("up", "start")}
, ends AS (
  SELECT k AS tree, digest FROM up WHERE n = 1
), tops AS (
  SELECT '' AS k, tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n FROM ends
), top_start AS (SELECT k, pos, digest, n FROM tops
), {_climb("over_all", "top_start")}
, low_start AS (SELECT key, k, pos, '' AS proof, coalesce(changed, leaf) AS digest FROM leaves
), {_fold("low", "low_start", "up_runs")}
, high_start AS (
  SELECT key, '' AS k, tops.pos, low_end.proof, low_end.digest FROM low_end JOIN tops ON tops.tree = low_end.k
), {_fold("high", "high_start", "over_all_runs")}
SELECT doc_id, leaf, ends.digest AS subroot, root.digest AS root, sha256(high_end.proof) AS proof_sha256,
       high_end.digest AS folded_root, high_end.digest = root.digest AS verified
FROM leaves JOIN ends ON ends.tree = leaves.k JOIN high_end USING (key) CROSS JOIN (SELECT digest FROM over_all WHERE n = 1) root
""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), cut AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:], '') AS s
  FROM cut
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM parts
), found AS (
  SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM made
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form
         WHEN 'plain' THEN output
         WHEN 'psm' THEN output[4:at_s - 1] || output[at_m + 3:] || output[at_s + 3:at_m - 1]
         ELSE output[at_p + 3:at_m - 1] || output[at_m + 3:] || output[4:at_p - 1] END) AS restored_sha256
FROM found
""",
    "op13_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS key, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), ALPHABET), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), ALPHABET), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT l FROM g
), places AS (
  SELECT key, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram
  FROM (SELECT key, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, sizes WHERE len(w) >= l)
), hits AS (
  SELECT key, places.l, i, item_id FROM places JOIN g USING (gram)
), counted AS (
  SELECT key, count(DISTINCT place) AS n_hit FROM (SELECT key, unnest(range(i, i + l)) AS place FROM hits) GROUP BY key
), listed AS (
  SELECT key, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hits GROUP BY key
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (key) LEFT JOIN listed USING (key)
""".replace("ALPHABET", _ALPHABET),
    "op1_warc_index_merge": f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hash
  FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hash) AS first FROM p
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
""",
    "op2_bit_sliced_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op8_license_scan": r"""
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, 0 AS line_no, text AS unit FROM parts WHERE len(lines) > 1
  UNION ALL
  SELECT doc_id, unnest(range(1, len(lines) + 1))::INT, unnest(lines) FROM parts
), t(template, license, unit) AS (VALUES """
    + _TEMPLATE_ROWS
    + r""")
, plain AS (
  SELECT doc_id, line_no, NULL::INT AS template, NULL AS license,
         string_split(trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM units
  UNION ALL
  SELECT NULL, NULL, template, license,
         string_split(trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') FROM t
), sized AS (
  SELECT *, greatest(len(w) - 1, 1) AS size FROM plain WHERE w[1] <> ''
), short AS (
  SELECT * FROM sized WHERE size <= 2 * (SELECT max(size) FROM sized WHERE template IS NOT NULL)
), pairs AS (
  SELECT doc_id, line_no, template, license, size,
         list_sort(CASE WHEN len(w) < 2 THEN w
                        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS p
  FROM short
), grams AS (
  SELECT doc_id, line_no, template, license, size,
         list_transform(range(1, len(p) + 1), lambda i: p[i] || '#' || (i + 1 - list_position(p, p[i]))) AS g
  FROM pairs
), scored AS (
  SELECT u.doc_id, u.line_no, t.template, t.license,
         2.0 * len(list_intersect(u.g, t.g)) / (u.size + t.size) AS dice
  FROM grams u JOIN grams t ON u.template IS NULL AND t.template IS NOT NULL AND u.size BETWEEN t.size / 2 AND t.size * 2
)
SELECT doc_id, line_no, template, license, dice FROM scored WHERE dice >= 0.9
""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""",
    "op4_repeated_windows": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, h[2 * s + 1:2 * s + 200] AS win FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)
), later AS (
  SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1
), edges AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM later
), runs AS (
  SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM edges
), spans AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY ALL
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(h[2 * a + 1:2 * b], '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
""",
    "op6_mix_sources": r"""
WITH RECURSIVE l AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1
), d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || md5(doc_id::VARCHAR)[1:12])::BIGINT + 0.5) / 281474976710656.0)
           / CASE l.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS draw
  FROM documents LEFT JOIN l USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), fill AS (
  -- each round hands the words that are still free to the sources that are not full yet
  SELECT 1 AS step, source, source_size, weight, 0.0::DOUBLE AS target, 1.5 * (SELECT sum(source_size) FROM s)::DOUBLE AS free
  FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight, target2, total - sum(target2) OVER ()
  FROM (
    SELECT step, source, source_size, weight, free + sum(target) OVER () AS total,
           CASE WHEN target >= 2.0 * source_size THEN target ELSE
             least(2.0 * source_size, target + free * weight
               / sum(CASE WHEN target < 2.0 * source_size THEN weight ELSE 0 END) OVER ()) END AS target2,
           free
    FROM fill) q
  WHERE step < 60 AND abs(free) > 1e-6
), t AS (
  SELECT source, source_size, arg_max(target, step) AS target FROM fill GROUP BY 1, 2
), e AS (
  SELECT doc_id, size, source_size, target, floor(target / source_size)::BIGINT AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id) - size / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
""",
}
