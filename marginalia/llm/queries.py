"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chat, decontam, jaccard, licences, linededup, merkle, mixing, pii, quality, secrets, shards, tokenalign, toxicity
from marginalia.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


LINKS_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM worded
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""


@_register("op1_ngram_jaccard", LINKS_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_classes(_table(spark, folder, "documents"))


@_register("op2_secret_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.BASE_KINDS],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"),
        secrets.credentials_text(F.col("credentials")).alias("credentials"),
    )


@_register("op3_chat_repair")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(_table(spark, folder, "conversations"))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         trim(u.line, E' \t\n\u000b\u000c\r') AS bare
  FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line, length(bare) AS n,
         translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE n >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key AND k.n >= 20
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_register("op4_line_dedup", LINES_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    done = linededup.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_register("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@_register("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_register("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@_register("op8_license_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "pages"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER w AS k,
         (sum(source_size) OVER ()) AS total,
         coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources WINDOW w AS (ORDER BY source_size * 3.0::DOUBLE / weight, source)
), share AS (
  SELECT (total - used)::DOUBLE / open AS share FROM filling WHERE cap > weight * ((total - used)::DOUBLE / open) ORDER BY k LIMIT 1
), goals AS (
  SELECT source, source_size, least(cap, weight * share) AS target,
         ('0x' || substr(md5('mix' || coalesce('/' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM filling, share
), placed AS (
  SELECT s.*, g.source_size, g.target, g.u, coalesce(g.target / nullif(g.source_size, 0)::DOUBLE, 0) AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS i
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copied AS (
  SELECT *, least(floor(rate) + floor(u + (i + 1) * (rate - floor(rate))) - floor(u + i * (rate - floor(rate))), 3)::BIGINT AS copies
  FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM copied
"""


@_register("op9_source_mixing", MIX_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_register("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_table(spark, folder, "documents").select("doc_id", "text"))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE_KINDS], F.size("pii").cast("long").alias("n_pii"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("pii")).alias("spans"),
    )


TOKENIZERS = "/opt/tokenizers"


@_register("op11_token_alignment")
def op11(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    vocabularies = tokenalign.Vocabularies.load(f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return tokenalign.align(_table(spark, folder, "documents"), vocabularies).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


MERKLE_SQL = r"""
WITH RECURSIVE spelled AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS bytes
  FROM documents
), sums AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))))) AS crc
  FROM spelled
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + changed AS VARCHAR)) || ':' || (n_chars + changed), '-') || tail) AS candidate
  FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN 1 ELSE 0 END AS changed FROM sums)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2
), tops AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM tops
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM upper WHERE n > 1 GROUP BY level, place // 2
), root AS (
  SELECT digest AS root, level AS height FROM upper WHERE n = 1
), folded AS (
  SELECT p.doc_id, p.lang, p.leaf, p.place AS start, p.place, 0 AS level, p.candidate AS node, '' AS proof, t.height, t.place AS top, t.subroot
  FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.start,
    CASE WHEN f.level + 1 = f.height THEN f.top ELSE f.place // 2 END, f.level + 1,
    sha256(CASE WHEN f.place % 2 = 1 THEN coalesce(s.digest, '') || f.node ELSE f.node || coalesce(s.digest, '') END),
    f.proof || coalesce(s.digest, ''), f.height, f.top, f.subroot
  FROM folded f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.place = xor(f.place, 1)
  WHERE f.level < f.height
), crossed AS (
  SELECT doc_id, leaf, lang, start, top AS place, 0 AS level, node, proof, subroot FROM folded WHERE level = height
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.start, c.place // 2, c.level + 1,
    sha256(CASE WHEN c.place % 2 = 1 THEN coalesce(s.digest, '') || c.node ELSE c.node || coalesce(s.digest, '') END),
    c.proof || coalesce(s.digest, ''), c.subroot
  FROM crossed c LEFT JOIN upper s ON s.level = c.level AND s.place = xor(c.place, 1), root r
  WHERE c.level < r.height
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM crossed, root WHERE level = root.height
"""


@_register("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(touched, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))}
    candidate = merkle.leaf_digest(*[changed.get(f, F.col(f)) for f in merkle.FIELDS])
    proved = merkle.proofs(merkle.build(docs, carry={"candidate": candidate}))
    return proved.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        merkle.path_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.col("candidate"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SHARD_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)),
    lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))) ORDER BY b) AS t
  FROM range(256) r(b)
), sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS grp,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::UBIGINT)),
      lambda crc, b: xor(crc >> 8, t[(1 + (xor(crc, b) & 255::UBIGINT))::BIGINT])))::BIGINT AS text_crc32
  FROM documents, crc_table
), whole AS (
  SELECT sum(size)::BIGINT AS volume, count(*) AS n,
    greatest(1, least(greatest(192, (count(*) + 999999) // 1000000), (count(*) + 255) // 256)) AS ranges
  FROM sized
), summed AS (
  SELECT *, row_number() OVER o - 1 AS place, (sum(size) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS upto,
    (sum(size) OVER (PARTITION BY grp))::BIGINT AS unit, count(*) OVER (PARTITION BY grp) AS members
  FROM sized WINDOW o AS (ORDER BY grp, doc_id NULLS FIRST, size, text_crc32)
), united AS (
  SELECT *, max(upto) OVER (PARTITION BY grp) AS unit_upto FROM summed
), dealt AS (
  SELECT *, least(23, CASE
      WHEN members > 1 AND (unit > least(volume // 768, 2 * volume // ranges) OR members > greatest(1, 2 * n // ranges))
      THEN (2 * upto - size) * 24 // (2 * volume) ELSE (2 * unit_upto - unit) * 24 // (2 * volume) END)::INTEGER AS shard
  FROM united, whole
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


@_register("op13_sharding", SHARD_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
