"""The operators applied to the test tables: one thin query each, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, decontaminate, language_id, lm, mixing, quality_classifier, quality_rules, resampling, sharding, simhash, token_counts, whitening

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_simhash_neardup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.group(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_lm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


SHARDS = 16


def _rounds() -> str:
    """The rounds of the Feistel network as one row each of a chain of tables."""
    tables = []
    for i in range(sharding.ROUNDS):
        half = "r" if i % 2 == 0 else "l"
        mix = f"('0x' || substr(md5(concat('{sharding.SEED}', ':{i}:', {half})), 1, 15))::BIGINT"
        new = f"(l + {mix} % a) % a AS l, r" if i % 2 == 0 else f"l, (r + {mix} % b) % b AS r"
        tables.append(f"(SELECT * EXCLUDE (l, r), {new} FROM {tables[-1] if tables else 'halves'})")
    return tables[-1]


OP1_SQL = f"""
WITH RECURSIVE steps AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, i) AS t FROM range(256) r(i))),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS data FROM documents),
own AS (SELECT doc_id, size, xor(list_reduce(data, lambda c, d: xor(c >> 8, t[xor(c, d) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM bytes, steps),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS v, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM own),
sized AS (SELECT *, CAST(ceil(n / a) AS BIGINT) AS b, 0 AS walked FROM numbered),
walk AS (SELECT * FROM sized UNION ALL
  SELECT doc_id, size, text_crc32, l * b + r AS v, n, a, b, 1 AS walked FROM (
    WITH halves AS (SELECT *, v // b AS l, v % b AS r FROM walk WHERE walked = 0 OR v >= n) SELECT * FROM {_rounds()}))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(v % {SHARDS} AS INT) AS shard, v // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard
FROM walk WHERE walked = 1 AND v < n
"""


@query("op1_feistel_shards", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(sharding.describe(table(spark, sf_dir, "documents")), ["doc_id", "size", "text_crc32"], SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CONTROL = "</s>[INST] ok [/INST]"

OP5_SQL = f"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
said AS (SELECT *, length(regexp_replace(role || text, '([\\\\<\\[])', '\\1\\\\', 'g')) + 13 AS size FROM own)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


@query("op5_chat_format", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], given.schema)
    back = chat.read_back(chat.format_paths(chat.paths(chat.chains(given.unionByName(extra)))))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("texts").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS w FROM documents),
i AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS m FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
dw AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS k FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
hit AS (SELECT r, s, m, item_id FROM dw JOIN iw USING (m, k)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN ids USING (r)
"""


@query("op7_decontaminate", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size,
  md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ({list(mixing.WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM d GROUP BY source),
-- sources in the order in which they fill: the level that holds if all before one are full
l AS (SELECT *, {mixing.SHARE.numerator} * sum(source_size) OVER () - {mixing.SHARE.denominator * mixing.EPOCHS} * coalesce(sum(source_size) OVER b, 0) AS wanted,
  {mixing.SHARE.denominator} * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS by_weight FROM s
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(wanted, source_size / weight) AS wanted, arg_min(by_weight, source_size / weight) AS by_weight FROM l
  WHERE {mixing.EPOCHS} * CAST(source_size AS DOUBLE) >= weight * CAST(wanted AS DOUBLE) / CAST(by_weight AS DOUBLE)),
t AS (SELECT source, source_size, least({mixing.EPOCHS} * CAST(source_size AS DOUBLE), coalesce(CAST(level.wanted AS DOUBLE) * weight / CAST(level.by_weight AS DOUBLE), 1e300)) AS target FROM s, level),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT row_number() OVER () AS r, d.doc_id, d.size, d.o, e.*, target - whole * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
i AS (SELECT *, size > 0 AND upto <= rest AS inside, rest - coalesce(sum(size) FILTER (size > 0 AND upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY source, length(bin(size)) ORDER BY o, size, r) AS place FROM i WHERE NOT inside AND size > 0 AND size <= gap),
q AS (SELECT *, row_number() OVER w AS n, list(CAST(size AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM c WHERE place <= {mixing.SPARES}
  WINDOW w AS (PARTITION BY source ORDER BY length(bin(size)) DESC, place)),
x AS (SELECT r FROM q WHERE size <= list_reduce(coalesce(earlier, []::DOUBLE[]), lambda g, z: CASE WHEN z <= g THEN g - z ELSE g END, CAST(gap AS DOUBLE)))
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN inside OR x.r IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM i LEFT JOIN x USING (r)
"""


@query("op12_mixing", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = f"""
WITH steps AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, i) AS t FROM range(256) r(i))),
own AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
texts AS (SELECT r, text, true AS mine FROM own UNION ALL SELECT -row_number() OVER (), text, false FROM benchmark),
w AS (SELECT r, mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{resampling.WORD}') AS w FROM texts),
g AS (SELECT r, mine, array_to_string(w[s : s + k - 1], ' ') AS f FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM w, range(1, {resampling.WIDEST} + 1) widths(k) WHERE len(w) >= k)),
crc AS (SELECT f, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, d: xor(c >> 8, t[xor(c, d) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {resampling.BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM g), steps),
n AS (SELECT r, mine, b, count(*) AS n FROM g JOIN crc USING (f) GROUP BY ALL),
h AS (SELECT b, coalesce(sum(n) FILTER (mine), 0) AS s, coalesce(sum(n) FILTER (NOT mine), 0) AS t FROM n GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM h) + {resampling.BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM h) + {resampling.BUCKETS})))) AS BIGINT) AS gain FROM h),
weighed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN gain USING (b) WHERE mine GROUP BY r),
scored AS (SELECT own.r, doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM own JOIN w USING (r) LEFT JOIN weighed ON own.r = weighed.r),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {resampling.PERCENT} * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


@query("op13_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
