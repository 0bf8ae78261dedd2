"""The registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import audit, automaton, decontaminate, lexical, mixing, perplexity, quality, repeats, rollups, sharding, simhash, toxicity, urls
from parcelwise.llm.common import fold, keep
from parcelwise.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


MARKS = r"[#*$%&|<>]"


def op2_delta_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: counts by words, counts by pieces, removal of all but the first of equal
    texts, and word counts revised for texts freed of marks; two of them are then delivered again."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    counted, _ = keep(docs.select(
        "doc_id", "source", "lang", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        rollups.count_by_pattern(text).alias("words"), rollups.count_by_pattern(text, rollups.PIECE).alias("pieces"),
        rollups.count_by_pattern(F.regexp_replace(text, MARKS, "")).alias("bare"),
    ))
    first = counted.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))
    marked = counted.join(first, ["t1", "t2"]).withColumn("copy", F.col("doc_id") > F.col("first"))

    def counts(rows: DataFrame, tokenizer: str, tokens: str, *more: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), *more)

    copies, kept = marked.where("copy"), marked.where("copy IS NOT TRUE AND bare <> words")
    batches = {
        "words": rollups.inserted(counts(counted, "words-1", "words")),
        "pieces": rollups.inserted(counts(counted, "pieces-1", "pieces")),
        "copies": rollups.deleted(counts(copies, "words-1", "words").union(counts(copies, "pieces-1", "pieces"))),
        "bare": rollups.revised(counts(kept.withColumn("old_tokens", F.col("words")), "words-1", "bare", "old_tokens")),
    }
    totals = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for name in ("words", "pieces", "copies", "copies", "bare", "words"):
        totals.apply(name, batches[name])
    return totals.totals()


OP2_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy
  FROM documents),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         len(regexp_extract_all(regexp_replace(t, '[#*$%&|<>]', '', 'g'), '[^\x20\x09-\x0D]+')) AS n
  FROM d WHERE copy IS NOT TRUE
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]'))
  FROM d WHERE copy IS NOT TRUE)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM c GROUP BY source, lang, tokenizer
"""


def op3_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws('|', 'mix', doc_id)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most FROM s),
h AS (
  SELECT *, most * sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (sum(source_size) OVER () - coalesce(sum(most) OVER (
         ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS held
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN held THEN CAST(most AS DOUBLE) ELSE
    CAST(weight * (sum(source_size) OVER () - sum(CASE WHEN held THEN most ELSE 0 END) OVER ()) AS DOUBLE)
    / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target
  FROM h),
q AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, source, k, size, e, CAST(e * source_size + upto AS DOUBLE) / target AS finish
  FROM q, range(3) r(e) WHERE size > 0),
o AS (
  SELECT doc_id, k, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, e, k, size ROWS UNBOUNDED PRECEDING)
         <= (SELECT sum(size) FROM d) AS taken FROM c),
n AS (SELECT doc_id, count(*) FILTER (taken) AS n FROM o GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.n, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""


def op5_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op6_ratio_scaled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.score(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with every twentieth or so dropped, emptied, cut, repeated or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, space).alias(c) for c in ("role", "text")], (F.crc32(key) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.where("d <> 0")
        .select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
        .drop("copy")
    )


def op11_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows, edited = audit.repair(damaged(conversations))
    ids = conversations.groupBy(audit.conv_key("conv_id").alias("conv")).agg(F.min("conv_id").alias("conv_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(audit.counts(rows), "conv", "left").join(audit.digest(edited), "conv", "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _op11_state(s: int) -> str:
    """The best audit from state ``s`` on without an insert first: delete, keep or re-role row r, then as ``f`` says."""
    nxt = audit.NEXT[s]
    fits = f"r.x = '{audit.ROLE[nxt][0]}'"
    keeps = [(fits, f"f[{nxt + 1}]"), *([("r.x = 's'", "f[2]")] if s == 0 else [])]
    options = [
        f"{{'c': f[{s + 1}].c + {audit.DELETE}, 'a': 'D' || f[{s + 1}].a}}",
        f"CASE WHEN r.fault IN ('', 'truncated') THEN {{'c': f[{nxt + 1}].c + {audit.REROLE} + r.more, 'a': 'R' || f[{nxt + 1}].a}} END",
        *[f"CASE WHEN r.fault IN ('', 'truncated') AND {c} THEN {{'c': {t}.c + r.more, 'a': 'K' || {t}.a}} END" for c, t in keeps],
    ]
    return f"list_min([{', '.join(options)}])"


def _op11_insert(s: int) -> str:
    """From state ``s``: no insert, one, or two."""
    a, b = audit.NEXT[s] + 1, audit.NEXT[audit.NEXT[s]] + 1
    return f"list_min([b[{s + 1}], {{'c': b[{a}].c + {audit.INSERT}, 'a': 'I' || b[{a}].a}}, {{'c': b[{b}].c + {2 * audit.INSERT}, 'a': 'II' || b[{b}].a}}])"


OP11_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
h AS (
  SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
                          lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM k),
d AS (
  SELECT conv_id, turn, role AS was, text AS had, CASE WHEN xor(crc, 4294967295) % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE xor(crc, 4294967295) % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN xor(crc, 4294967295) % 20 = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE xor(crc, 4294967295) % 20 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
r AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS x,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN fault = 'truncated' THEN {audit.TRUNCATED} ELSE 0 END AS more,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM o),
f AS (
  SELECT conv_id, CAST(max(i) AS BIGINT) AS i,
         [{{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS f
  FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [{", ".join(_op11_insert(s) for s in range(4))}] FROM (
    SELECT f.conv_id, f.i - 1 AS i, [{", ".join(_op11_state(s) for s in range(4))}] AS b
    FROM f JOIN r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i)),
a AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit FROM f WHERE i = 0),
e AS (
  SELECT conv_id, audit, j, audit[j] AS e, len(replace(audit[1:j], 'I', '')) AS i,
         len(replace(audit[1:j], 'D', '')) AS out
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM a)),
s AS (SELECT e.conv_id, bool_or(out = 1 AND e = 'K' AND x = 's') AS sys
      FROM e JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i GROUP BY ALL),
t AS (
  SELECT e.conv_id, sha256(string_agg(
           CASE WHEN e = 'K' THEN r.role WHEN (out - CAST(sys AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
           CASE WHEN e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j)) AS hash
  FROM e JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i
  WHERE e <> 'D' GROUP BY e.conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""


def op12_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(d: int) -> str:
    chi = [urls.chi_squared(x, "old_").replace("0.0D", "0.0") for x in (urls.LABELS, urls.SHAPES)]
    lags = ", ".join(f"lag({c}) OVER o AS old_{c}" for c in ["n", *urls.LABELS, *urls.SHAPES])
    order = "PARTITION BY host, tmpl ORDER BY blocked / n, allowed / n, seg"
    return f"""
c{d} AS MATERIALIZED (
  SELECT host, tmpl, s[{d}] AS seg, count(*) AS n, sum(count(*)) OVER (PARTITION BY host, tmpl) AS total,
         count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'allow') AS allowed,
         count(*) FILTER (action IS NULL) AS unknown, count(*) FILTER (len(s) = {d}) AS ends,
         count(*) FILTER (len(s) > {d} AND regexp_matches(s[{d + 1}], '^[0-9]+$')) AS digits,
         count(*) FILTER (len(s) > {d} AND regexp_matches(s[{d + 1}], '[0-9]')
                          AND NOT regexp_matches(s[{d + 1}], '^[0-9]+$')) AS mixed,
         count(*) FILTER (len(s) > {d} AND NOT regexp_matches(s[{d + 1}], '[0-9]')) AS other
  FROM p{d - 1} WHERE len(s) >= {d} GROUP BY host, tmpl, s[{d}]),
l{d} AS (
  SELECT *, {lags} FROM c{d} WHERE n >= {urls.LEAST} AND n >= {urls.SHARE} * total WINDOW o AS ({order})),
b{d} AS (
  SELECT host, tmpl, seg, sum(CASE WHEN old_n IS NULL OR {chi[0]} >= {urls.LABEL_LIMIT}
      OR {chi[1]} >= {urls.SHAPE_LIMIT} THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS branch
  FROM l{d}),
p{d} AS MATERIALIZED (
  SELECT p.* REPLACE (CASE WHEN len(s) >= {d} THEN p.tmpl || '/' || coalesce(CAST(branch AS VARCHAR), '*')
                      ELSE p.tmpl END AS tmpl)
  FROM p{d - 1} p LEFT JOIN b{d} b ON p.host = b.host AND p.tmpl = b.tmpl AND p.s[{d}] = b.seg),"""


OP12_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{urls.PARTS}', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '{urls.PARTS}', 2), '') AS path
  FROM pages),
f AS (SELECT rule, action, split_part(rule, '/', 1) AS h FROM (VALUES
  ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')) v(rule, action)),
r AS (
  SELECT u.*, (SELECT max_by([rule, action], length(rule)) FROM f
               WHERE (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, substr(rule, length(h) + 1))) AS r
  FROM u),
p0 AS MATERIALIZED (
  SELECT page_id, host, path, r[1] AS rule, r[2] AS action, string_split(path, '/')[2:] AS s, '' AS tmpl FROM r),
{"".join(_level_sql(d) for d in range(1, urls.DEPTH + 1))}
t AS MATERIALIZED (SELECT * REPLACE (CASE WHEN len(s) > {urls.DEPTH} THEN tmpl || '/**' ELSE tmpl END AS tmpl) FROM p{urls.DEPTH}),
g AS (SELECT coalesce(count(*) FILTER (action = 'block') / nullif(count(action), 0), 0.5) AS base FROM t),
e AS (
  SELECT host, tmpl, count(action) > 0 AND
         (count(*) FILTER (action = 'block') + {urls.PRIOR} * any_value(base)) / (count(action) + {urls.PRIOR}) >= {urls.PURITY} AS bad
  FROM t, g GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM t JOIN e USING (host, tmpl)
"""


def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, c),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM t, c GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_network, op2_delta_rollups, op3_hypergeometric_shuffle, op4_fair_queue_mix,
        op5_kneser_ney_rules, op6_ratio_scaled_toxicity, op7_qgram_decontamination, op8_simhash_vantage,
        op9_fm_index_repeats, op10_backoff_automaton, op11_audit_repair, op12_path_templates, op13_max_sketch_search,
    )
}
ORACLES: dict[str, str] = {
    "op2_delta_rollups": OP2_SQL, "op4_fair_queue_mix": OP4_SQL, "op11_audit_repair": OP11_SQL, "op12_path_templates": OP12_SQL, "op13_max_sketch_search": OP13_SQL,
}
