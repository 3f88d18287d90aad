"""One query per operator over its whole table, and DuckDB oracles where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.llm import chat_format, decontamination, divergence, embedding_itq, importance, language_id, near_dedup, packing, pseudo_likelihood, quality_rules, sharding, substring_dedup, url_rules

SHARDS = 24
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
CONTROL_TURN = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendezvous shards 0 to 23 of equal weight for all documents."""
    sharded = sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a rule ensemble learned outside the held-out fold."""
    return quality_rules.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of 1024 tokens, with a digest of each piece's ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 and their components over all embeddings."""
    return embedding_itq.embedding_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rules against every page's url; pages that no rule fits are allowed."""
    return url_rules.apply_rules(_table(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihoods of all documents under a window network trained on all of them."""
    return pseudo_likelihood.score_documents(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover four fifths of a benchmark item or more, with that item."""
    return decontamination.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at 0.85 over sets of 3-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=Fraction(85, 100))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier elsewhere, cut from all documents."""
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False).drop("text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    typed = ", ".join(f"cast({c} as {kinds[c]}) as {c}" for c in rows.columns)
    extra = spark.sql(f"select {typed} from values (-1, 0, 'user', '{CONTROL_TURN}'), (-1, 1, 'assistant', '{CONTROL_TURN}') as t(conv_id, turn, role, text)")
    formatted = chat_format.format_conversations(rows.unionByName(extra))
    back = formatted.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    loss = chat_format.loss_text(F.col("segments"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's texts by hashed words and word pairs, a quarter of them drawn."""
    return importance.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language of all documents against each other and against the language."""
    return divergence.audit(_table(spark, sf_dir, "documents"), least=3, top=200)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    # The winner of equal weights is the shard with the largest 32-bit draw.  CRC-32 is folded
    # over the bytes with a table that is made from its polynomial.
    "op1_sharding": """
WITH RECURSIVE crc_step(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS bytes FROM documents
),
sized AS (
  SELECT doc_id, CAST(bytes + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(bytes)]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM texts, crc_table
),
draws AS (
  SELECT doc_id, s AS shard,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(s // 4 AS VARCHAR)), 1 + 8 * (s % 4), 8) AS BIGINT) AS u
  FROM (SELECT DISTINCT doc_id FROM documents), range(25) r(s)
),
won AS (
  SELECT doc_id, arg_max(shard, u * 100 - shard) FILTER (WHERE shard < 24) AS shard, arg_max(shard, u * 100 - shard) AS grown FROM draws GROUP BY doc_id
)
SELECT sized.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    substr(md5(coalesce(CAST(sized.doc_id AS VARCHAR), '') || '#' || CAST(text_crc32 AS VARCHAR)), 1, 3), sized.doc_id, text_crc32, size) - 1 AS slot,
  CAST(grown AS INTEGER) AS grown_shard
FROM sized JOIN won ON sized.doc_id IS NOT DISTINCT FROM won.doc_id
""",
    "op4_embedding_dedup": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.vec_id),
low AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT low.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, low.vec_id = component_id AS kept
FROM low LEFT JOIN counts ON low.vec_id = counts.a
""",
    "op5_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS (
  SELECT page_id, max_by(r.host || r.path, strlen(r.host || r.path)) AS rule, max_by(r.verdict, strlen(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fit f ON p.page_id = f.page_id
""",
    "op8_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i + 1:i + 3], ' ') END AS s
  FROM w, unnest(range(CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - 2, 1) END)) t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.doc_id),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN low ON w.doc_id = low.doc_id LEFT JOIN sizes ON w.doc_id = sizes.doc_id
""",
    "op9_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(words[i + 1:i + 20], ' ')) AS h FROM w, unnest(range(len(words) - 19)) t(i)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM later, range(20) t(j)),
lists AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
pos AS (
  SELECT doc_id, p, words[p + 1] AS word FROM w, unnest(range(len(words))) t(p)),
kept AS (
  SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS text FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<|\\]', '', 'g')) + 13 AS chars FROM turns),
states AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) || '>' || role AS step FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM states GROUP BY conv_id
""",
    # CRC-32 as in op1, over each distinct run of words.
    "op11_importance_resampling": r"""
WITH RECURSIVE crc_step(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, false AS aim FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark),
words AS (
  SELECT r, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
places AS (SELECT r, aim, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM words),
runs AS (SELECT r, aim, w, w || ' ' || lead(w) OVER (PARTITION BY r ORDER BY p) AS two FROM places),
features AS (SELECT r, aim, w AS f FROM runs UNION ALL SELECT r, aim, two FROM runs WHERE two IS NOT NULL),
hexed AS (SELECT DISTINCT f, hex(encode(f)) AS h, strlen(f) AS n FROM features),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(n)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table),
found AS (SELECT r, aim, bucket FROM features JOIN hashed USING (f)),
sums AS (SELECT bucket, count(*) FILTER (WHERE NOT aim) AS s, count(*) FILTER (WHERE aim) AS t FROM found GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS a, CAST(coalesce(sum(t), 0) AS DOUBLE) AS b FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((CAST(t AS DOUBLE) + 1) * (a + 10000)) / ((CAST(s AS DOUBLE) + 1) * (b + 10000)))) AS BIGINT) AS gain FROM sums, totals),
weighed AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM found JOIN gains USING (bucket) WHERE NOT aim GROUP BY r),
scored AS (
  SELECT texts.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n > 0 THEN CAST((g - ((g % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(texts.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM texts JOIN words USING (r) LEFT JOIN weighed USING (r) WHERE NOT texts.aim),
drawn AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS eligible
  FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM ordered
""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT g.lang, source, term, n, CAST(1 + 1000000000 * (n + 1) // (own + v) AS BIGINT) AS p, CAST(1 + 1000000000 * (lang_n + 1) // (total + v) AS BIGINT) AS q
  FROM grid g JOIN sizes USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
