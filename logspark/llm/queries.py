"""Registered queries of the package, each next to the SQL that gives its rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


#: Smallest node reachable over edges(a, b), both directions present, for the nodes of a list.
REACH = """
  reach AS (SELECT a AS node, b AS other FROM edges
            UNION
            SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
  least AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {words_sql("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
edges AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{REACH}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id
FROM s LEFT JOIN least l ON s.doc_id = l.node"""


@query("op10_ngram_jaccard_join", JACCARD)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f"""


@query("op9_warc", WARC)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


REPEATS = f"""
WITH w AS (SELECT doc_id, {words_sql("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM s),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM k WHERE c > 1 GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(g.gone), 0) AS n_removed,
    CASE WHEN g.gone IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: w.w[i]) END AS kept
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept"""


@query("op2_substring_dedup", REPEATS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
{REACH},
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(l.component, e.vec_id) AS component_id,
       coalesce(l.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.node LEFT JOIN n ON n.a = e.vec_id"""


@query("op8_embedding_near_dedup", VECTORS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.vector_join import vector_components

    return vector_components(table(spark, sf_dir, "embeddings"))


def js_sql(p: str, q: str) -> str:
    """One term of twice the Jensen-Shannon divergence in bits."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang AS known FROM documents),
w AS (SELECT *, {words_sql("t")} AS w FROM d),
c AS (SELECT *, len(w) AS n, length(array_to_string(w, '')) AS wc, length(t) AS ch,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS sy, length(regexp_replace(t, '\\P{{Ll}}', '', 'g')) AS lo,
  length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(t, '\\P{{Nd}}', '', 'g')) AS di,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
s AS (SELECT *, list_transform([lo, up, di, sy, ch - wc, wc - lo - up - di - sy], lambda x: x / greatest(ch, 1)) AS p FROM c),
r AS (SELECT known, count(*) AS m, sum(n) AS tokens, {", ".join(f"sum(p[{i}]) AS a{i}" for i in range(1, 7))} FROM s WHERE n >= 50 GROUP BY known),
refs AS (
  SELECT known, tokens, [{", ".join(f"a{i} / m" for i in range(1, 7))}] AS q FROM r WHERE known IS NOT NULL
  UNION ALL SELECT NULL, sum(tokens), [{", ".join(f"sum(a{i}) / sum(m)" for i in range(1, 7))}] FROM r HAVING sum(m) > 0),
u AS (SELECT known, word, count(*) AS c FROM (SELECT known, unnest(list_filter(w, lambda x: length(x) <= 5)) AS word FROM s WHERE n >= 50) GROUP BY ALL),
u2 AS (SELECT known, word, c FROM u WHERE known IS NOT NULL UNION ALL SELECT NULL, word, sum(c) FROM u GROUP BY word),
top AS (SELECT known, word, c FROM u2 QUALIFY row_number() OVER (PARTITION BY known ORDER BY c DESC, word) <= 12),
x AS (SELECT s.*, own.known AS ref, coalesce(own.q, pool.q) AS q, coalesce(own.tokens, pool.tokens) AS tokens
  FROM s LEFT JOIN refs own ON s.known = own.known LEFT JOIN refs pool ON pool.known IS NULL),
cd AS (SELECT doc_id, sqrt(greatest(list_sum(list_transform(range(1, 7), lambda i: {js_sql("p[i]", "q[i]")})) / 2, 0)) AS cd FROM x WHERE q IS NOT NULL),
f AS (SELECT x.doc_id, n, tokens, len(list_filter(w, lambda y: y = word)) AS k, c FROM x JOIN top ON top.known IS NOT DISTINCT FROM x.ref WHERE n >= 100),
g AS (SELECT doc_id, k / n AS a, c / tokens AS b FROM f UNION ALL SELECT doc_id, 1 - sum(k) / any_value(n), 1 - sum(c) / any_value(tokens) FROM f GROUP BY doc_id),
wd AS (SELECT doc_id, sqrt(greatest(sum({js_sql("a", "b")}) / 2, 0)) AS wd FROM g GROUP BY doc_id),
t3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM s)),
rep AS (SELECT doc_id, count(DISTINCT j) AS rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t3 WHERE c > 1) GROUP BY doc_id),
z AS (SELECT x.doc_id, x.n, wc, sy, len(lines) - len(list_distinct(lines)) AS dl, coalesce(rep, 0) AS rep, cd, wd
  FROM x LEFT JOIN rep ON x.doc_id = rep.doc_id LEFT JOIN cd ON x.doc_id = cd.doc_id LEFT JOIN wd ON x.doc_id = wd.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(dl AS BIGINT) AS n_dup_lines,
  CAST(rep AS BIGINT) AS n_repeat_words, (n < 50 OR 100 * rep > 50 * n) AS base_failed,
  NOT (n < 50 OR 100 * rep > 50 * n) AND NOT coalesce(cd > 0.30, false) AND NOT coalesce(wd > 0.40, false) AS kept
FROM z"""


@query("op5_quality_rules", QUALITY)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("found")


@query("op7_pii_pseudonyms")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.pseudonyms import DEMO_KEY, pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, DEMO_KEY, count_col="n_changed").select("doc_id", "n_changed", "text")


@query("op3_pfair_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.mixing import mix

    from logspark.llm.mixing import TARGETS

    docs = table(spark, sf_dir, "documents")
    return mix(docs, TARGETS, carry=["doc_id", "source"]).select("row.doc_id", "row.source", "mix_offset", "mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logspark.llm.bpe import encode_decode

    both = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


PHRASES = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, 5) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
cut AS (
  SELECT k.lang, k.phrase, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + len - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - len + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS len FROM c)) GROUP BY ALL),
free AS (
  SELECT c.lang, c.phrase, a, l, r, score FROM c JOIN best USING (lang, phrase) LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


@query("op12_phrase_mining", PHRASES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


NEGATIVES = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op13_hard_negatives", NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))
