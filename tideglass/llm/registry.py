"""The queries of the training-data operators, each a thin layer over its operator.

Every query runs over its whole tables with the operator's own defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import decontaminate, jaccard, language, lexical, licenses, periods, private, secrets, substrings, tokens, topk, toxicity
from tideglass.session import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leak_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op5_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_decode(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_texts(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder(5) == 0)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.top_k(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("license_ids", ",").alias("license_ids"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.findings(table(spark, folder, "documents").select("doc_id", "text", "source"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"), remainder(3) == 1)


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the words of each tenth document (by crc32 of its id) repeated from some word on: word i >= a becomes word a + (i - a) % p."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def again(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(ws, (at(i) + 1).cast("int"))), " ")

    repeated = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, again(ws)).otherwise("")), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.collapse(planted(table(spark, folder, "documents")))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.less")
    return each.select("doc_id", "n_runs", "r.start", length.alias("length"), "r.period", F.floor(1000 * length / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private.find(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in private.KINDS), F.sha2(private.joined(base), 256).alias("base_sha256"), private.joined(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_toxicity": op6_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op7_exact_topk": op7_exact_topk,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_private_data": op13_private_data,
}

ORACLES = {
    "op8_license_scan": licenses.oracle_sql(),
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT r, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
   WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT r, unnest(s) AS g FROM sh),
two AS (SELECT a.r AS r, b.r AS q, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS (SELECT two.r, two.q FROM two JOIN sh a ON a.r = two.r JOIN sh b ON b.r = two.q WHERE 5 * i >= 4 * (len(a.s) + len(b.s) - i)),
reach AS (SELECT r, r AS q FROM w UNION SELECT reach.r, link.q FROM reach JOIN link ON reach.q = link.r),
class AS (SELECT reach.r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.q GROUP BY reach.r),
n AS (SELECT r, count(*) AS n FROM link GROUP BY r)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM w JOIN class USING (r) LEFT JOIN n USING (r)""",
    "op1_substring_dedup": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, s, sha256(array_to_string(ws[s:s + 34], ' ')) AS h
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM win SEMI JOIN rep USING (h)),
per AS (SELECT r, list(i) AS gs FROM gone GROUP BY r),
word AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gs), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN per USING (r) LEFT JOIN kept USING (r)""",
    "op7_exact_topk": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10""",
    "op11_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, doc_id, len(ts) AS size, unnest(ts) AS t FROM d),
c AS (SELECT r, doc_id, size, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM c GROUP BY t), g),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l)))) AS BIGINT) AS score FROM q JOIN c USING (t) JOIN w USING (t), g GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op12_periodic_runs": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
c AS (SELECT *, len(ws) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h FROM d),
a AS (SELECT *, (h // 10) % n AS a FROM c), b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM b),
w AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(ws) AS x FROM t),
e AS (SELECT u.r, v.i - u.i AS q, u.i FROM w u JOIN w v ON u.r = v.r AND u.x = v.x AND v.i > u.i AND 2 * (v.i - u.i) <= u.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e),
m AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
u AS (SELECT r, start, length, min(q) AS period FROM m GROUP BY ALL),
per AS (SELECT r, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, p := period), (length, -start, -period)) AS b,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.p AS BIGINT) AS period, CAST((1000 * b.l) // b.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN per USING (r) LEFT JOIN k USING (r)""",
}
