"""Queries of this subpackage, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, langid, lexical, licenses, packing, pivots, quality, scratch, simhash, suffix, tokencounts, toxicity, tries, warc


#: Which documents op3's batches revise, and which they take down and bring back.
LONG_CHARS, SHORT_CHARS = 10_000, 300


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the whole table after a load, take-downs, revisions and a return, each batch delivered twice, with a compaction before the last.

    The load has every document, long ones still without their text. Short ones are then taken down, the long ones revised
    to their text, and the taken down ones come back, so that the totals are those of the table.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars").withColumn("deleted", F.lit(False))
    long, short = (F.coalesce(x, F.lit(False)) for x in (F.col("n_chars") > LONG_CHARS, F.col("n_chars") < SHORT_CHARS))
    batches = {
        "load": docs.withColumn("text", F.when(~long, F.col("text"))),
        "take-down": docs.where(short).withColumn("deleted", F.lit(True)),
        "revision": docs.where(long),
        "return": docs.where(short),
    }
    rollup = tokencounts.Rollup(spark, scratch.fresh(spark, "token-counts"))
    for name, changes in batches.items():
        if name == "return":
            rollup.compact()
        for _ in range(2):
            rollup.apply(name, changes)
    return rollup.totals()


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept_bytes")).alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.rebuilt(_table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_token_counts, op4_quality, op5_suffix, op6_warc, op7_packing, op8_toxicity, op9_licenses, op10_langid, op11_lexical, op12_topk, op13_prefix_trie)}


_DIGIT = "(instr('0123456789abcdef', substr(h, {at}, 1)) - 1)"
#: Base32 of a digest in hex: five bits at a time, which two hex digits hold.
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((16 * {_DIGIT.format(at='1 + 5 * i // 4')} + {_DIGIT.format(at='2 + 5 * i // 4')}) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '')"
OP6_SQL = f"""SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
    FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
    c AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
    q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    m AS (SELECT r, doc_id, 75 + (25 * len(terms) * docs) // total AS m FROM d, c WHERE len(terms) > 0),
    s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""
OP12_SQL = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
    FROM (SELECT a.r AS q, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0) QUALIFY rank <= 5"""

#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"
_MARK = "md5(length(role) || ':' || role || text)"
OP13_SQL = f"""WITH t AS (SELECT conv_id, turn, {_MARK} AS mark, CAST(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS words FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS p FROM t),
    c AS (SELECT conv_id, CAST({_CRC} % 4 AS INT) AS h FROM (SELECT DISTINCT conv_id FROM t)),
    b AS (SELECT c.conv_id, h, coalesce(least(h, n), 0) AS taken FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM o GROUP BY 1) ON base = c.conv_id - c.conv_id % 20),
    r AS (SELECT b.conv_id, p AS d, mark, words FROM b JOIN o ON o.conv_id = b.conv_id - b.conv_id % 20 AND p <= h UNION ALL SELECT b.conv_id, taken + p - h, mark, words FROM b JOIN o USING (conv_id) WHERE p > h),
    x AS (SELECT conv_id, d, words, md5(string_agg(mark, '' ORDER BY d) OVER w) AS node, CASE WHEN d = 1 THEN '' ELSE md5(string_agg(mark, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS above FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
    n AS (SELECT node, d, above, min(conv_id) AS low, count(*) AS n, any_value(words) AS words FROM x GROUP BY 1, 2, 3),
    k AS (SELECT above AS node, count(*) AS kids FROM n WHERE above IS NOT NULL GROUP BY 1),
    s AS (SELECT x.node, CAST(sum((y.n - 1) * y.words) AS BIGINT) AS saved, count(*) FILTER (WHERE k.kids IS NULL) AS leaves FROM n y LEFT JOIN k USING (node) JOIN x ON x.conv_id = y.low AND x.d <= y.d GROUP BY 1),
    e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM x JOIN (SELECT conv_id, max(d) AS d FROM x GROUP BY 1) USING (conv_id, d) GROUP BY 1)
    SELECT n.low AS conv_id, n.d AS depth, u.low AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n LEFT JOIN n u ON u.node = n.above LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op11_lexical": OP11_SQL, "op12_topk": OP12_SQL, "op13_prefix_trie": OP13_SQL}
