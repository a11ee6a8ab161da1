"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.exact_dedup import exact_groups
from cohortspark.llm.hmm import score
from cohortspark.llm.language_id import fitted, labelled
from cohortspark.llm.line_dedup import HOST, MIN_PAGES, RATIO, drop_site_lines, lines_sql
from cohortspark.llm.merkle import folded, manifest, proof_digest, row_digest
from cohortspark.llm.mixing import mix
from cohortspark.llm.mtree import build_index, quantized, search
from cohortspark.llm.near_dedup import near_groups
from cohortspark.llm.packing import digests, pack
from cohortspark.llm.sharding import shard
from cohortspark.llm.suffix_dedup import drop_repeats
from cohortspark.llm.token_counts import token_counts
from cohortspark.llm.trie import rerooted, sequences, trie

QUERIES = {}
ORACLES: dict[str, str] = {}


def remainder_of_id(of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(of))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op2_line_dedup",
    rf"""
    WITH sited AS (
      SELECT page_id, html,
        nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host, {lines_sql("html")} AS lines FROM pages),
    totals AS (
      SELECT host, count(*) AS host_pages FROM sited WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= {MIN_PAGES}),
    seen AS (
      SELECT host, line, count(*) AS n_pages
      FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM sited WHERE host IS NOT NULL) GROUP BY host, line),
    bad AS (
      SELECT host, list(line) AS bad FROM seen JOIN totals USING (host)
      WHERE n_pages > 1 AND n_pages > {RATIO}::DOUBLE * host_pages GROUP BY host),
    done AS (
      SELECT page_id, host, html, lines,
        list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS kept FROM sited LEFT JOIN bad USING (host))
    SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
      CASE WHEN html IS NOT NULL THEN array_to_string(kept, chr(10)) END AS kept_text FROM done
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_lines(table(spark, sf_dir, "pages"), keep=["page_id"])


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query(
    "op4_topk_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5
    """,
)
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(build_index(vectors), vectors.filter("vec_id % 50 = 0"), k=5)


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, percent=85).drop("tag")


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder_of_id(4)
    found = labelled(docs.select("doc_id", "text"), fitted(docs, fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source weighs the square root of its number of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), train=remainder_of_id(10) != 0)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    # The polynomial, bit-reversed, and the start value.
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"


@query(
    "op12_prefix_trie",
    f"""
    WITH own AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id - conv_id % 5 AS base,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, base, {crc32_sql("conv_id::varchar")} % 9 AS h FROM own),
    turns AS (
      SELECT c.conv_id, i, role, text FROM c JOIN own ON own.conv_id = c.base WHERE i <= h
      UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN own USING (conv_id) WHERE i > h),
    paths AS (
      SELECT conv_id, coalesce(list(strlen(role) || ':' || role || text ORDER BY i) FILTER (i IS NOT NULL), []) AS path,
             coalesce(list(strlen(text) ORDER BY i) FILTER (i IS NOT NULL), []) AS sizes
      FROM c LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
    visits AS (
      SELECT conv_id, path[1:d] AS node, d, len(path) = d AS ended, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
      FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
    nodes AS (
      SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
             sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
      FROM visits GROUP BY node, d),
    kids AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    under AS (
      SELECT node[1:j] AS node, sum(leaf)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
      FROM (SELECT nodes.*, (n_children IS NULL)::int AS leaf, unnest(range(0, d + 1)) AS j FROM nodes LEFT JOIN kids USING (node)) GROUP BY 1)
    SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
           n_leaves, saved_tokens, n.ends_sha256
    FROM nodes n LEFT JOIN nodes up ON n.d > 0 AND up.node = n.node[1:n.d - 1] LEFT JOIN kids ON kids.node = n.node
    JOIN under ON under.node = n.node
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rerooted(sequences(table(spark, sf_dir, "conversations"), family=5)))


def _framed_sql(*fields: str) -> str:
    parts = [f"CASE WHEN ({f}) IS NULL THEN '-' ELSE strlen(({f})::varchar) || ':' || ({f})::varchar END" for f in fields]
    return f"sha256(concat({', '.join(parts)}))"


_LEVEL_UP = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(concat(h[2 * i + 1], coalesce(h[2 * i + 2], ''))))"
_STEP = """list(CASE WHEN (r >> lvl) % 2 = 1 THEN 'L' || h[r >> lvl] WHEN h[(r >> lvl) + 2] IS NOT NULL THEN 'R' || h[(r >> lvl) + 2]
             ELSE '-' END ORDER BY lvl) FILTER (lvl IS NOT NULL)"""


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, lang, {_framed_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
             CASE WHEN n_chars IS NOT NULL AND {crc32_sql("doc_id::varchar")} % 7 = 0
                  THEN {_framed_sql("doc_id", "source", "lang", "n_chars + 1", "text")} END AS claimed
      FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
    t AS (
      SELECT lang, 0 AS lvl, list(leaf ORDER BY r) AS h FROM leaves GROUP BY lang
      UNION ALL SELECT lang, lvl + 1, {_LEVEL_UP} FROM t WHERE len(h) > 1),
    sub AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM t WHERE len(h) = 1),
    u AS (
      SELECT 0 AS lvl, list(subroot ORDER BY r) AS h FROM sub
      UNION ALL SELECT lvl + 1, {_LEVEL_UP} FROM u WHERE len(h) > 1),
    upper_ AS (
      SELECT lang, subroot, coalesce({_STEP}, []) AS steps FROM sub LEFT JOIN u ON len(h) > 1 GROUP BY lang, subroot),
    lower_ AS (
      SELECT leaves.doc_id, leaves.lang, leaf, claimed, r, coalesce({_STEP}, []) AS steps
      FROM leaves LEFT JOIN t ON t.lang IS NOT DISTINCT FROM leaves.lang AND len(h) > 1 GROUP BY ALL),
    both_ AS (
      SELECT doc_id, leaf, subroot, (SELECT h[1] FROM u WHERE len(h) = 1) AS root, lower_.steps || upper_.steps AS steps,
             coalesce(claimed, leaf) AS start
      FROM lower_ JOIN upper_ ON lower_.lang IS NOT DISTINCT FROM upper_.lang),
    f AS (
      SELECT *, list_reduce(list_prepend(start, steps), lambda node, s: CASE s[1] WHEN 'L' THEN sha256(concat(s[2:], node))
                WHEN 'R' THEN sha256(concat(node, s[2:])) ELSE sha256(node) END) AS folded_root FROM both_)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
           folded_root, folded_root = root AS verified
    FROM f
    """,
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows are held against the manifest with a changed count of characters."""
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in names]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = F.when(tampered & F.col("n_chars").isNotNull(), row_digest(changed))
    found = manifest(docs, [F.col(c) for c in names], F.col("lang"), F.col("doc_id"), {"claimed": claimed}).proofs()
    found = found.withColumn("folded_root", folded(F.coalesce("also_claimed", "leaf"), F.col("proof")))
    return found.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
