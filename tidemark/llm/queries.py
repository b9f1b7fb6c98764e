"""The queries op1 to op13 and pipeline: thin callers of the operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, cost_packing, decontaminate, divergence, filter_audit, html_text, minhash, packing, pii, sstable, token_counts, topk, toxicity
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "sstable")
    sstable.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return sstable.shard_digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents arrive as a batch; the table is read back from the compacted version."""
    store = compaction.ShardStore(spark, shared_dir(spark, "shards"))
    store.append_batches(table(spark, sf_dir, "documents"), F.col("source"))
    store.compact()
    store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.length(text).cast("long").alias("text_chars"), F.sha2(text, 256).alias("text_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack_by_cost(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_sstable": op2_sstable,
    "op3_compaction": op3_compaction,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_exact_topk": op10_exact_topk,
    "op11_source_divergence": op11_source_divergence,
    "op12_cost_packing": op12_cost_packing,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
ORACLES = {
    "op9_near_duplicates": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
        n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
        ab AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, ab.b FROM r JOIN ab ON ab.a = r.reach)
        SELECT node AS doc_id, any_value(n) AS n_shingles, min(reach) AS component_id, node = min(reach) AS kept FROM r JOIN n ON n.doc_id = node GROUP BY node""",
    "op3_compaction": """
        SELECT doc_id, lang, source, length(coalesce(text, '')) AS text_chars, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        e AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT i) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM e GROUP BY ALL),
        full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (
            SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS p
            FROM full_c JOIN v USING (lang)),
        l AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
            FROM (SELECT lang, term, sum(c) AS c FROM full_c GROUP BY ALL) JOIN v USING (lang)),
        f AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        own AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
            FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
        SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        least AS (SELECT t, min(doc_id) AS least_id FROM d GROUP BY t),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        x AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
                'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
                'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
                'E': coalesce(doc_id > least_id, false)} AS fails
            FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS f, substr(filter_order, 1, k - 1) AS earlier FROM o, range(1, 6) AS r(k)),
        y AS (
            SELECT part, filter_order, step, f, good, toxic, fails[f] AS bad,
                len(list_filter(string_split(earlier, ''), lambda c: c <> '' AND fails[c])) > 0 AS gone,
                len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: c <> f AND fails[c])) = 0 AS alone FROM x, s),
        z AS (
            SELECT part, filter_order, step, f, count_if(NOT gone AND NOT bad) AS kept, count_if(NOT gone AND bad) AS removed, count_if(gone AND bad) AS redundant,
                count_if(bad AND alone) AS unique_fails, count_if(NOT gone AND bad AND good) AS good_lost, count_if(NOT gone AND bad AND toxic) AS toxic_lost
            FROM y GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM z""",
}
