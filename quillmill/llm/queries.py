"""Registered queries of the pipeline operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convtrie, decontam, jaccard, kmeans, langid, licenses, neighbours, packing, phrases, quality, shards, substrings, toxicity

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched_words", "item_words")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digest(_table(spark, sf_dir, "documents"), depth=50)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), shingle=5, threshold=(80, 100))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_kd_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(_table(spark, sf_dir, "embeddings"), dims=64, k=8, rounds=10, scale=1024)


def op12_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeated_bytes_digest(_table(spark, sf_dir, "documents"), depth=100)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_best_fit_packing, op3_language, op4_licenses, op5_shards,
        op6_neighbours, op7_decontamination, op8_substring_dedup, op9_jaccard_join, op10_toxicity,
        op11_kd_tree_clusters, op12_prefix_free_dedup, op13_conversation_trie,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_APART = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i])))"


def _clusters_sql(rounds: int) -> str:
    """Ten rounds of assignment and floored means, one statement each."""
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, x AS m FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS b FROM (SELECT vec_id, x, c, CAST({_APART} AS BIGINT) AS d FROM kept, c{r}) GROUP BY vec_id)")
        parts.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(new, m) AS m FROM c{r} LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS new FROM (
                SELECT b.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY c) USING (c))"""
        )
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts[:-1])}
        SELECT vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} ON c = b.c"""


#: Exact conditions on texts, which SQL can state: repeats of fifty words, and links of shingle
#: sets with their components. Trained models, packings and schedules are held against plain
#: recomputations and brute force in tests; so are neighbours, whose sums SQL adds in another order.
ORACLES: dict[str, str] = {
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
        least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        hit AS (SELECT doc_id, p FROM win JOIN least USING (s) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hit),
        lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
               sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN lost USING (doc_id)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM pair JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * met >= 80 * (a.n + b.n - met)),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN link ON x = r)
        SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op11_kd_tree_clusters": _clusters_sql(10),
    "op12_prefix_free_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        win AS (SELECT doc_id, p, b[p : p + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
        hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
        isle AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
                 FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM hit)),
        run AS (SELECT doc_id, r, min(p) AS lo, max(p) + 99 AS hi FROM isle GROUP BY doc_id, r),
        piece AS (SELECT doc_id, lo AS pos, b[coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 : lo - 1] AS kept FROM run JOIN d USING (doc_id)
                  UNION ALL SELECT doc_id, n + 1, b[coalesce(final, 0) + 1 : n] FROM d LEFT JOIN (SELECT doc_id, max(hi) AS final FROM run GROUP BY doc_id) USING (doc_id)),
        rest AS (SELECT doc_id, sha256(unhex(string_agg(hex(kept), '' ORDER BY pos))) AS kept_sha256 FROM piece GROUP BY doc_id),
        lost AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
        FROM d JOIN rest USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    # CRC-32 bit by bit; nodes are known by their lists of turns.
    "op13_conversation_trie": """
        WITH own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
                     FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        taken AS (SELECT c, s, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[((ord(x) >> i) & 1)::BIGINT FOR i IN range(0, 8)] FOR x IN string_split(c::VARCHAR, '')])),
                         lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9)::INTEGER AS h FROM own),
        conv AS (SELECT t.c, list_concat(coalesce(o.s, [])[1 : h], t.s[h + 1 :]) AS s FROM taken AS t LEFT JOIN own AS o ON o.c = t.c - t.c % 5),
        reach AS (SELECT c, d, s[1 : d] AS k, d = len(s) AS over FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM conv)),
        node AS (SELECT k, d, min(c) AS c, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (over) AS ends FROM reach GROUP BY k, d),
        kid AS (SELECT k[1 : d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
        known AS (SELECT node.*, coalesce(kid.n, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (node.n - 1) * strlen(k[d].t) END AS saved FROM node LEFT JOIN kid USING (k)),
        up AS (SELECT k[1 : e] AS k, sum((kids = 0)::INTEGER) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY 1)
        SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves,
               CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
        FROM known AS a JOIN up USING (k) LEFT JOIN node AS p ON a.d > 0 AND p.k = a.k[1 : a.d - 1]""",
}
