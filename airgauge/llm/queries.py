"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgauge.llm import (
    blocks,
    centroids,
    compression,
    cover_tree,
    decontaminate,
    hilbert,
    language,
    license_templates,
    licenses,
    ngram_join,
    packing,
    suffix_tree,
    warc,
    whitening,
)
from airgauge.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_path() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query(
    "op7_cover_tree",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
          FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
                 vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5
    """,
)
def cover_tree_query(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.top_inner_products(_table(spark, folder, "embeddings"))


@_query("op8_token_files")
def token_files_query(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.token_digests(_table(spark, folder, "documents"), tokenizer_path())


@_query("op2_hilbert_shards")
def hilbert_query(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.shard_documents(_table(spark, folder, "documents")).withColumn(
        "grown_shard", F.lit(None).cast("int")
    )


_TEMPLATE_ROWS = ", ".join(
    "('{}', '{}')".format(name.replace("'", "''"), text.replace("'", "''")) for name, text in license_templates.templates().items()
)
_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@_query(
    "op3_license_scan",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
    templates AS (SELECT name, {_WORDS.format("wording")} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(name, wording)),
    template_grams AS (SELECT DISTINCT name, w[i] || ' ' || w[i + 1] AS gram
        FROM (SELECT name, w, unnest(range(1, len(w))) AS i FROM templates)),
    sizes AS (SELECT name, count(*) AS b, any_value(len(w) - 1) AS span FROM template_grams JOIN templates USING (name) GROUP BY name),
    hits AS (SELECT doc_id, i, name FROM grams JOIN template_grams USING (gram)),
    windows AS (SELECT doc_id, name, i, b, span,
            count(*) OVER (PARTITION BY doc_id, name ORDER BY i RANGE BETWEEN CURRENT ROW AND (span - 1) FOLLOWING) AS shared
        FROM hits JOIN sizes USING (name)),
    candidates AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY shared DESC, i) = 1
        AND shared * 12 >= 8 * b),
    inside AS (SELECT DISTINCT c.doc_id, c.name, c.i, c.b, g.gram FROM candidates c JOIN grams g
        ON g.doc_id = c.doc_id AND g.i BETWEEN c.i AND c.i + c.span - 1),
    good AS (SELECT doc_id, name, i, count(t.gram) AS common, count(*) + any_value(b) AS total
        FROM inside s LEFT JOIN template_grams t USING (name, gram) GROUP BY doc_id, name, i
        HAVING 20 * count(t.gram) >= 8 * (count(*) + any_value(b))),
    best AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY common / total DESC, total DESC, name) = 1),
    compared AS (SELECT doc_id, count(*) AS n FROM candidates GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS compared, string_split(name, ' ')[1] AS license, name AS template, common, total,
        CAST(i - 1 AS BIGINT) AS word
    FROM d LEFT JOIN compared c ON c.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id
    """,
)
def license_query(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_table(spark, folder, "documents"))


@_query(
    "op4_ngram_join",
    """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle)
              WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * common >= 90 * (x.n + y.n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
)
def ngram_join_query(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.linked_documents(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query(
    "op5_decontamination",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    p AS (SELECT item, least(len(w), 10) AS size, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
          FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM p),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    hits AS (SELECT doc_id, i, s.size, item FROM places JOIN (SELECT DISTINCT size FROM windows) s ON i + s.size - 1 <= len(w)
             JOIN windows x ON x.size = s.size AND x.phrase = array_to_string(w[i : i + s.size - 1], ' ')),
    hit_words AS (SELECT doc_id, count(DISTINCT k) AS n FROM
                  (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(a.n, 0) AS n_hit, coalesce(c.n, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(a.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words a ON d.doc_id = a.doc_id LEFT JOIN hit_items c ON d.doc_id = c.doc_id
    """,
)
def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op6_language")
def language_query(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


@_query("op9_suffix_tree")
def suffix_tree_query(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.suffix_scores(_table(spark, folder, "documents"))


@_query(
    "op10_warc",
    """
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, s.payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
    FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
          FROM pages) p
    JOIN (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0b' || substr(bits, 5 * k + 1, 5) AS INT) AS INT) + 1, 1), '' ORDER BY k) AS payload_digest
          FROM (SELECT hex, bits, unnest(range(32)) AS k FROM
                (SELECT hex, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111',
                        4 * (position(substr(hex, i, 1) IN '0123456789abcdef') - 1) + 1, 4), '' ORDER BY i) AS bits
                 FROM (SELECT hex, unnest(range(1, 41)) AS i FROM (SELECT DISTINCT sha1(coalesce(html, '')) AS hex FROM pages))
                 GROUP BY hex))
          GROUP BY hex) s ON s.hex = p.hex
    """,
)
def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archived(_table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op11_whitening")
def whitening_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whitened(_table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@_query("op12_compression")
def compression_query(spark: SparkSession, folder: str) -> DataFrame:
    return compression.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def _clusters_sql() -> str:
    """One step a round: the nearest centroid of every vector, then the floors of the means."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id,
        list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT k, e FROM (SELECT e, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM v)
        WHERE k < 8)""",
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT place, vec_id, e, k, d FROM (SELECT place, vec_id, v.e, k,
            list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS d FROM v CROSS JOIN c{i} c)
            QUALIFY row_number() OVER (PARTITION BY place ORDER BY d, k) = 1)"""
        )
        if i < centroids.ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN
                (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM
                (SELECT k, i, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM
                (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m ON m.k = c.k)"""
            )
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(a.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
        CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{centroids.ROUNDS} a JOIN c{centroids.ROUNDS} c ON c.k = a.k"""


@_query("op13_centroids", _clusters_sql())
def centroids_query(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(_table(spark, folder, "embeddings"))
