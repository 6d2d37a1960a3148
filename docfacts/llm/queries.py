"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    chat_format,
    decontaminate,
    exact_dedup,
    hard_negatives,
    html_extract,
    language_id,
    license_scan,
    packing,
    quality_cnn,
    quality_rules,
    sharding,
    simhash,
)
from .common import id_fold, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_fold(F.col("doc_id"), 5) == 0
    net = quality_cnn.fit(documents, labels.where(~held))
    p = F.col("score")
    return quality_cnn.score(documents, net).select(
        "doc_id", held.alias("held_out"), "score", (p >= 0.3).cast("int").alias("predicted")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = id_fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(documents.where(~held))
    return language_id.predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def tokenizer_path() -> str:
    """Where the public vocabulary lies; every machine has it installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        n.alias("turn"),
        F.when(n == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_chats(rows)
    back = chat_format.read_back(made)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_fault",
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judge(documents, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), vec_id % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, seed="2:").drop("n_verified")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), largest=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_sharding,
        op3_language_id,
        op4_simhash_near_dedup,
        op5_decontamination,
        op6_packing,
        op7_license_scan,
        op8_html_extraction,
        op9_chat_formatting,
        op10_quality_rules,
        op11_hard_negatives,
        op12_centroid_clustering,
        op13_exact_dedup,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _escaped(column: str) -> str:
    t = chat_format.Template()
    out = f"replace({column}, '{t.escape}', '{t.escape * 2}')"
    for c in t.controls:
        out = f"replace({out}, '{c}', '{c[0] + t.escape + c[1:]}')"
    return out


def _moves() -> str:
    """The machine's moves, each as 'state>role'; its states but the first are named after the role that leads there."""
    return ", ".join(f"'{state}>{role}'" for state, by in chat_format.Template().machine.items() for role in by)


#: Embeddings whose components are all there and finite, as whole numbers.
_WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""


def _clustered(rounds: int) -> str:
    """Rounds of assignment (a<r>) and floored means (c<r>), one after the other."""
    steps = [
        f"""v AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ({_WHOLE}) WHERE len(v) = 64),
        c0 AS (SELECT c, i, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v)) USING (vec_id) WHERE c < 40)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS (SELECT vec_id, min(c) AS cluster, min(d) AS distance FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS low FROM (
        SELECT vec_id, c, sum((v.x - c{r}.x) * (v.x - c{r}.x)) AS d FROM v JOIN c{r} USING (i) GROUP BY vec_id, c)) WHERE d = low GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS (SELECT c, i, coalesce(m, x) AS x FROM c{r} LEFT JOIN (SELECT cluster AS c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM v JOIN a{r} USING (vec_id) GROUP BY cluster, i) USING (c, i))"""
            )
    return f"""WITH {", ".join(steps)}, named AS (SELECT c AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN named USING (cluster)"""


ORACLE: dict[str, str] = {
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least({decontaminate.WINDOW}, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - {decontaminate.WINDOW}, 0) + 2), lambda i: array_to_string(w[i:i + {decontaminate.WINDOW - 1}], ' '))) AS g FROM b WHERE len(w) > 0),
        places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        hit AS (SELECT doc_id, p, n, item FROM places JOIN win USING (n, g)),
        cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM c),
        m AS (SELECT conv_id, i, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 'start') || '>' || role AS move FROM n),
        f AS (SELECT conv_id, CAST(min(i) AS INTEGER) AS first_fault FROM m WHERE move NOT IN ({_moves()}) GROUP BY conv_id),
        d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length('{"".join((chat_format.Template().turn, chat_format.Template().text, chat_format.Template().end))}') + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
        SELECT d.*, first_fault IS NULL AS valid, first_fault FROM d LEFT JOIN f USING (conv_id)""",
    "op11_hard_negatives": f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM ({_WHOLE}) WHERE label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""",
    "op12_centroid_clustering": _clustered(5),
    "op13_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256({_LOW}) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY {_LOW})""",
}
