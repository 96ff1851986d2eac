"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import embedding_dedup, exact_dedup, filter_audit, language_id, mixing, nearest, packing, quality, ranked_search, sharding, simhash, substring_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.tokenised_pieces(docs)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, packing.pack_groups(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(_table(spark, sf_dir, "labels"))
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.quality_scores(docs, quality.train(docs, labels))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_nearest": op6_nearest,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_sharding": op10_sharding,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_filter_audit": op13_filter_audit,
}

_NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
        FROM (SELECT doc_id, {_NORMALISED} AS content FROM documents)
        WINDOW same AS (PARTITION BY content)
    """,
    "op5_mixing": r"""
        WITH weights AS (
          SELECT doc_id, min(CASE WHEN quality = 0 THEN 0.25::DOUBLE ELSE 1 END) AS w FROM labels GROUP BY doc_id),
        docs AS (
          SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            -ln((CAST('0x' || substr(md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE)
              / 4503599627370496::DOUBLE) / coalesce(w.w, 1) AS k
          FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
        sources AS (
          SELECT source, CAST(sum(size) AS DOUBLE) AS s, 2.0::DOUBLE * sum(size) AS cap,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w
          FROM docs GROUP BY source),
        levels AS (
          SELECT *, (sum(s) OVER () * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
            row_number() OVER t AS turn
          FROM sources WINDOW t AS (ORDER BY cap / w, source NULLS LAST)),
        targets AS (
          SELECT source, s, coalesce(least(cap, w * (SELECT arg_min(level, turn) FROM levels WHERE level <= cap / w)), cap) AS target
          FROM levels),
        budgets AS (
          SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS epochs FROM targets),
        ordered AS (
          SELECT d.*, b.s, b.target, b.epochs, b.target - b.epochs * b.s AS budget,
            sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS to_here
          FROM docs d JOIN budgets b ON b.source IS NOT DISTINCT FROM d.source),
        placed AS (
          SELECT *, to_here <= budget AS chosen,
            budget - coalesce(max(CASE WHEN to_here <= budget THEN to_here END) OVER (PARTITION BY source), 0) AS missing
          FROM ordered),
        extra AS (
          SELECT arg_min(doc_id, (abs(missing - size), k, doc_id)) AS doc_id FROM placed
          WHERE NOT chosen AND abs(missing - size) < missing GROUP BY source)
        SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
          (epochs + CASE WHEN chosen OR doc_id IN (SELECT doc_id FROM extra) THEN 1 ELSE 0 END) * size AS taken
        FROM placed
    """,
    "op12_ranked_search": r"""
        WITH docs AS (
          SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
          SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        asked AS (SELECT item, item_id, term, count(*) AS times FROM items GROUP BY item, item_id, term),
        totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM docs WHERE len(w) > 0),
        held AS (
          SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM docs)
          WHERE term IN (SELECT term FROM asked) GROUP BY doc, doc_id, n, term),
        weights AS (
          SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
        scored AS (
          SELECT item, item_id, doc, doc_id,
            CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
          FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item, item_id, doc, doc_id),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op13_filter_audit": r"""
        WITH texts AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        words AS (
          SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
        flags AS (
          SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
        failed AS (
          SELECT w.part, coalesce(f.good, 0) AS good, coalesce(f.toxic, 0) AS toxic,
            (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
            + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS fails
          FROM words w LEFT JOIN flags f ON f.doc_id = w.doc_id),
        sets AS (
          SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
        letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
        orders AS (
          SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
          FROM letters a, letters b, letters c, letters d, letters e
          WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (
          SELECT o.filter_order, s.step, l.letter, l.bit,
            (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE position(p.letter IN o.filter_order) < s.step) AS before
          FROM orders o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s, letters l
          WHERE l.letter = substr(o.filter_order, s.step, 1)),
        counted AS (
          SELECT part, filter_order, step, letter,
            sum(CASE WHEN (fails & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN (fails & before) = 0 AND (fails & bit) > 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN (fails & before) > 0 AND (fails & bit) > 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN (fails & before) = 0 AND (fails & bit) > 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN (fails & before) = 0 AND (fails & bit) > 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM (SELECT filter_order, CAST(step AS INTEGER) AS step, letter, CAST(bit AS INTEGER) AS bit,
                  CAST(before AS INTEGER) AS before FROM steps), sets
          GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
          CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
          CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
          CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM counted
    """,
}
