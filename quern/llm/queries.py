"""The registered queries of the training-data operators, at production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversation_repair, embedding_dedup, language_id, media, mixing, ngram_join, quality, sentencepieces, sharding, substring_dedup, token_counts, token_files


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, files = token_files.write(docs, vocabulary("byte_bpe_50k.json"))
    return token_files.read(spark, out, files)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.new_dir(spark, "slot-map")
    version = sharding.store_map(sharding.build_map(sharding.slot_loads(sharding.records(docs)), 16), folder)
    placed = sharding.shard(docs, 16, slot_map=sharding.load_map(spark, folder, version))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media.described(media.load(spark, media.store(docs)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id.identify(docs, language_id.fit(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, quality.fit(docs, labels))


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentencepieces.digests(docs, vocabulary("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.summaries(conversation_repair.damaged(conversations))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.counted(docs, vocabulary("piece_bpe_32k.model"), 4096)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_ngram_join, op3_source_mix, op4_substring_dedup, op5_embedding_dedup, op6_sharding, op7_media, op8_language_id, op9_sentencepieces, op10_quality, op11_conversation_repair, op12_token_counts)}
#: SQL for the operators that it can express at a bearable cost on whole tables; the others decide by trained models,
#: tokenizer files, file formats or 64-bit hashes, and are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
        t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS o FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
        e AS (SELECT a, b FROM p WHERE 100 * o >= 90 * (total - o)),
        r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, (SELECT min(reached) FROM r WHERE node = doc_id) AS component_id FROM s""",
    "op3_source_mix": """
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS ord FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
        w AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, (SELECT sum(total) FROM s)::DOUBLE AS whole FROM s),
        c AS (SELECT *, whole - coalesce(sum(3.0::DOUBLE * total) OVER f, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS free FROM w WINDOW f AS (ORDER BY 3.0::DOUBLE * total / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT rest, free FROM c WHERE rest * weight / free <= 3.0::DOUBLE * total ORDER BY 3.0::DOUBLE * total / weight, place LIMIT 1),
        t AS (SELECT w.*, CASE WHEN l.rest * weight / l.free > 3.0::DOUBLE * total THEN 3.0::DOUBLE * total ELSE l.rest * weight / l.free END AS target, (total + 31) // 32 AS blocks FROM w, l),
        q AS (SELECT place, k FROM t, unnest(range(0, 3 * blocks)) u(k) ORDER BY target / (2 * k + 1) DESC, place, k LIMIT (SELECT CAST(sum(total) + 16 AS BIGINT) // 32 FROM s)),
        g AS (SELECT t.*, coalesce((SELECT count(*) FROM q WHERE q.place = t.place), 0) AS seats, greatest(1, (blocks + 63) // 64) AS per FROM t),
        r AS (SELECT place, seats, shard, least(per, blocks - shard * per) AS n FROM g, unnest(range(0, (blocks + per - 1) // per)) u(shard)),
        h AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard, k) AS nth, seats FROM r, unnest(range(0, 3 * n)) u(k)),
        o AS (SELECT r.place, r.shard, r.n, coalesce(m.quota, 0) AS quota, list_filter(range(greatest(1, CAST(round(n * 0.6180339887) AS BIGINT)), 2 * n + 2), lambda a: gcd(a, n) = 1)[1] AS step, (7919 + r.place * 104729 + r.shard * 1299709) % n AS shift
            FROM r LEFT JOIN (SELECT place, shard, count(*) AS quota FROM h WHERE nth <= seats GROUP BY 1, 2) m USING (place, shard)),
        b AS (SELECT place, shard, i, quota // n + CASE WHEN (step * i + shift) % n < quota % n THEN 1 ELSE 0 END AS times FROM o, unnest(range(0, n)) u(i)),
        p AS (SELECT d.*, g.place, g.per, g.total, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        x AS (SELECT doc_id, size, total, target, place, per, a, unnest(range(CAST(a // 32 AS BIGINT), CAST((a + size - 1) // 32 AS BIGINT) + 1)) AS j FROM p WHERE size > 0),
        y AS (SELECT x.doc_id, CAST(sum(times * (least(a + size, (j + 1) * 32) - greatest(a, j * 32))) AS BIGINT) AS taken FROM x JOIN b ON b.place = x.place AND b.shard = x.j // x.per AND b.i = x.j - (x.j // x.per) * x.per GROUP BY 1)
        SELECT p.doc_id, p.size, p.total AS source_size, p.target, coalesce(y.taken, 0) AS taken FROM p LEFT JOIN y USING (doc_id)""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
        c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
        SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        h AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda r, b: list_reduce(list_prepend(xor(r, b), CAST(range(8) AS BIGINT[])), lambda q, i: xor(q >> 1, 3988292384::BIGINT * (q & 1))), 4294967295::BIGINT)) % 20 AS d FROM c),
        f AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM h),
        o AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), nth) AS rn, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM f),
        p AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS dup, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) || i AS pair FROM o),
        g AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS trunc FROM p),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS dup, sum(trunc::INT) AS trunc, sum(CASE WHEN pair NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal, max(rn) AS len FROM g GROUP BY 1),
        v AS (SELECT DISTINCT conv_id, 0::BIGINT AS rn, {'c': 0::BIGINT, 'a': ''} AS n, {'c': 1000000000::BIGINT, 'a': ''} AS s, {'c': 2::BIGINT, 'a': 'I'} AS u, {'c': 4::BIGINT, 'a': 'II'} AS a FROM conversations
            UNION ALL SELECT conv_id, rn, n, s, u, least(a, {'c': u.c + 2, 'a': u.a || 'I'}) FROM (
                SELECT conv_id, rn, n, s, least(u, {'c': n.c + 2, 'a': n.a || 'I'}, {'c': s.c + 2, 'a': s.a || 'I'}, {'c': a.c + 2, 'a': a.a || 'I'}) AS u, a FROM (
                    SELECT conv_id, rn, {'c': n.c + 3, 'a': n.a || 'D'} AS n, least({'c': s.c + 3, 'a': s.a || 'D'}, {'c': n.c + e + CASE WHEN i = 's' THEN 0 ELSE 1000000000 END, 'a': n.a || 'K'}) AS s,
                        least({'c': u.c + 3, 'a': u.a || 'D'}, {'c': n.c + e + x, 'a': n.a || y}, {'c': s.c + e + x, 'a': s.a || y}, {'c': a.c + e + x, 'a': a.a || y}) AS u,
                        least({'c': a.c + 3, 'a': a.a || 'D'}, {'c': u.c + e + CASE WHEN i = 'a' THEN 0 ELSE 2 END, 'a': u.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END}) AS a FROM (
                        SELECT v.*, g.rn AS at, g.i, CASE WHEN g.blank OR g.dup THEN 1000000000 WHEN g.trunc THEN 1 ELSE 0 END AS e, CASE WHEN g.i = 'u' THEN 0 ELSE 2 END AS x, CASE WHEN g.i = 'u' THEN 'K' ELSE 'R' END AS y
                        FROM v JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND g.rn = v.rn + 1) t(conv_id, old, n, s, u, a, rn, i, e, x, y)) t1) t2),
        b AS (SELECT v.conv_id, CASE WHEN least(v.n, v.a) = v.n THEN v.n ELSE v.a END AS w FROM v LEFT JOIN n ON v.conv_id IS NOT DISTINCT FROM n.conv_id WHERE v.rn = coalesce(n.len, 0)),
        q AS (SELECT conv_id, w.a[z] AS op, z, len(replace(left(w.a, z), 'I', '')) AS rn, len(replace(left(w.a, z), 'D', '')) AS place FROM (SELECT conv_id, w, unnest(range(1, len(w.a) + 1)) AS z FROM b)),
        j AS (SELECT q.*, g.role, CASE WHEN op = 'I' THEN '' ELSE g.text END AS text, max(CASE WHEN op = 'K' AND g.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS sys FROM q LEFT JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.rn = g.rn),
        r AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY z) AS whole FROM j WHERE op <> 'D' GROUP BY 1)
        SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(dup, 0) AS BIGINT) AS duplicate, CAST(coalesce(trunc, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
            b.w.c AS cost, b.w.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM b LEFT JOIN n ON b.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id""",
}
