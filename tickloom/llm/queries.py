"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held_out, shared_dir, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import predict, train

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "rejected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import predict, train

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("held_out", held_out(F.col("doc_id"), 4))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import predict, train

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("held_out", held_out(F.col("doc_id"), 4))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import DigestIndex

    index = DigestIndex(spark, shared_dir(spark, "digest-index"))
    return index.dedup(table(spark, sf_dir, "documents")).drop("row_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import read_shards, write_shards

    out = shared_dir(spark, "token-shards")
    totals = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    return read_shards(spark, out, totals).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clusters_with_sums

    return clusters_with_sums(table(spark, sf_dir, "embeddings"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import round_trip

    coded = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)  # noqa: E731
    return coded.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("text").alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    near = """a{r} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
  SELECT rid, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r}) GROUP BY rid)"""
    move = """s{r} AS (SELECT cluster, j.range AS j, sum(v[j.range]) AS s, count(*) AS n FROM kept JOIN a{r} USING (rid), range(1, 65) j GROUP BY ALL),
c{q} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY cluster) m USING (cluster))"""
    steps = [near.format(r=r) + ",\n" + move.format(r=r, q=r + 1) for r in range(rounds)] + [near.format(r=rounds)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, vec_id) - 1 AS INT) AS cluster, v AS c
  FROM (SELECT *, sha256('3:' || vec_id) AS h FROM kept ORDER BY h, vec_id LIMIT {k})),
{(","+chr(10)).join(steps)}
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} USING (cluster)"""


def _op13_sql() -> str:
    add = lambda x, cost, letter, line=None: (  # noqa: E731
        f"CASE WHEN {x} IS NOT NULL THEN {{'cost': {x}.cost + {cost}, 'audit': {x}.audit || '{letter}', 'lines': "
        + (f"list_append({x}.lines, {line})" if line else f"{x}.lines")
        + "} END"
    )
    inserted = [
        "c0 AS e0", "c1 AS e1", f"least(c2, {', '.join(add(c, 5, 'I', chr(39) + 'user:' + chr(39)) for c in ('c0', 'c1', 'c3'))}) AS e2", f"least(c3, {add('c2', 5, 'I', chr(39) + 'assistant:' + chr(39))}) AS e3",
    ]  # fmt: skip

    def ways(to: int, froms: tuple[int, ...], initial: str, role: str) -> str:
        kept = [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(f'e{s}', 'more', 'K', 'role || chr(58) || text')} END" for s in froms]
        other = [f"CASE WHEN NOT gone THEN {add(f'e{s}', '1 + more', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END" for s in froms] if role else []
        return f"least({', '.join([add(f'e{to}', 2, 'D'), *kept, *other])}) AS c{to}"

    step = ", ".join([f"{add('e0', 2, 'D')} AS c0", ways(1, (0,), "s", ""), ways(2, (0, 1, 3), "u", "user"), ways(3, (2,), "a", "assistant")])
    return rf"""WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k0, tbl),
d AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '-') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen,
  right(regexp_replace(text, '[ 	-]+$', ''), 1) NOT IN ('.', '!', '?') AS cut, left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS two FROM o),
g AS MATERIALIZED (SELECT *, blank OR seen AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM f),
n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
  count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM g GROUP BY conv),
dp AS (SELECT conv, CAST(0 AS BIGINT) AS i, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS c0,
  CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR[])) AS c1, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR[])) AS c2, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR[])) AS c3 FROM n
  UNION ALL SELECT conv, i, {step} FROM (SELECT dp.conv, g.i, initial, role, text, gone, more, {', '.join(inserted)} FROM dp JOIN g ON g.conv = dp.conv AND g.i = dp.i + 1)),
e AS (SELECT conv, least(e0, e3) AS best FROM (SELECT dp.conv, {', '.join(inserted)} FROM dp JOIN n ON n.conv = dp.conv AND n.last = dp.i)),
w AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS conv FROM conversations)
SELECT conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM w LEFT JOIN n USING (conv) LEFT JOIN e USING (conv)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_score": op1_lm_score, "op2_language_id": op2_language_id, "op3_toxicity": op3_toxicity, "op4_quality": op4_quality, "op5_bpe": op5_bpe, "op6_exact_dedup": op6_exact_dedup, "op7_token_output": op7_token_output, "op8_mixing": op8_mixing, "op9_minhash_dedup": op9_minhash_dedup, "op10_embedding_dedup": op10_embedding_dedup, "op11_centroids": op11_centroids, "op12_piece_bpe": op12_piece_bpe, "op13_conversation_repair": op13_conversation_repair}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op11_centroids": _op11_sql(), "op13_conversation_repair": _op13_sql()}
