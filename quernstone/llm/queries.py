"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import align, bpe, lm, mih, mixing, phrases, pii, quality, simhash, substring, tokenfile, topk, urls
from quernstone.llm.blocks import usable
from quernstone.llm.ship import workers_see_package
from quernstone.plans.registry import Plans, table

PLANS = Plans()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see_package(spark)
    return table(spark, sf_dir, "documents")


@PLANS.add(None)
def op1_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


@PLANS.add(None)
def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@PLANS.add(None)
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.find(documents(spark, sf_dir)))


@PLANS.add(None)
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN))


@PLANS.add(None)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see_package(spark)
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


@PLANS.add(None)
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shards, _ = tokenfile.token_file(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_tokens(docs.schema["doc_id"].dataType.simpleString(), shards)


@PLANS.add(None)
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see_package(spark)
    vectors = usable(table(spark, sf_dir, "embeddings")).filter(F.exists("v", lambda x: x != 0))
    return mih.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@PLANS.add(None)
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@PLANS.add(None)
def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = quality.in_fold(F.col("doc_id"), quality.FOLDS, 0).alias("held_out")
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out, "score", predicted)


@PLANS.add(None)
def op10_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.in_fold(F.col("doc_id"), 7, 2)
    scored = lm.score(documents(spark, sf_dir).withColumn("train", ~held_out))
    rest = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), *rest)


@PLANS.add(
    r"""
    WITH texts AS (
        SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    ),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
    tokens AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
    ),
    runs AS (
        SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS w
        FROM tokens, range(1, 4) AS lengths(m)
    ),
    counts AS (
        SELECT lang, m, w, array_to_string(w, ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL
    ),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
    candidates AS (SELECT lang, m, w, phrase, f AS a FROM counts WHERE m >= 2 AND f >= 10),
    cuts AS (SELECT lang, m, w, phrase, a, unnest(range(1, m)) AS k FROM candidates),
    scored AS (
        SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r,
               ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM cuts c
        JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
        JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
    ),
    best AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ),
    around AS (
        SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE m = 3
            UNION ALL
            SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM candidates WHERE m = 3
        ) GROUP BY lang, phrase
    ),
    ranked AS (
        SELECT best.lang, best.phrase, a, l, r, score,
               row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
        FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase
        WHERE longer IS NULL OR 100 * longer < 50 * a
    )
    SELECT ranked.lang, rank, phrase, a, l, r, n, score
    FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
    """
)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


@PLANS.add(None)
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.alignments(documents(spark, sf_dir), path_a, path_b)


@PLANS.add(
    """
    WITH split AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ),
    rules(verdict, rule_host, rule_path) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
               ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ),
    fits AS (
        SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM split, rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id
    )
    SELECT split.page_id, host, path, rule,
           CASE WHEN rule IS NOT NULL THEN fits.verdict
                WHEN host = '' OR host LIKE '%casino%' OR host LIKE '%-bets.%' THEN 'block'
                WHEN regexp_matches(host || path, '(?s)\\.(jpg|png|gif|css|js|mp4|zip|exe)$') THEN 'block'
                WHEN path LIKE '/%login' OR path LIKE '/%login/%' THEN 'block'
                WHEN starts_with(path, '/wp-admin/') OR starts_with(path, '/cgi-bin/') THEN 'block'
                ELSE 'allow' END AS verdict
    FROM split LEFT JOIN fits ON split.page_id = fits.page_id
    """
)
def op13_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see_package(spark)
    return urls.judge(table(spark, sf_dir, "pages"))
