"""One query per operator, over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from cohortwise.llm.registry import ORACLES, QUERIES, query, table
from cohortwise.llm import bpe, collocations, cotraining, extraction, licenses, mixing, ngram_join, quality_rules, simhash, token_counts, topk, url_filter, whitening

__all__ = ["ORACLES", "QUERIES"]

# The rules of the url query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op2_url_filter", sql=r"""
    WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
    rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    hit AS (SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(v, length(h) * 1000 + length(p)) AS verdict
            FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hit USING (page_id)""")
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    out = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_mixing")
def op1(spark, sf_dir):
    documents, _, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_top_k", sql="""
    WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM ok q JOIN ok d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op6(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, scale=1024)


@query("op5_token_counts")
def op5(spark, sf_dir):
    pieces = token_counts.read_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)


@query("op10_licenses")
def op10(spark, sf_dir):
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_notices", F.array_join("licenses", ",").alias("licenses"), F.to_json("notices").alias("notices"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return cotraining.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "text_score", "meta_score", "score", "kept")


@query("op4_html_text")
def op4(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op7_ngram_join")
def op7(spark, sf_dir):
    return ngram_join.group(table(spark, sf_dir, "documents"))


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    pieces = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_simhash")
def op11(spark, sf_dir):
    return simhash.group(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_collocations", sql=r"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) r(k) WHERE len(w) >= k),
    grams AS (SELECT lang, w[i:i + k - 1] AS ws, k, CAST(count(*) AS BIGINT) AS f FROM starts GROUP BY ALL HAVING count(*) >= 100),
    inner_starts AS (SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM grams, range(2, 5) r(j) WHERE j < k),
    around AS (SELECT lang, ws[i:i + j - 1] AS ws, max(f) AS around FROM inner_starts GROUP BY ALL),
    kept AS (SELECT g.* FROM grams g LEFT JOIN around o ON g.lang = o.lang AND g.ws = o.ws WHERE g.k > 1 AND (around IS NULL OR 100 * around < 100 * g.f)),
    cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
    scored AS (SELECT c.lang, c.ws, c.f AS a, x.f AS l, y.f AS r, n, cut, CAST((1000 * CAST(c.f AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
               FROM cuts c JOIN grams x ON x.lang = c.lang AND x.ws = c.ws[1:cut] JOIN grams y ON y.lang = c.lang AND y.ws = c.ws[cut + 1:] JOIN totals t ON t.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
    named AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM best)
    SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM named
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op13(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("pipeline", sql=corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
