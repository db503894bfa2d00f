"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_warc_revisit(spark, sf_dir):
    from .warc_revisit import captures, resolve_revisits

    out = resolve_revisits(captures(_pages(spark, sf_dir)))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "canonical", "ts", "kind", "refers_to", "status", "digest", F.array_join(lines, "|").alias("headers"))


OP1_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS h, unnest(range(0, page_id % 4 + 1)) AS k FROM pages
), cap AS (
  SELECT page_id * 4 + k AS record_id, page_id % 1000 * 60 + k * 40000 AS ts, k, h,
    CASE WHEN k IN (0, 3) THEN 'response' ELSE 'revisit' END AS kind,
    CASE WHEN k IN (0, 1, 3) THEN 'W/' || h WHEN k = 2 AND page_id % 3 = 0 THEN 'stale' END AS etag,
    CASE WHEN k <> 1 THEN 'v' || (page_id % 7) END AS modified,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#(.|\n)*$', '') AS rest
  FROM base
), canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS left_part,
    regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '', 'g'), '^&', '') AS query
  FROM cap
), c AS (
  SELECT *, left_part || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM canon
), near AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'modified': modified, 'h': h, 'k': k} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM c
), s AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN f IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN modified = f.modified THEN 'resolved' ELSE 'mismatch' END AS status FROM near
)
SELECT record_id, canonical, ts, kind, CASE WHEN status IN ('resolved', 'mismatch') THEN f.id END AS refers_to, status,
  CASE status WHEN 'full' THEN h WHEN 'resolved' THEN f.h END AS digest,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html|date: ' || ts || '|etag: ' || coalesce(etag, f.etag) || '|last-modified: ' || f.modified || '|server: s' || f.k
    ELSE CASE WHEN kind = 'response' THEN 'content-type: text/html|' ELSE '' END || 'date: ' || ts || CASE WHEN etag IS NOT NULL THEN '|etag: ' || etag ELSE '' END
      || CASE WHEN modified IS NOT NULL THEN '|last-modified: ' || modified ELSE '' END || '|server: s' || k END AS headers
FROM s
"""


def op3_mixing(spark, sf_dir):
    from .mixing import mix_plan

    plan = mix_plan(_docs(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op8_url_filter(spark, sf_dir):
    from .url_filter import url_filter

    return url_filter(_pages(spark, sf_dir))


def op9_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op10_token_store(spark, sf_dir):
    import public_tokenizers

    from .token_store import token_store

    return token_store(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_warc_revisit, op3_mixing, op8_url_filter, op9_exact_dedup, op10_token_store)}
SQL = {"op1_warc_revisit": OP1_SQL, "op9_exact_dedup": OP9_SQL}


def op7_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_join

    return jaccard_join(_docs(spark, sf_dir), words=4, num=85, den=100)


QUERIES["op7_jaccard_join"] = op7_jaccard_join


def op2_quality(spark, sf_dir):
    from .quality import quality

    return quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES |= {"op2_quality": op2_quality, "op4_toxicity": op4_toxicity}


def op5_substring_dedup(spark, sf_dir):
    from .substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


def op6_decontamination(spark, sf_dir):
    from .decontam import decontaminate

    return decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES |= {"op5_substring_dedup": op5_substring_dedup, "op6_decontamination": op6_decontamination}


def op11_ngram_quality(spark, sf_dir):
    from .ngram_quality import quality_rules

    return quality_rules(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_whitening(spark, sf_dir):
    from .whitening import whiten

    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))  # null beyond a long


def op13_fill_in_middle(spark, sf_dir):
    from .fill_middle import fill_in_middle, restored

    out = fill_in_middle(_docs(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), d AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::bigint % (len(units) + 1) AS i, ('0x' || h[9:16])::bigint % (len(units) + 1) AS j, ('0x' || h[17:24])::bigint % 100 AS h3, ('0x' || h[25:32])::bigint % 100 AS h4 FROM t
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(i, j)], '') AS prefix, array_to_string(units[least(i, j) + 1:greatest(i, j)], '') AS middle, array_to_string(units[greatest(i, j) + 1:], '') AS suffix FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""

QUERIES |= {"op11_ngram_quality": op11_ngram_quality, "op12_whitening": op12_whitening, "op13_fill_in_middle": op13_fill_in_middle}
SQL["op13_fill_in_middle"] = OP13_SQL
