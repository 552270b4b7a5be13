"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _list_entries(pages: DataFrame) -> DataFrame:
    """A dated list, made by a rule from the hosts and paths that the pages have (no table holds one)."""
    from . import url_filter

    url = F.col("url")
    named = pages.select(url_filter.host(url).alias("key")).union(pages.select(url_filter.path_key(url))).filter("key <> ''").distinct()
    n = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long")
    named = named.select("key", n.alias("n"), (n % 300).alias("at")).filter("n % 4 = 0")
    steps = [("add", F.col("at"), F.lit(True)), ("remove", F.col("at") + 20 + F.col("n") % 90, F.col("n") % 3 != 0), ("add", F.col("at") + 150, F.col("n") % 5 == 0)]
    parts = [named.filter(when).select("key", F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("day")) for action, day, when in steps]
    return parts[0].union(parts[1]).union(parts[2])


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    pages = common.read(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 365).cast("int"))
    listed = common.written(url_filter.intervals(_list_entries(pages)), "intervals")
    return url_filter.evaluate(pages.select("page_id", "url", day.alias("day")), listed)


OP1_SQL = r"""
WITH pages_ AS (
  SELECT page_id, lower(url) AS url, DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INTEGER) AS day,
         rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment FROM pages),
named AS (
  SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS n FROM (
    SELECT host AS key FROM pages_ UNION SELECT host || '/' || segment FROM pages_ WHERE segment <> '' AND host <> '')
  WHERE key <> ''),
chosen AS (SELECT key, n, n % 300 AS d0 FROM named WHERE n % 4 = 0),
entries AS (
  SELECT key, 'add' AS action, d0 AS d FROM chosen
  UNION ALL SELECT key, 'remove', d0 + 20 + n % 90 FROM chosen WHERE n % 3 <> 0
  UNION ALL SELECT key, 'add', d0 + 150 FROM chosen WHERE n % 5 = 0),
steps AS (SELECT key, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS since,
                 lead(DATE '2024-01-01' + CAST(d AS INTEGER)) OVER (PARTITION BY key ORDER BY d, action) AS until FROM entries),
intervals AS (SELECT key, since, until FROM steps WHERE action = 'add' AND (until IS NULL OR until > since)),
labels AS (SELECT page_id, day, host, segment, string_split(host, '.') AS l FROM pages_ WHERE host <> ''),
asked AS (
  SELECT DISTINCT page_id, day, key FROM (
    SELECT page_id, day, unnest(CASE WHEN len(l) >= 2 THEN list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) ELSE [host] END) AS key FROM labels
    UNION ALL SELECT page_id, day, host || '/' || segment FROM labels WHERE segment <> '')),
found AS (
  SELECT page_id, count(*) AS n, min(a.key) AS first_key FROM asked a JOIN intervals i
  ON a.key = i.key AND a.day >= i.since AND (i.until IS NULL OR a.day < i.until) GROUP BY page_id)
SELECT p.page_id, p.day, p.host, coalesce(n, 0) AS n_active, first_key, coalesce(n, 0) > 0 AS blocked
FROM pages_ p LEFT JOIN found USING (page_id)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(common.read(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.overlaps(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), window=13, least=0.8)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = common.read(spark, sf_dir, "documents")
    labels = common.read(spark, sf_dir, "labels").filter(common.fold(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(common.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.extract(common.read(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(k):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")

    base = F.filter("spans", lambda x: x["base"])
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    rows = ann.valid(common.read(spark, sf_dir, "embeddings"))
    return ann.search(rows, F.col("id") % 50 == 0, ann.fit(rows, k=5), k=5)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    folder = common.new_path(spark, "sequences")
    shards = token_files.write(common.read(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(spark, folder, shards)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spm

    coded = spm.encode_decode(common.read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    cleaned = line_dedup.remove_spread_lines(common.read(spark, sf_dir, "documents"), min_sites=10)
    return cleaned.select("doc_id", "text")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    docs = common.read(spark, sf_dir, "documents")
    rest = common.fold(F.col("doc_id"), 7)
    model, numbered = lm.fit(docs, rest != 2, order=3, least=1)
    return lm.score(numbered, model).select(
        "doc_id",
        F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fim

    made = fim.transform(common.read(spark, sf_dir, "documents"), seed=7, share=100, spm=50)
    return fim.restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    counted = token_counts.count(common.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_chunks")


OP9_SQL = """
WITH split AS (
  SELECT doc_id, source, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
spread AS (
  SELECT line FROM split WHERE trim(line, ' ') <> '' AND source IS NOT NULL
  GROUP BY line HAVING count(DISTINCT source) >= 10 AND count(DISTINCT whole) >= 10),
cleaned AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (SELECT line FROM spread)) AS text
  FROM split GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

OP11_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS s, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sized AS (
  SELECT *, len(s) - 1 AS breaks, len(s) - (s[-1] = '')::INTEGER AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
ends AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM sized),
places AS (
  SELECT *, CASE WHEN a = 0 THEN 0 WHEN a <= breaks THEN length(array_to_string(s[1:a], chr(10))) + 1 ELSE length(t) END AS x,
            CASE WHEN b = 0 THEN 0 WHEN b <= breaks THEN length(array_to_string(s[1:b], chr(10))) + 1 ELSE length(t) END AS y FROM ends),
formed AS (
  SELECT *, CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         substr(t, 1, x) AS prefix, substr(t, x + 1, y - x) AS middle, substr(t, y + 1) AS suffix FROM places)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_multi_index_hashing": op6_multi_index_hashing,
    "op7_token_files": op7_token_files,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
}

ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op9_line_dedup": OP9_SQL, "op11_fill_in_middle": OP11_SQL}
