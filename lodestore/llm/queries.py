"""Queries of the ten operators, each over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, flac, jaccard_join, language, pieces, pii, quality, secrets, sharding, url_templates
from ._common import UNSPACED, table

_GAP, _TOKEN = r"[^\p{L}\p{M}\p{N}]+", r"[\p{L}\p{M}\p{N}]+"
#: A text with this mark around the letters of unspaced scripts, so that each is a token; it is taken out again.
_MARK = "\ue000"
_APART = f"regexp_replace(text, '([{''.join(f'\\x{{{a:x}}}-\\x{{{b:x}}}' for a, b in UNSPACED)}])', '{_MARK}\\1{_MARK}', 'g')"


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCM blocks of the clips made of all vectors, encoded as FLAC and decoded again; pcm in hexadecimal."""
    media = flac.clips(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = flac.blocks(media, "vec_id")
    return found.select("vec_id", "block", "first_sample", "n_samples", "channels", "sample_rate", "bits", "ok", "md5_ok", F.hex("pcm").alias("pcm"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of the documents, by their place and test results."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and the shard of each document."""
    return sharding.place(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of each document, checked against the library and decoded again."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's mixture of languages."""
    return language.identify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the benchmark's passages."""
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, good): the quality label of the document whose number the page's URL ends with."""
    number = F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]+/(\d+)", 1).try_cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", number.alias("doc_id"))
    return pages.join(table(spark, sf_dir, "labels"), "doc_id").select("page_id", F.col("quality").alias("good"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path template of each page, its purity and whether it is rejected."""
    return url_templates.templates(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decisions of the quality classifier for each document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its personal data masked."""
    return pii.redact(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class and number of links, where a link is a word 3-gram Jaccard similarity of at least 0.5."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower({_APART}), '{_TOKEN}') AS w FROM documents WHERE doc_id IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {jaccard_join.N}
    THEN list_transform(range(1, len(w) - {jaccard_join.N} + 2), lambda i: array_to_string(w[i:i + {jaccard_join.N} - 1], ' '))
    ELSE [array_to_string(w, ' ')] END) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT doc_a, doc_b FROM overlap JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
  WHERE c / (x.n + y.n - c)::DOUBLE >= {jaccard_join.THRESHOLD} - 1e-12
), links AS (SELECT doc_a AS a, doc_b AS b FROM pairs UNION SELECT doc_b, doc_a FROM pairs
), reach AS (SELECT DISTINCT a AS doc_id, a AS low FROM links UNION SELECT b, low FROM reach JOIN links ON a = doc_id
), counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
), lows AS (SELECT doc_id, min(low) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN lows USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac": op1_flac,
    "op2_secret_scans": op2_secret_scans,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_decontamination": op6_decontamination,
    "op7_url_templates": op7_url_templates,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_jaccard_join": op10_jaccard_join,
}

_NEED = f"least({decontaminate.LENGTH}, greatest({decontaminate.LEAST}, ceil({decontaminate.COVERAGE} * len(w) - 1e-9)))::INT"

OP6_SQL = rf"""
WITH items AS (
  SELECT DISTINCT regexp_extract_all(lower({_APART}), '{_TOKEN}') AS w FROM benchmark WHERE text IS NOT NULL
), keyed AS (SELECT w, {_NEED} AS k FROM items WHERE len(w) >= {decontaminate.LEAST}
), keys AS (
  SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM keyed
), words AS (
  SELECT doc_id, regexp_extract_all(lower({_APART}), '{_TOKEN}') AS w FROM documents
), places AS (
  SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words CROSS JOIN (SELECT DISTINCT k FROM keys) WHERE len(w) >= k
), hits AS (
  SELECT p.doc_id, p.i, p.k FROM places p JOIN keys ON keys.k = p.k AND keys.g = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')
), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM hits
), pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all({_APART}, '{_TOKEN}|{_GAP}') AS p FROM documents)
), numbered AS (
  SELECT doc_id, pos, piece, regexp_full_match(piece, '{_TOKEN}') AS is_word,
    count(*) FILTER (WHERE regexp_full_match(piece, '{_TOKEN}')) OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM pieces
), kept AS (
  SELECT n.doc_id, string_agg(piece, '' ORDER BY pos) FILTER (
    WHERE NOT ((is_word AND a.i IS NOT NULL) OR (NOT is_word AND a.i IS NOT NULL AND b.i IS NOT NULL))) AS text
  FROM numbered n LEFT JOIN covered a ON a.doc_id = n.doc_id AND a.i = n.i LEFT JOIN covered b ON b.doc_id = n.doc_id AND b.i = n.i + 1
  GROUP BY n.doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE step IS DISTINCT FROM 1) AS n_spans
  FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM covered) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) <= {decontaminate.DOCUMENT} * coalesce(len(w), 0) THEN coalesce(replace(kept.text, '{_MARK}', ''), CASE WHEN d.text IS NOT NULL THEN '' END) END AS text,
  coalesce(len(w), 0)::BIGINT AS n_tokens, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  coalesce(n_removed, 0) > {decontaminate.DOCUMENT} * coalesce(len(w), 0) AS dropped
FROM documents d JOIN words USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

_HEX = "('0x' || substr(md5({}), 1, 15))::BIGINT"

#: Each turn of the table's filling is a row of the recursion: the shard in turn claims its first free slot.
OP3_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, {_HEX.format("'offset:' || name")} % {sharding.SIZE} AS offs, {_HEX.format("'skip:' || name")} % {sharding.SIZE - 1} + 1 AS skip
  FROM (SELECT range AS i, 'shard-' || lpad(range::VARCHAR, 2, '0') AS name FROM range({len(sharding.SHARDS)}))
), orders AS MATERIALIZED (
  SELECT list(slots ORDER BY i) AS o FROM (
    SELECT i, list_transform(range({sharding.SIZE}), lambda s: (offs + s * skip) % {sharding.SIZE}) AS slots FROM shards)
), turns AS (
  SELECT 0 AS n, NULL::BIGINT AS slot, [false for x in range({sharding.SIZE})] AS taken
  UNION ALL
  SELECT n + 1, slot, list_transform(taken, lambda t, j: t OR j = slot + 1) FROM (
    SELECT n, taken, list_filter(o[n % {len(sharding.SHARDS)} + 1], lambda s: NOT taken[s + 1])[1] AS slot
    FROM turns, orders WHERE n < {sharding.SIZE})
), filled AS (SELECT slot, (n - 1) % {len(sharding.SHARDS)} AS shard FROM turns WHERE n > 0
), keyed AS (SELECT doc_id, ({_HEX.format("coalesce(doc_id::VARCHAR, '')")} % {sharding.SIZE})::INT AS slot FROM documents)
SELECT doc_id, keyed.slot, shard::INT AS shard FROM keyed JOIN filled ON filled.slot = keyed.slot
"""

#: What the clips' PCM must be: levels of 16 samples with ramps, the second channel half of it with a sawtooth
OP1_SQL = f"""
WITH levels AS (
  SELECT vec_id, [round(v::DOUBLE * 20000)::BIGINT for v in embedding] AS level FROM embeddings WHERE len(embedding) > 0
), samples AS (
  SELECT vec_id, t, level[t // {flac.STEP} + 1] AS a, level[least(t // {flac.STEP} + 2, len(level))] AS z
  FROM (SELECT *, unnest(range(len(level) * {flac.STEP})) AS t FROM levels)
), channels AS (
  SELECT vec_id, t, a + floor((z - a) * (t % {flac.STEP}) / {flac.STEP}::DOUBLE)::BIGINT AS l FROM samples
), stereo AS (
  SELECT vec_id, t, l, floor(l / 2::DOUBLE)::BIGINT + (t * 7919) % 23 - 11 AS r FROM channels
), words AS (
  SELECT vec_id, t, printf('%02X%02X%02X%02X', l & 255, (l >> 8) & 255, r & 255, (r >> 8) & 255) AS x FROM stereo
)
SELECT vec_id, (t // 400)::INT AS block, (t // 400) * 400 AS first_sample, count(*)::INT AS n_samples, 2 AS channels, 16000 AS sample_rate, 16 AS bits, true AS ok, true AS md5_ok,
  string_agg(x, '' ORDER BY t) AS pcm
FROM words GROUP BY vec_id, t // 400
"""


def _op7_sql(levels: int = 8) -> str:
    """Level by level, deeper than any URL of the tables."""
    u = url_templates
    out = ["""WITH lab AS (
  SELECT page_id, count(*) AS l, count(*) FILTER (WHERE quality = 0) AS b
  FROM (SELECT page_id, try_cast(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages) JOIN labels USING (doc_id)
  WHERE quality IS NOT NULL GROUP BY page_id
), parsed AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1) AS rest FROM pages
), r0 AS (
  SELECT page_id, nullif(lower(regexp_extract(rest, '^(?:[^/@]*@)?([^/:@]+)', 1)), '') AS host,
    list_filter(string_split(regexp_extract(rest, '^[^/]*(/.*)$', 1), '/'), lambda s: s <> '') AS segs,
    coalesce(l, 0) AS l, coalesce(b, 0) AS b, '' AS prefix
  FROM parsed LEFT JOIN lab USING (page_id))"""]
    for d in range(levels):
        out.append(f"""c{d} AS (SELECT host, prefix, segs[{d + 1}] AS seg, count(*) AS n, sum(l) AS l, sum(b) AS b FROM r{d} WHERE host IS NOT NULL AND len(segs) > {d} GROUP BY ALL),
m{d} AS (
  SELECT host, prefix, seg, l, b, CASE WHEN n < {u.LEAST} OR (regexp_matches(seg, '[0-9]') AND count(*) FILTER (WHERE regexp_matches(seg, '[0-9]')) OVER w >= {u.LEAST}) THEN '*' ELSE seg END AS name,
    sum(l) OVER w AS pl, sum(b) OVER w AS pb FROM c{d} WINDOW w AS (PARTITION BY host, prefix)),
b{d} AS (SELECT host, prefix, name, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b, any_value(pl)::DOUBLE AS pl, any_value(pb)::DOUBLE AS pb FROM m{d} GROUP BY ALL),
s{d} AS (
  SELECT host, prefix, name, CASE WHEN l = 0 OR pl = l THEN false WHEN pb = 0 OR pb = pl THEN true
    ELSE abs(b / l - (pb - b) / (pl - l)) / sqrt(pb / pl * (1 - pb / pl) * (1 / l + 1 / (pl - l))) < {u.Z} END AS same FROM b{d}),
a{d} AS (SELECT host, prefix, name, CASE WHEN same AND count(*) FILTER (WHERE same) OVER (PARTITION BY host, prefix) >= 2 THEN '~' ELSE name END AS step FROM s{d}),
r{d + 1} AS (
  SELECT page_id, r.host, segs, r.l, r.b, r.prefix || coalesce('/' || step, '') AS prefix
  FROM r{d} r LEFT JOIN m{d} m ON m.host = r.host AND m.prefix = r.prefix AND m.seg = segs[{d + 1}] LEFT JOIN a{d} a ON a.host = m.host AND a.prefix = m.prefix AND a.name = m.name)""")
    return ",\n".join(out) + f""", z AS (SELECT page_id, host, l, b, CASE WHEN host IS NULL THEN '' ELSE prefix END AS template FROM r{levels}
), w AS (SELECT 1 - sum(b) / sum(l)::DOUBLE AS prior FROM z WHERE host IS NOT NULL
), t AS (SELECT host, template, count(*) AS pages, sum(l)::BIGINT AS labelled, sum(b)::BIGINT AS bad FROM z WHERE host IS NOT NULL GROUP BY ALL
), p AS (SELECT t.*, round((labelled - bad + {u.WEIGHT} * coalesce(prior, 1)) / (labelled + {u.WEIGHT}), 6) AS purity FROM t, w)
SELECT page_id, z.host, z.template, coalesce(pages, 0) AS pages, coalesce(labelled, 0) AS labelled, coalesce(bad, 0) AS bad, purity,
  coalesce(purity < {u.PURITY} AND labelled > 0, false) AS rejected
FROM z LEFT JOIN p ON p.host = z.host AND p.template = z.template"""


ORACLE: dict[str, str] = {
    "op1_flac": OP1_SQL,
    "op7_url_templates": _op7_sql(),
    "op3_sharding": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_jaccard_join": OP10_SQL,
}
