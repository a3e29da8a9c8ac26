"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfall.llm import (
    bpe_codec,
    decontamination,
    hard_negatives,
    license_scan,
    pii,
    quality,
    repeated_spans,
    secret_scan,
    sharding,
    simhash,
    token_alignment,
    url_filter,
    voronoi_topk,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The URL rules of the query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL if there is any."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parsed AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict,
         arg_max(sha256(rule_host || chr(10) || rule_path), length(rule_host || rule_path)) AS rule_digest
  FROM parsed JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, rule_digest
FROM parsed LEFT JOIN fits USING (n)
"""


@query("op1_url_filters", URL_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules."""
    rules = url_filter.rules_table(spark, URL_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.score_texts(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATION_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iwin AS (
  SELECT item_id, l, array_to_string(w[s + 1 : s + l], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS l, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s
    FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT n, s, l, array_to_string(w[s + 1 : s + l], ' ') AS win FROM (
    SELECT n, w, l, unnest(range(0, len(w) - l + 1)) AS s
    FROM dw, (SELECT DISTINCT l FROM iwin) WHERE len(w) >= l)),
met AS (SELECT DISTINCT n, s, l, item_id FROM dwin JOIN iwin USING (win, l)),
hits AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(s, s + l)) AS p FROM met) GROUP BY n),
items AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (n) LEFT JOIN items USING (n)
"""


@query("op6_benchmark_decontamination", DECONTAMINATION_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in ten-word windows of benchmark items."""
    met = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return met.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, o.vec_id, CAST(list_inner_product(q.v, o.v) AS BIGINT) AS score
  FROM whole q JOIN whole o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_voronoi_topk", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return voronoi_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _wide(pattern: str) -> str:
    """A pattern over words that each have their own space on either side."""
    return " " + pattern.replace(" ", "  ") + " "


_RULES_SQL = ", ".join(
    f"({r.priority}, {i}, {_quoted(r.label)}, {_quoted(r.keyword)}, {_quoted(_wide(r.pattern))}, {r.score}::DOUBLE)"
    for i, r in enumerate(license_scan.signature_rules())
)
_PHRASES_SQL = ", ".join(f"({_quoted(_wide(p))}, {_quoted(x)})" for p, x in license_scan.BASE_PHRASES.items())


def _n_words(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', ''))) // 2"


_STARTS = f"""list_transform(ms, lambda m, i:
  CAST(list_sum(list_transform(ps[1:i], lambda y: {_n_words("y")})) AS BIGINT)
  + CAST(coalesce(list_sum(list_transform(ms[1:i - 1], lambda y: {_n_words("y")})), 0) AS BIGINT))"""
LICENSE_SQL = f"""
WITH rules(priority, number, label, keyword, pattern, score) AS (VALUES {_RULES_SQL}),
phrases(pattern, label) AS (VALUES {_PHRASES_SQL}),
d AS (
  SELECT n, doc_id, w, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS x
  FROM (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents)),
tried AS (
  SELECT n, priority, number, label, score, regexp_extract_all(x, pattern) AS ms, string_split_regex(x, pattern) AS ps
  FROM d JOIN rules ON list_contains(w, keyword)),
found AS (
  SELECT DISTINCT n, priority, number, label, score, start, start + {_n_words("m")} AS stop FROM (
    SELECT n, priority, number, label, score, unnest(ms) AS m, unnest({_STARTS}) AS start
    FROM tried WHERE len(ms) > 0)),
reached AS (
  SELECT *, max(stop) OVER (PARTITION BY n ORDER BY start, stop DESC, priority, number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
near AS (
  SELECT *, lag(stop) OVER o AS left_stop, lag(priority) OVER o AS left_priority,
         lead(start) OVER o AS right_start, lead(priority) OVER o AS right_priority
  FROM reached WHERE reach IS NULL OR stop > reach WINDOW o AS (PARTITION BY n ORDER BY start)),
kept AS (
  SELECT n, list(DISTINCT label) AS labels, max(score) AS score FROM near
  WHERE NOT (coalesce(left_stop > start AND left_priority <= priority, false)
             OR coalesce(right_start < stop AND right_priority < priority, false)) GROUP BY n),
base AS (
  SELECT n, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM (
    SELECT n, label, unnest({_STARTS}) AS start FROM (
      SELECT n, label, regexp_extract_all(x, pattern) AS ms, string_split_regex(x, pattern) AS ps
      FROM d, phrases WHERE regexp_matches(x, pattern))) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, k.labels))), ','), '') AS labels,
       greatest(coalesce(k.score, 0.0), CASE WHEN n_base > 0 THEN {license_scan.BASE_SCORE} ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN kept k USING (n) LEFT JOIN base b USING (n)
"""


@query("op3_license_scans", LICENSE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and signatures in every text."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _pii_kind_sql(name: str, rank: int, pattern: str, fits: str, score: int, context: str) -> str:
    """(doc, start, rank, end, kind, score in percent) of one kind's confirmed matches."""
    return f"""
SELECT n, {rank} AS rank, '{name}' AS kind, start, start + length(m) AS stop,
  {score} + CASE WHEN regexp_matches(translate(
      right(substr(text, 1, start), 40) || ' ' || substr(text, start + length(m) + 1, 40),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:^|[^a-z])(?:{context})')
    THEN 25 ELSE 0 END AS score FROM (
  SELECT n, text, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i:
           CAST(list_sum(list_transform(ps[1:i], lambda y: length(y)))
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda y: length(y))), 0) AS BIGINT))) AS start
  FROM (SELECT n, text, regexp_extract_all(text, '{pattern}') AS ms,
               string_split_regex(text, '{pattern}') AS ps FROM texts) WHERE len(ms) > 0)
WHERE {fits}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_IBAN = "replace(m, ' ', '')"


def _iban_sql() -> str:
    """Account numbers of a country have its length; of other countries, and shorter ones, any."""
    known = "|".join(
        f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
        + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        + ")"
        for n, names in pii.IBAN_COUNTRIES.items()
    )
    return known + "|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"


_IBAN_PATTERN = _iban_sql()
PII_SQL = (
    "WITH texts AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents), base AS ("
    + " UNION ALL ".join(
        _pii_kind_sql(*kind)
        for kind in [
            ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 75, "mail|contact|write|reply|address"),
            (
                "ip",
                1,
                r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3"
                " AND coalesce(try_cast(ltrim(p, '0') AS int), 0) <= 255))",
                50,
                "ip|host|server|address|login|client",
            ),
            (
                "card",
                2,
                r"[0-9]([\x20-]?[0-9])+",
                f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''),"
                " lambda d, i: CASE WHEN i % 2 = 1 THEN d::int WHEN d::int < 5 THEN d::int * 2 ELSE d::int * 2 - 9 END)) % 10 = 0",
                75,
                "card|visa|credit|payment|debit|account",
            ),
            ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 50, "phone|call|tel|mobile|fax|contact"),
        ]
    )
    + "), added AS ("
    + _pii_kind_sql(
        "iban",
        4,
        _IBAN_PATTERN,
        f"length({_IBAN}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split("
        f"substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55"
        " ELSE ascii(c) - 48 END), lambda r, v: ((CASE WHEN v > 9 THEN r * 100 ELSE r * 10 END) + v) % 97) = 1",
        75,
        "iban|bank|account|transfer|konto",
    )
    + " UNION ALL "
    # No pattern of the other engine looks around, so its neighbours are seen in the text.
    + _pii_kind_sql(
        "ssn",
        5,
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 3) < '900' AND substr(m, 5, 2) <> '00'"
        " AND substr(m, 8, 4) <> '0000' AND NOT regexp_matches(substr(text, start, CASE WHEN start = 0 THEN 0 ELSE 1 END), '[0-9-]')"
        " AND NOT regexp_matches(substr(text, start + 12, 1), '[0-9-]')",
        25,
        "ssn|social|security|taxpayer|tax id",
    )
    + """
), whole AS (SELECT * FROM base UNION ALL SELECT * FROM added WHERE score >= 50),
listed AS (
  SELECT n, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank) AS scores
  FROM whole GROUP BY n)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores
FROM texts LEFT JOIN listed USING (n)"""
)


@query("op7_pii", PII_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts by base kind, digest of base spans, all spans and
    their scores in percent."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), into="spans")
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    counts = [pii.count_of(F.col("spans"), kind.name).alias(f"n_{kind.name}") for kind in pii.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int")), ",").alias("scores"),
    )


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, shingle=3, bits=64, radius=3, blocks=1)
    return found.select("doc_id", "fingerprint", "component_id")


REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT n, doc_id, s, md5(substr(x, 2 * s + 1, 100)) AS win
  FROM (SELECT n, doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS s FROM d WHERE len(x) >= 100)),
hit AS (
  SELECT n, s FROM (SELECT n, s, doc_id, min(doc_id) OVER (PARTITION BY win) AS least FROM w)
  WHERE doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)),
marked AS (SELECT n, s, max(s) OVER (PARTITION BY n ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM hit),
runs AS (SELECT n, s, sum(CASE WHEN p IS NULL OR s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY s) AS r FROM marked),
spans AS (SELECT n, r, min(s) AS a, max(s) + 50 AS b FROM runs GROUP BY n, r),
parts AS (
  SELECT n, a, b, lag(b, 1, 0) OVER (PARTITION BY n ORDER BY a) AS before FROM spans),
cut AS (
  SELECT n, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM parts JOIN d USING (n) GROUP BY n)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN cut USING (n)
"""


@query("op9_suffix_dedup", REPEATS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that repeat fifty bytes of an earlier document."""
    cut = repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_bpe_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of their decoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.col("coded.n_tokens").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of every text against its pieces: groups, links, and how common they are."""
    docs, _ = token_alignment.align_tokenizers(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES), digest=True
    )
    return docs.withColumnRenamed("groups", "groups_sha256")


@query("op12_secret_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts by base kind, digest of base spans, all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), into="spans")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    counts = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


NEGATIVES_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS n, * FROM (
    SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: floor(256 * x::double)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
scored AS (
  SELECT a.n, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same,
         CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM whole a JOIN whole o ON a.n <> o.n WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT n, vec_id AS positive_id, score AS positive_score FROM scored
  WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 5),
met AS (
  SELECT s.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY n, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM scored s JOIN positives p USING (n)
  WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five best positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
