"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: which fold a document is in."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(_remainder(5) != 0))
    found = identify(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_counts import Encoding, attribute

    return attribute(table(spark, sf_dir, "documents"), Encoding.load())


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sentencepiece_nbest import Pieces, encode

    return encode(table(spark, sf_dir, "documents"), Pieces.load(), edits=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from millrace.llm.toxicity import train

    return train(docs, table(spark, sf_dir, "labels").where(_remainder(3) != 1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, toxicity_model(spark, docs, sf_dir))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.winnowing import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
     lengths AS (SELECT DISTINCT n FROM windows),
     places AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
                FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
     hits AS (SELECT doc_id, item_id, p, h.n FROM places h JOIN windows USING (win) WHERE h.n = windows.n),
     hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
     hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.rlz import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
     h AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS h FROM p),
     again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM h) WHERE n > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM again),
     lost AS (SELECT doc_id, count(*) AS n_removed, list(q) AS qs FROM gone GROUP BY doc_id),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS words
              FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, good) of pages whose url names a labelled document: /<lang>/<doc_id>."""
    from millrace.llm.url_filter import split_url

    host, path = split_url(F.col("url"))
    named = F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})", 1)
    pages = table(spark, sf_dir, "pages").select(host.alias("host"), F.when(named != "", named.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    return pages.where("doc_id IS NOT NULL").join(labels.select("doc_id", good.alias("good")), "doc_id").select("host", "good")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)


def _kappa_sql(level: str) -> str:
    """The prior strength of a level's groups (n, k) by moments."""
    return f"""
{level}_sums AS (SELECT CAST(sum(n) AS double) AS n, CAST(sum(k) AS double) / sum(n) AS p, CAST(sum(n * n) AS double) AS n2, sum(CAST(k * k AS double) / n) AS k2, CAST(count(*) AS double) AS g FROM {level}),
{level}_rho AS (SELECT CASE WHEN p * (1 - p) * (n - n2 / n - (g - 1)) > 0 THEN (k2 - n * p * p - p * (1 - p) * (g - 1)) / (p * (1 - p) * (n - n2 / n - (g - 1))) END AS rho FROM {level}_sums),
{level}_kappa AS (SELECT CASE WHEN rho > 0 THEN greatest(2.0, least(200.0, 1 / rho - 1)) ELSE 200.0 END AS kappa FROM {level}_rho)"""


def _posterior_sql(level: str, above: str, key: str, on: str) -> str:
    return f"""{level}_post AS (SELECT {key}, k + kappa * m AS a, n - k + kappa * (1 - m) AS b
    FROM {level} c JOIN (SELECT *, a / (a + b) AS m FROM {above}) prior ON {on}, {level}_kappa)"""


def _bound_sql(posterior: str, key: str) -> str:
    return f"SELECT {key}, round(a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 6) AS bound FROM {posterior}"


_RULES_SQL = " ".join(
    f"WHEN (p.host = '{host}' OR ends_with(p.host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}:{verdict}'"
    for verdict, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
)

OP10_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
parts AS (SELECT *, string_split(host, '.') AS l FROM u),
p AS (SELECT page_id, host, path, l[-1] AS suffix, CASE WHEN len(l) <= 2 THEN host
      WHEN l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(l[-1]) = 2 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM parts),
lab AS (SELECT doc_id, CASE WHEN min(quality) = 1 AND max(toxic) = 0 THEN 1 ELSE 0 END AS good FROM labels GROUP BY doc_id),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS k FROM p JOIN lab ON doc_id = TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) AS bigint) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
everything AS (SELECT coalesce(sum(k), 0) + 1.0::double AS a, coalesce(sum(n) - sum(k), 0) + 1.0::double AS b FROM suffixes),
{_kappa_sql("hosts")}, {_kappa_sql("domains")}, {_kappa_sql("suffixes")},
{_posterior_sql("suffixes", "everything", "c.suffix", "true")},
{_posterior_sql("domains", "suffixes_post", "c.domain", "c.suffix = prior.suffix")},
{_posterior_sql("hosts", "domains_post", "c.host", "c.domain = prior.domain")},
judged AS (SELECT page_id, p.host, path, CASE {_RULES_SQL} END AS fits, coalesce(h.bound, d.bound, s.bound, e.bound) AS reputation
  FROM p LEFT JOIN ({_bound_sql("hosts_post", "host")}) h ON h.host = p.host LEFT JOIN ({_bound_sql("domains_post", "domain")}) d ON d.domain = p.domain
  LEFT JOIN ({_bound_sql("suffixes_post", "suffix")}) s ON s.suffix = p.suffix, ({_bound_sql("everything", "1 AS one")}) e)
SELECT page_id, host, path, split_part(fits, ':', 1) AS rule, coalesce(split_part(fits, ':', 2), CASE WHEN reputation >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, reputation FROM judged
"""

def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.merkle import folded, hexed, leaf, manifest

    docs = table(spark, sf_dir, "documents")
    # as a decimal, so that the largest number of all has a next one
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(_remainder(7) == 0, leaf(*values[:3], more, values[4]))
    proofs = manifest(docs.select("doc_id", "lang", leaf(*values).alias("leaf"), tampered.alias("tampered")), "lang", "doc_id", "leaf", ("tampered",))
    found = folded(proofs.withColumn("held", F.coalesce("tampered", "leaf")), "held")
    return found.select(
        "doc_id",
        *[hexed(c).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(hexed("siblings"), 256).alias("proof_sha256"),
        hexed("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(strlen(CAST({value} AS varchar)) AS varchar) || ':' || CAST({value} AS varchar) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of a text of ASCII characters, bit by bit
_CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS varchar), ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {_CRC32_SQL} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM d),
t AS (SELECT grp, 0 AS level, i, n, leaf AS h FROM l
      UNION ALL SELECT grp, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY grp, level, i // 2, n),
s AS (SELECT grp, level AS height, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS h FROM s
      UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
nodes AS (SELECT grp, level, i, h FROM t WHERE n > 1 UNION ALL SELECT '#', level, i, h FROM u WHERE n > 1),
tops AS (SELECT grp, height, i AS place, subroot, (SELECT h FROM u WHERE n = 1) AS root, height + (SELECT max(level) FROM u) AS top FROM s),
f AS (SELECT doc_id, leaf, l.grp, 0 AS level, CASE WHEN height = 0 THEN place ELSE l.i END AS spot, height, place, top, subroot, root, coalesce(tampered, leaf) AS held, '' AS proof
      FROM l JOIN tops USING (grp)
      UNION ALL
      SELECT doc_id, leaf, f.grp, f.level + 1, CASE WHEN f.level + 1 = height THEN place ELSE spot // 2 END, height, place, top, subroot, root,
             CASE WHEN h IS NULL THEN sha256(held) WHEN spot % 2 = 1 THEN sha256(h || held) ELSE sha256(held || h) END, proof || coalesce(h, '')
      FROM f LEFT JOIN nodes ON nodes.grp = CASE WHEN f.level < height THEN f.grp ELSE '#' END
           AND nodes.level = CASE WHEN f.level < height THEN f.level ELSE f.level - height END AND nodes.i = xor(spot, 1)
      WHERE f.level < top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, held AS folded_root, held = root AS verified FROM f WHERE level = top
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.whitening import COMPONENTS, whiten

    rows = whiten(table(spark, sf_dir, "embeddings"), components=COMPONENTS)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_dedup import suffix_dedup

    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
     b AS (SELECT k, len(x) // 2 AS n, x FROM d),
     p AS (SELECT k, unnest(range(1, n - 398)) AS p, x FROM b WHERE n >= 400),
     h AS (SELECT k, p, md5(substr(x, 2 * p - 1, 800)) AS h FROM p),
     again AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
     runs AS (SELECT k, p, p + 400 AS q, CASE WHEN p <= lag(p) OVER (PARTITION BY k ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM again),
     spans AS (SELECT k, min(p) AS p, max(q) AS q, r FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY p) AS r FROM runs) GROUP BY k, r),
     lost AS (SELECT k, sum(q - p) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k),
     edges AS (SELECT k, x, coalesce(lag(q) OVER w, 1) AS a, p AS b FROM spans JOIN d USING (k) WINDOW w AS (PARTITION BY k ORDER BY p)
               UNION ALL SELECT k, x, max(q), max(len(x)) // 2 + 1 FROM spans JOIN d USING (k) GROUP BY k, x),
     kept AS (SELECT k, string_agg(substr(x, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS x FROM edges GROUP BY k)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d JOIN b USING (k) LEFT JOIN lost USING (k) LEFT JOIN kept USING (k)
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_winnowing": op6_winnowing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_rlz": op9_rlz,
    "op10_url_filter": op10_url_filter,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_winnowing": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_rlz": OP9_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
