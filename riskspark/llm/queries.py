"""Queries of this folder and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (decontamination, licenses, line_dedup, lm_scoring, merkle, mixing, near_dedup, secret_scan, sharding, topk,
                           toxicity, url_filter, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHINGLES_SQL = fr"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM docs),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON reach.b = d.r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs LEFT JOIN sizes USING (r) JOIN least USING (r)
"""


@query(SHINGLES_SQL)
def op1_near_dedup(spark, sf_dir):
    """Near-duplicate components over five-word shingles at a similarity of 0.75."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_toxicity(spark, sf_dir):
    """A toxicity score for every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k,
    pow(n, 0.7) / sum(pow(n, 0.7)) OVER () AS share FROM sizes),
-- as many slots as the smallest share needs, 1,000 at least; largest remainders over all of them
scaled AS (SELECT *, CAST(least(greatest(1000, ceil(round(1 / min(share) OVER (), 6))), 262144) AS BIGINT) AS slots FROM shares),
floors AS (SELECT *, greatest(1, CAST(floor(round(share * slots, 9)) AS BIGINT)) AS low,
    CASE WHEN round(share * slots, 9) >= 1 THEN round(round(share * slots, 9) - floor(round(share * slots, 9)), 9) ELSE 0 END AS rest FROM scaled),
rounded AS (SELECT source, n, k, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= slots - sum(low) OVER () THEN 1 ELSE 0 END AS w
    FROM floors),
weights AS (SELECT *, CAST(sum(w) OVER () AS BIGINT) AS period FROM rounded),
-- slot by slot the released block with the earliest deadline; taken: blocks so far by source
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i,
         (SELECT list(CAST(0 AS BIGINT) ORDER BY k) FROM weights) AS taken
  UNION ALL
  SELECT t, b.k, b.i, list_transform(taken, lambda n, j: CASE WHEN j - 1 = b.k THEN n + 1 ELSE n END)
  FROM (SELECT e.t + 1 AS t, e.taken, (SELECT min(struct_pack(
           d := ((e.taken[w.k + 1] + 1) * w.period + w.w - 1) // w.w, k := w.k, i := e.taken[w.k + 1]))
           FROM weights w WHERE (e.taken[w.k + 1] * w.period) // w.w <= e.t + 1) AS b
        FROM edf e WHERE e.t + 1 < (SELECT max(period) FROM weights))),
slots AS (SELECT k, i, t FROM edf WHERE t >= 0),
ends AS (SELECT max((n - 1) // w * period + t + 1) AS length FROM weights JOIN slots USING (k) WHERE i = (n - 1) % w),
plan AS (SELECT w.*, (length // period) * w.w + (SELECT count(*) FROM slots s WHERE s.k = w.k AND s.t < length % period) AS blocks
    FROM weights w, ends),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source
    ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents),
placed AS (SELECT doc_id, d.source, k, w, period, n, unnest(range(0, (blocks - 1 - r) // n + 1)) AS epoch, r
    FROM ranked d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, epoch, (r + epoch * n) // w * period + t AS position
FROM placed p JOIN slots s ON s.k = p.k AND s.i = (r + epoch * n) % w
"""


@query(MIX_SQL)
def op3_mix_sources(spark, sf_dir):
    """Every document's places in the mix: sources by size to the power 0.7, 1,000 slots a period or as many as the smallest needs."""
    return mixing.mix(table(spark, sf_dir, "documents"))


LINES_SQL = fr"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
    FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM frequent)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY r
"""


@query(LINES_SQL)
def op4_line_dedup(spark, sf_dir):
    """Lines found in ten documents or more leave all of them."""
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SHARDS_SQL = """
WITH docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest) AS copy FROM docs),
hashed AS (SELECT doc_id, copy, n_bytes, CAST('0x' || substr(md5(
    coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM numbered),
levels AS (SELECT *, unnest(range(0, 61)) AS depth FROM hashed),
sums AS (SELECT depth, h >> (60 - depth) AS bucket, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY ALL),
leaves AS (SELECT l.doc_id, l.copy, l.n_bytes, l.h, min(struct_pack(depth := l.depth, b := shard_bytes, r := shard_rows)) AS leaf
    FROM levels l JOIN sums s ON l.depth = s.depth AND l.h >> (60 - l.depth) = s.bucket
    WHERE shard_bytes <= 67108864 OR shard_rows = 1 OR l.depth = 60 GROUP BY ALL)
SELECT doc_id, copy, n_bytes, substr(to_base(h, 2, 60), 1, CAST(leaf.depth AS INTEGER)) AS shard, CAST(leaf.depth AS INTEGER) AS depth,
  CAST(leaf.b AS BIGINT) AS shard_bytes, leaf.r AS shard_rows
FROM leaves
"""


@query(SHARDS_SQL)
def op5_shard(spark, sf_dir):
    """Every document's shard: at most 64 MiB of text each."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 64 << 20)


BENCHMARK_SQL = fr"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, size, w[i:i + size - 1] AS win FROM
    (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT r, size, i, w[i:i + size - 1] AS win FROM
    (SELECT r, w, size, unnest(range(1, greatest(len(w) - size, -1) + 2)) AS i FROM docs, sizes)),
hits AS (SELECT r, i, s.size, item_id FROM spots s JOIN windows v ON s.size = v.size AND s.win = v.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


@query(BENCHMARK_SQL)
def op9_decontaminate(spark, sf_dir):
    """Words of every document inside windows of 13 words of the benchmark."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


#: The rules of the query.
URL_RULES = """VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')"""

URLS_SQL = fr"""
WITH rules(host, path, verdict) AS ({URL_RULES}),
parts AS (SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
met AS (SELECT p.r, max(struct_pack(n := length(u.host || u.path), rule := u.host || u.path, verdict := u.verdict)) AS best
    FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN met USING (r)
"""


@query(URLS_SQL)
def op8_url_filter(spark, sf_dir):
    """The verdict of the longest rule that fits, for every page."""
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS rules(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


TOP_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query(TOP_SQL)
def op10_top_k(spark, sf_dir):
    """The 20 best inner products of every twentieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op6_secrets(spark, sf_dir):
    """Secrets of every document, weak ones where their complements stand close by."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query()
def op7_licenses(spark, sf_dir):
    """Licence labels of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


#: Fixed values of the reflected CRC-32: its polynomial is 0xEDB88320.
CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen({x})), lambda i: CAST(ascii({x}[i + 1]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"""


def crc32_sql(digits: str) -> str:
    """CRC-32 of a text of ASCII characters, unsigned."""
    return f"xor({CRC_SQL.format(x=digits)}, 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _levels_sql(name: str, leaves: str) -> str:
    """Levels of trees as lists: ``leaves`` gives (tree, nodes)."""
    return f"""{name} AS (SELECT tree, 0 AS level, nodes FROM ({leaves}) UNION ALL
    SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
    FROM {name} WHERE len(nodes) > 1)"""


def _path_sql(name: str, start: str, levels: str) -> str:
    """Up the levels: ``start`` gives (r, tree, i, siblings, node), i from 0."""
    return f"""{name} AS (SELECT r, tree, i, 0 AS level, siblings, node FROM ({start}) UNION ALL
    SELECT p.r, p.tree, p.i // 2, p.level + 1, siblings || coalesce(l.nodes[xor(p.i, 1) + 1], ''),
      sha256(CASE WHEN p.i % 2 = 1 THEN l.nodes[p.i] || node ELSE node || coalesce(l.nodes[p.i + 2], '') END)
    FROM {name} p JOIN {levels} l ON l.tree = p.tree AND l.level = p.level AND len(l.nodes) > 1)"""


MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (SELECT *, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0
    THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS given FROM documents),
rows_ AS (SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, doc_id, leaf, given FROM hashed),
{_levels_sql("low", "SELECT tree, list(leaf ORDER BY i) AS nodes FROM rows_ GROUP BY tree")},
subroots AS (SELECT tree, nodes[1] AS subroot FROM low WHERE len(nodes) = 1),
{_levels_sql("high", "SELECT 0 AS tree, list(subroot ORDER BY tree) AS nodes FROM subroots")},
{_path_sql("climbed", "SELECT r, tree, i, '' AS siblings, given AS node FROM rows_", "low")},
{_path_sql("above", "SELECT r, 0 AS tree, tree AS i, siblings, node FROM (SELECT *, max(level) OVER (PARTITION BY r) AS last FROM climbed) WHERE level = last", "high")},
ends AS (SELECT r, arg_max(siblings, level) AS siblings, arg_max(node, level) AS folded_root FROM above GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
FROM rows_ JOIN subroots USING (tree) JOIN ends USING (r), (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1)
"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark, sf_dir):
    """Every document's leaf and proof in a tree per language below one root, checked after tampering with some."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int = 4) -> str:
    near = """near{k} AS MATERIALIZED (SELECT a.r, a.p, any_value(a.v) AS v, min(struct_pack(d := CAST(coalesce(list_sum(list_transform(
    list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT), e := b.e)) AS best
    FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p)"""
    book = """sums{k} AS (SELECT p, best.e AS e, count(*) AS n, j, CAST(sum(v[j]) AS BIGINT) AS s
    FROM near{k}, (SELECT unnest(range(1, w + 1)) AS j FROM width) GROUP BY ALL),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM sums{k} GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)"""
    steps = ",\n".join(f"{near.format(k=k)},\n{book.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x:
    CAST(floor(greatest(least(1024 * CAST(x AS DOUBLE), 67108864), -67108864)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT CAST((max(len(q)) + 3) // 4 AS BIGINT) AS w FROM kept),
parts AS MATERIALIZED (SELECT r, p, list_resize(q, 4 * w, 0)[p * w + 1:(p + 1) * w] AS v FROM kept, width, (SELECT unnest(range(0, 4)) AS p)),
firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM kept),
book0 AS MATERIALIZED (SELECT p, e, v FROM firsts JOIN parts USING (r) WHERE e < 256),
{steps},
{near.format(k=rounds)},
codes AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
books AS (SELECT sha256(coalesce(string_agg(CAST(v[j] AS VARCHAR), ',' ORDER BY p, e, j), '')) AS codebooks_sha256
    FROM book{rounds}, (SELECT unnest(range(1, w + 1)) AS j FROM width))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), books
"""


@query(_codes_sql())
def op12_vector_codes(spark, sf_dir):
    """Every vector's code of four bytes, and its error alone and by label."""
    codes, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(vector_codes.listed(books).encode()).hexdigest()
    return vector_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


@query()
def op13_lm_scores(spark, sf_dir):
    """Every document's log-probability under smoothed word counts and under a trained log-bilinear model."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))
