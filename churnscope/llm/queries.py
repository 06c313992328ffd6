"""The operators of this subpackage as named queries over the given tables.

Each query applies its operator, with production parameters, to its whole
table; ``QUERIES`` and ``ORACLE`` are merged into the driver's registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import (decontaminate, langid, near_dedup, part_codes, prefix_hash, prefix_trie, repeats,
                            sentencepieces, sharding, topk, toxicity, url_filter, warc)
from churnscope.llm.shipping import ship
from churnscope.session import stash
from churnscope.sources.tables import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents", "doc_id"), "doc_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                     sentencepieces.read_model())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels, _remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                             read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def _remainder(column: str, divisor: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, F.coalesce(_remainder("doc_id", 3) != 1, F.lit(False)))
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"),
                      F.col("vec_id") % topk.EVERY == 0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"), shingle=2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.sequences(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    own = stash(turns, "conversation-keys")
    return prefix_trie.trie(prefix_trie.rebuild(own))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.compare_edits(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = part_codes.compress(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return part_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(part_codes.books_digest(books)).alias("codebooks_sha256"))


def _shipped(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_langid": op7_langid,
    "op8_topk": op8_topk,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fingerprints": op12_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}.items()}

ORACLE: dict[str, str] = {}

ORACLE["op2_url_filter"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://')
      THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(r, length(regexp_extract(r, '^[^/]*')) + 1) AS path
  FROM rest),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN LATERAL (
  SELECT rhost || rpath AS rule, verdict FROM rules
  WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  ORDER BY length(rhost || rpath) DESC LIMIT 1) m ON true
"""

ORACLE["op6_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dn AS (SELECT doc_id, w, coalesce(len(w), 0) AS n FROM dw),
iwin AS (
  SELECT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS k
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM iwin),
dwin AS (
  SELECT doc_id, i AS pos, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM dn JOIN sizes ON n >= k, unnest(range(1, n - k + 2)) AS t(i)),
occ AS (SELECT d.doc_id, d.pos, d.k, b.item_id FROM dwin d JOIN iwin b ON d.win = b.win AND d.k = b.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT doc_id, pos, k FROM occ))
         GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dn d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

ORACLE["op9_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 1, len(w))], ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
              FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM both_have JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
         WHERE 100 * k >= 80 * (p.n + q.n - k)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least_id USING (doc_id)
"""

ORACLE["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS first,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, (i // 8 * 10 + 1)::BIGINT, 10))::BIGINT) >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT
      + 1, 1)),
      'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

# crc32 bit by bit; a node is named by the hashes of its turns
ORACLE["op11_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, list(sha256(concat(length(r), ':', r, x)) || ':' || length(x) ORDER BY turn NULLS FIRST) AS own
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
drawn AS (
  SELECT conv_id, own, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                               lambda d, i: xor(d >> 1, (d & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 AS h
  FROM turns),
built AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(s.own[1:c.h], []), c.own[c.h + 1:]) AS seq
  FROM drawn c LEFT JOIN turns s ON s.conv_id = c.conv_id - c.conv_id % 100),
steps AS (
  SELECT conv_id, d AS depth, array_to_string(seq[1:d], ' ') AS path, array_to_string(seq[1:d - 1], ' ') AS up,
         d = len(seq) AS ends, CASE WHEN d = 0 THEN 0 ELSE split_part(seq[d], ':', 2)::BIGINT END AS points
  FROM built, unnest(range(0, len(seq) + 1)) AS t(d)),
nodes AS MATERIALIZED (
  SELECT depth, path, any_value(up) AS up, any_value(points) AS points, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, path)),
below AS (
  SELECT s.depth AS depth, s.path AS path, sum((f.n_children = 0)::BIGINT) AS n_leaves,
         sum((f.n_convs - 1) * f.points) AS saved_tokens
  FROM full_nodes f JOIN built b ON b.conv_id = f.conv_id, unnest(range(0, f.depth + 1)) AS t(d)
  JOIN nodes s ON s.depth = d AND s.path = array_to_string(b.seq[1:d], ' ')
  GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below USING (depth, path)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.up AND n.depth > 0
"""


def _vector_codes_sql(rounds: int = part_codes.ROUNDS) -> str:
    """Each round's assignment and entries as two steps over the one before; the distance and the entry in one number."""
    steps = ["""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS part FROM kept, unnest(range(4)) AS t(p)),
book0 AS MATERIALIZED (
  SELECT p, e, part AS c FROM (
    SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(part) AS part, min((list_inner_product(part, part) - 2 * list_inner_product(part, c)
         + list_inner_product(c, c))::BIGINT * 256 + e) AS best
  FROM parts JOIN book{r} USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS c FROM (
      SELECT p, best % 256 AS e, i, floor(sum(part[i]) / count(*)) AS s
      FROM near{r}, unnest(range(1, len(part) + 1)) AS t(i) GROUP BY ALL) GROUP BY p, e) m USING (p, e))""")
    steps.append(f"""
codes AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS d
  FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT d FROM digest) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
""")
    return steps[0] + "," + ",".join(steps[1:])


ORACLE["op13_vector_codes"] = _vector_codes_sql()
