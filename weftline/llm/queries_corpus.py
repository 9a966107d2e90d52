"""Queries over whole tables of documents and pages: search, manifest, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import merkle, search, warc
from weftline.llm.runtime import documents


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


#: Every document against every item.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS q FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
f AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS impact FROM p, s),
e AS (SELECT item, item_id, r, doc_id, sum(q * w * impact)::BIGINT AS score FROM q JOIN t USING (term) JOIN f USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM e WHERE score > 0 QUALIFY rank <= 20
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text"), merkle.picked(F.col("doc_id")))


OP12_SQL = """
WITH RECURSIVE b8 AS (SELECT i AS byte, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM b8 WHERE k < 8),
t AS (SELECT list(c ORDER BY byte) AS t FROM b8 WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, source, text, hex(encode(doc_id::VARCHAR)) AS h,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS front FROM documents),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) % 5 = 0 AS picked FROM d, t),
l AS (SELECT r, doc_id, source, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(octet_length(encode(text)) || ':' || CASE WHEN picked THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS shown FROM c),
g AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS many FROM l),
n AS (SELECT tree, 0 AS level, pos, many, leaf AS digest FROM g
  UNION ALL SELECT tree, level + 1, pos // 16, any_value((many + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM n WHERE many > 1 GROUP BY tree, level, pos // 16),
s AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS many FROM n WHERE many = 1),
u AS (SELECT 0 AS level, pos, many, digest FROM s
  UNION ALL SELECT level + 1, pos // 16, any_value((many + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE many > 1 GROUP BY level, pos // 16),
nr AS (SELECT tree, level, pos // 16 AS up, list(digest ORDER BY pos) AS run FROM n WHERE many > 1 GROUP BY ALL),
ur AS (SELECT level, pos // 16 AS up, list(digest ORDER BY pos) AS run FROM u WHERE many > 1 GROUP BY ALL),
f AS (SELECT r, tree, 0 AS level, pos, many, shown AS now, '' AS proof FROM g
  UNION ALL SELECT f.r, f.tree, f.level + 1, f.pos // 16, (f.many + 15) // 16, sha256(array_to_string(list_concat(run[1:f.pos % 16], [now], run[f.pos % 16 + 2:]), '')), proof || array_to_string(list_concat(run[1:f.pos % 16], run[f.pos % 16 + 2:]), '')
  FROM f JOIN nr ON nr.tree = f.tree AND nr.level = f.level AND nr.up = f.pos // 16 WHERE f.many > 1),
v AS (SELECT f.r, 0 AS level, s.pos, s.many, now, proof FROM f JOIN s ON s.tree = f.tree WHERE f.many = 1
  UNION ALL SELECT v.r, v.level + 1, v.pos // 16, (v.many + 15) // 16, sha256(array_to_string(list_concat(run[1:v.pos % 16], [now], run[v.pos % 16 + 2:]), '')), proof || array_to_string(list_concat(run[1:v.pos % 16], run[v.pos % 16 + 2:]), '')
  FROM v JOIN ur ON ur.level = v.level AND ur.up = v.pos // 16 WHERE v.many > 1)
SELECT g.doc_id, g.leaf, s.digest AS subroot, x.digest AS root, sha256(v.proof) AS proof_sha256, v.now AS folded_root, v.now = x.digest AS verified
FROM g JOIN s USING (tree) JOIN v ON v.r = g.r AND v.many = 1, (SELECT digest FROM u WHERE many = 1) x
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP13_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, r) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, r) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM f
"""

QUERIES = {"op11_ranked_search": op11_ranked_search, "op12_merkle_manifest": op12_merkle_manifest, "op13_warc": op13_warc}
ORACLES = {"op11_ranked_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc": OP13_SQL}
