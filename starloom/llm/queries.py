"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starloom.llm.common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.line_dedup import line_dedup

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, removed="n_removed")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.licences import scan

    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.mixing import mix_sources

    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.warc import round_trip

    records = round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The tables hold neither fetch times nor lists, so the query makes both by rule: a page is
#: fetched on a day of 2024 drawn from its id; every list entry's dates are drawn from its key's MD5.
URL_LISTS = """
SELECT 'hosts' AS list, '||' || host AS key, 'deny' AS verdict, v.action, make_date(2024, 1, 1) + cast(pmod(code + v.n * 45, 366) AS int) AS at
FROM (SELECT host, code, explode(array(struct(0 AS n, 'add' AS action), struct(3 AS n, 'remove' AS action), struct(4 AS n, 'add' AS action))) AS v
      FROM (SELECT host, cast(conv(substr(md5(host), 1, 6), 16, 10) AS bigint) AS code
            FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE url IS NOT NULL)) WHERE code % 3 = 0)
UNION ALL SELECT * FROM VALUES
  ('topics', '||casino-win.example.com', 'deny', 'add', DATE '2024-02-01'), ('topics', '||casino-win.example.com', 'deny', 'remove', DATE '2024-08-01'),
  ('topics', '||cheap-pills.example.com', 'deny', 'add', DATE '2024-04-01'), ('topics', '||free-bets.example.com', 'deny', 'add', DATE '2023-01-01'),
  ('regions', '||example.net', 'deny', 'add', DATE '2024-06-01'), ('regions', '||example.net', 'deny', 'remove', DATE '2024-07-15'),
  ('regions', '||www.thering.example.org', 'allow', 'add', DATE '2024-01-15')
"""


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.url_lists import judge

    pages = read_table(spark, sf_dir, "pages").selectExpr("page_id", "url", "date_add(make_date(2024, 1, 1), cast(pmod(page_id * 7919, 366) AS int)) AS fetched_at")
    return judge(pages, spark.sql(URL_LISTS.replace("FROM pages", "FROM {pages}"), pages=pages))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.decontaminate import contained_items

    found = contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.html_content import extract

    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.ann import nearest

    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, i, l[i] AS line, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w, len(l) AS n
         FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
later AS (SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, i) AS r
            FROM line WHERE i <= n - 2 AND regexp_matches(w, '[^\x20\x09-\x0D]')) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 3)) AS k)),
kept AS (SELECT line.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY line.i) AS text, count(gone.i) AS n_removed
         FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i GROUP BY line.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(kept.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
m AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS f FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, f AS n_found FROM m JOIN n ON n.id = m.item_id WHERE 100 * f >= 80 * n
"""


URL_LISTS_SQL = r"""
WITH h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS code FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE url IS NOT NULL)),
raw AS (SELECT 'hosts' AS list, '||' || host AS key, 'deny' AS verdict, action, DATE '2024-01-01' + CAST((code + n * 45) % 366 AS INTEGER) AS day
        FROM h, (VALUES (0, 'add'), (3, 'remove'), (4, 'add')) AS v(n, action) WHERE code % 3 = 0
        UNION ALL SELECT * FROM (VALUES
          ('topics', '||casino-win.example.com', 'deny', 'add', DATE '2024-02-01'), ('topics', '||casino-win.example.com', 'deny', 'remove', DATE '2024-08-01'),
          ('topics', '||cheap-pills.example.com', 'deny', 'add', DATE '2024-04-01'), ('topics', '||free-bets.example.com', 'deny', 'add', DATE '2023-01-01'),
          ('regions', '||example.net', 'deny', 'add', DATE '2024-06-01'), ('regions', '||example.net', 'deny', 'remove', DATE '2024-07-15'),
          ('regions', '||www.thering.example.org', 'allow', 'add', DATE '2024-01-15'))),
entry AS (SELECT DISTINCT list, regexp_replace(lower(key), '\.+$', '') AS key, verdict, action, day FROM raw),
span AS (SELECT list, key, verdict, action, day AS since, lead(day) OVER (PARTITION BY list, key, verdict ORDER BY day, CASE action WHEN 'remove' THEN 0 ELSE 1 END) AS until FROM entry),
live AS (SELECT list, key, verdict, since, until FROM span WHERE action = 'add' AND (until IS NULL OR until > since)),
c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched_at FROM pages),
u AS (SELECT DISTINCT url, fetched_at FROM c WHERE url IS NOT NULL AND fetched_at IS NOT NULL),
host AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '(?s)[?#].*$', ''), '^[^/]*')), '^[^@]*@', ''), ':[0-9]*$', ''), '\.+$', ''), '.') AS l FROM u),
k AS (SELECT url, fetched_at, '||' || array_to_string(l[i:], '.') AS key FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM host WHERE l <> [''])),
best AS (SELECT url, fetched_at, k.key, list, verdict, row_number() OVER (PARTITION BY url, fetched_at ORDER BY length(k.key) DESC, CASE verdict WHEN 'deny' THEN 0 ELSE 1 END, list, k.key, verdict) AS r
         FROM k JOIN live ON live.key = k.key AND since <= fetched_at AND (until IS NULL OR fetched_at < until))
SELECT c.page_id, c.url, c.fetched_at, coalesce(verdict, 'none') AS verdict, best.key AS matched_key, list AS matched_list
FROM c LEFT JOIN best ON best.url = c.url AND best.fetched_at = c.fetched_at AND r = 1
"""


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.last IS NULL OR g.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.last <> p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def oracle_sql() -> dict[str, str]:
    from starloom.llm import licences

    return {"op2_licences": licences.oracle(), "op4_warc": WARC_SQL, "op5_url_lists": URL_LISTS_SQL, "op6_decontamination": DECONTAMINATION_SQL, "op1_line_dedup": LINE_DEDUP_SQL}
