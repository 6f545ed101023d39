"""Queries over page flows: lists, pagination, linked pages, galleries and whole sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.urls import request_url
from pagelake.operators.extract import pick
from pagelake.operators.flows import keyed_snapshots, missed_links, run_flows, walk_lists, walk_plans
from pagelake.operators.sinks import cell_text
from pagelake.operators.strategies import build_strategies
from pagelake.plans import corpora, site
from pagelake.plans.registry import query, sql_strip
from pagelake.session import write_through

# Chains of list pages, and the pages each walk visits. Walk kinds by walk_id % 4: 0 follows eight
# links per page, 1 reads rows inline over three pages, 2 stops at 25 items on one page as does any small limit,
# 3 finds no links and falls back to the list page itself.
_WALKS = """
lists AS (SELECT DISTINCT o_orderkey // 10 AS list_no FROM orders),
walks AS (SELECT list_no // 7 AS walk_id, list_no AS first_list, (list_no // 7) % 4 AS kind FROM lists WHERE list_no % 7 = 0),
pages_of AS (SELECT w.walk_id, w.kind, l.list_no, l.list_no - w.first_list AS page_no FROM walks w JOIN lists l ON l.list_no // 7 = w.walk_id),
sizes AS (SELECT o_orderkey // 10 AS list_no, count(*) AS n FROM orders GROUP BY 1),
stored AS (SELECT list_no, count(*) AS n8 FROM (SELECT o_orderkey // 10 AS list_no, o_orderkey AS k,
    row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS place FROM orders)
  WHERE place <= 8 AND k::VARCHAR NOT LIKE '%77' GROUP BY 1),
counted AS (SELECT p.*, CASE kind WHEN 3 THEN 0 WHEN 1 THEN n ELSE coalesce(n8, 0) END AS found
  FROM pages_of p JOIN sizes s USING (list_no) LEFT JOIN stored t USING (list_no)),
running AS (SELECT *, sum(found) OVER (PARTITION BY walk_id ORDER BY page_no) - found AS n_before FROM counted),
visits AS (SELECT * FROM running WHERE page_no < CASE kind WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 5 END AND (kind <> 2 OR n_before < 25))
"""
_ITEMS = f"""{_WALKS},
items AS (SELECT v.*, o_orderkey AS k, o_orderstatus AS status,
    row_number() OVER (PARTITION BY v.walk_id, v.list_no ORDER BY o_orderkey) - 1 AS pos
  FROM visits v JOIN orders o ON o.o_orderkey // 10 = v.list_no),
asked AS (SELECT * FROM items WHERE kind IN (0, 2) AND pos < 8),
ranked AS (SELECT *, n_before + row_number() OVER (PARTITION BY walk_id, list_no ORDER BY pos) - 1 AS record_no FROM asked
  WHERE k::VARCHAR NOT LIKE '%77'),
links AS (SELECT walk_id, record_no, k FROM ranked WHERE kind = 0 OR record_no < 25)"""


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List starts with the strategy their task and reply lead to."""
    starts = corpora.list_starts(spark, sf_dir)
    work = starts.withColumns(
        {
            "page_type": F.lit("list"),
            "suggested_fields": F.lit(None).cast("array<string>"),
            "requested_fields": F.array(F.lit("title"), F.lit("price")),
            "max_items": F.when(F.col("task").startswith("Top"), 25),
            "tag_counts": F.lit(None).cast("map<string,int>"),
        }
    )
    return write_through(build_strategies(work, "strategy_reply").select("walk_id", "url", "page_type", "strategy"), "starts")


def _doms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_through(keyed_snapshots(corpora.shop_snapshots(spark, sf_dir)), "doms")


@query(
    "list_walk",
    f"""WITH {_WALKS} SELECT walk_id, page_no::BIGINT AS page_no, 'http://shop.example.com/list/' || list_no AS page_url,
      found::BIGINT AS n_found FROM visits""",
)
def list_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = walk_lists(write_through(walk_plans(_starts(spark, sf_dir)), "plans"), _doms(spark, sf_dir))
    return visits.select(
        "walk_id", F.col("page_no").cast("bigint").alias("page_no"), F.col("base_url").alias("page_url"),
        (F.col("n_after") - F.col("n_before")).cast("bigint").alias("n_found"),
    )


@query(
    "missed_links",
    f"""WITH {_ITEMS} SELECT walk_id, 'http://shop.example.com/list/' || list_no AS page_url, 'http://shop.example.com/orders/' || k AS target
      FROM asked WHERE k::VARCHAR LIKE '%77'""",
)
def links_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = write_through(walk_plans(_starts(spark, sf_dir)), "plans")
    return missed_links(walk_lists(plans, _doms(spark, sf_dir)))


@query(
    "list_records",
    f"""WITH {_ITEMS}
    SELECT walk_id, record_no::BIGINT AS record_no, 'http://shop.example.com/orders/' || k AS page_url, 'Order ' || k AS title,
      o_orderpriority AS price FROM links JOIN orders ON o_orderkey = k WHERE k::VARCHAR NOT LIKE '%77'
    UNION ALL SELECT walk_id, (n_before + pos)::BIGINT, 'http://shop.example.com/list/' || list_no, 'Order ' || k, status
      FROM items WHERE kind = 1
    UNION ALL SELECT walk_id, 0, 'http://shop.example.com/list/' || first_list, 'Orders', first_status FROM (
      SELECT w.walk_id, w.first_list, arg_min(o_orderstatus, o_orderkey) AS first_status FROM walks w
      JOIN orders o ON o.o_orderkey // 10 = w.first_list WHERE kind = 3 GROUP BY ALL)""",
)
def records_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = run_flows(_starts(spark, sf_dir), _doms(spark, sf_dir))
    cells = [pick(F.col("record"), f).s.alias(f) for f in ("title", "price")]
    return records.select("walk_id", F.col("record_no").cast("bigint").alias("record_no"), "page_url", *cells)


_DOC_TEXT = sql_strip("text")
_DOC_IMAGES = """CASE WHEN doc_id % 2 = 0 THEN '["http://docs.example.com/a/' || doc_id || '.png","http://docs.example.com/b/' || (doc_id % 3)
    || '.png","http://docs.example.com/a/' || doc_id || '.png"]'
  ELSE '["http://docs.example.com/d/' || doc_id || '.png","http://docs.example.com/' || lang || '/x' || (doc_id % 5) || '.png"]' END"""


_SITE_SQL = f"""WITH d AS (SELECT *, 'http://docs.example.com/' || lang || '/' || doc_id AS url FROM documents)
    SELECT doc_id AS walk_id, 0::BIGINT AS record_no, url AS page_url, 'title' AS field, 'Doc ' || doc_id AS value FROM d
    UNION ALL SELECT doc_id, 0, url, 'content', CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id || {_DOC_TEXT} ELSE '' END
      FROM d WHERE doc_id % 5 <> 0
    UNION ALL SELECT doc_id, 0, url, 'images', {_DOC_IMAGES} FROM d WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 0, url, 'images', '' FROM d WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 0, url, 'cover', CASE WHEN doc_id % 2 = 0 THEN 'http://docs.example.com/a/' || doc_id || '.png'
      ELSE 'http://docs.example.com/d/' || doc_id || '.png' END FROM d WHERE doc_id % 5 = 0"""


@query("site_extraction", _SITE_SQL)
def site_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage from stored page and task to records: news, gallery and default flow."""
    pages = corpora.document_pages(spark, sf_dir)
    doc_id = F.col("doc_id")
    kind = F.when(doc_id % 3 == 0, "gallery").when(doc_id % 3 == 1, "detail").otherwise("forum")
    intent = F.when(doc_id % 5 == 0, '{"requested_fields": ["cover"]}')
    assignments = pages.select(
        doc_id.alias("walk_id"), "url",
        F.when(doc_id % 5 == 0, "get title and photo").otherwise("get title and content").alias("task"),
        corpora.text('{"page_type": "', kind, '", "confidence": 0.9}').alias("typing_reply"),
        intent.alias("intent_reply"),
    )
    snapshots = pages.select(F.col("url").alias("requested_url"), F.lit("").alias("final_url"), "html")
    records = site.extract_site(snapshots, assignments, typing_reply="typing_reply", intent_reply="intent_reply")
    return records.select("walk_id", "record_no", "page_url", F.explode("record").alias("c")).select(
        "walk_id", F.col("record_no").cast("bigint").alias("record_no"), "page_url",
        F.col("c.field").alias("field"), cell_text(F.col("c")).alias("value"),
    )


@query(
    "known_targets",
    """SELECT o_orderkey // 10 AS list_no, count(*) AS n_links, count(*) FILTER (o_orderkey::VARCHAR NOT LIKE '%77') AS n_known
    FROM orders GROUP BY 1""",
)
def known_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of each list page lead to a stored page."""
    from pagelake.functions.urls import resolve_url
    from pagelake.operators.summary import links
    from pagelake.sources.html import parse_html

    lists = parse_html(corpora.spread(corpora.list_pages(spark, sf_dir)))
    targets = lists.select("list_no", "requested_url", F.explode(links()).alias("link")).filter(
        F.col("link.text") != "next"
    )
    keyed = targets.select("list_no", request_url(resolve_url("requested_url", "link.href")).alias("url_key"))
    stored = corpora.shop_snapshots(spark, sf_dir).select(request_url("requested_url").alias("url_key"), F.lit(1).alias("hit"))
    return keyed.join(stored, "url_key", "left").groupBy("list_no").agg(
        F.count("*").alias("n_links"), F.count("hit").alias("n_known")
    )
