"""Every operator run over the whole test tables, each with the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerframe import (
    active_state,
    alias_lookup,
    apply_to_state,
    capture,
    create_state,
    dereference,
    exists_guard,
    fill_defaults,
    inventory,
    inventory_counts,
    json_keys,
    list_items,
    load_items,
    managed_apply,
    managed_remove,
    mark_active,
    normalize_ref,
    overlay_json,
    overlay_maps,
    overlay_rows,
    owner_of,
    read_state,
    removable,
    remove_from_state,
    render_doc,
    save_new,
    save_new_files,
    switch_owner,
    tag_known,
)
from layerframe.operators.lookup import with_canonical
from layerframe.plans import fixed_values as fixed
from layerframe.plans import profiles
from layerframe.sources.shared import new_shared_path

Query = Callable[[SparkSession, str], DataFrame]
Tables = Callable[[str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of the tables under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(cache(partial(_table, spark, sf_dir)))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- layers -----------------------------------------------------------------


def _price_layers(table: Tables) -> tuple[DataFrame, DataFrame]:
    base = table("part").select(
        F.col("p_partkey").alias("partkey"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")
    )
    extra = (
        table("lineitem")
        .groupBy(F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("size"))
        .agg(F.max("l_extendedprice").alias("price"))
    )
    return base, extra


_PRICE_SQL = """
    WITH base AS (
        SELECT p_partkey AS partkey, p_size AS size, p_retailprice AS price FROM part
    ), extra AS (
        SELECT l_partkey AS partkey, l_linenumber AS size, max(l_extendedprice) AS price FROM lineitem
        GROUP BY l_partkey, l_linenumber
    )
    SELECT partkey, size,
           CASE WHEN e.partkey IS NOT NULL THEN e.price ELSE b.price END AS price,
           CASE WHEN e.partkey IS NULL THEN 'base'
                WHEN b.partkey IS NULL THEN 'added' ELSE 'overridden' END AS origin
    FROM base b FULL JOIN extra e USING (partkey, size)
"""


@query(_PRICE_SQL)
def overlay_part_prices(table: Tables) -> DataFrame:
    return overlay_rows(*_price_layers(table), ["partkey", "size"])


@query(_PRICE_SQL)
def overlay_part_prices_small_extra(table: Tables) -> DataFrame:
    return overlay_rows(*_price_layers(table), ["partkey", "size"], small_extra=True)


@query("""
    SELECT c.c_custkey AS custkey, p.o_orderpriority AS priority,
           coalesce(o.n, 0) AS n_orders, o.n IS NULL AS filled
    FROM customer c CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
    LEFT JOIN (
        SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
    ) o ON o.o_custkey = c.c_custkey AND o.o_orderpriority = p.o_orderpriority
""")
def fill_order_priorities(table: Tables) -> DataFrame:
    orders = table("orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority")
    )
    return fill_defaults(
        orders.groupBy("custkey", "priority").agg(F.count("*").alias("n_orders")),
        table("customer").select(F.col("c_custkey").alias("custkey")),
        orders.select("priority"),
        entity="custkey",
        item="priority",
        defaults={"n_orders": 0},
    )


@query("""
    SELECT r_regionkey AS regionkey, p.partkey, coalesce(s.n, 0) AS n_lines, s.n IS NULL AS filled
    FROM region CROSS JOIN (SELECT DISTINCT l_partkey AS partkey FROM lineitem) p
    LEFT JOIN (
        SELECT n_regionkey, l_partkey, count(*) AS n FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2
    ) s ON s.n_regionkey = r_regionkey AND s.l_partkey = p.partkey
""")
def fill_region_parts(table: Tables) -> DataFrame:
    """Parts that no supplier of a region has sold, out of all parts sold."""
    homes = table("supplier").join(
        table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    sold = table("lineitem").join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = sold.groupBy(
        F.col("n_regionkey").alias("regionkey"), F.col("l_partkey").alias("partkey")
    ).agg(F.count("*").alias("n_lines"))
    return fill_defaults(
        counts,
        table("region").select(F.col("r_regionkey").alias("regionkey")),
        table("lineitem").select(F.col("l_partkey").alias("partkey")),
        entity="regionkey",
        item="partkey",
        defaults={"n_lines": 0},
    )


@query("""
    WITH sides AS (
        SELECT user_id, event_type,
               max(value) FILTER (ts < TIMESTAMP '2024-01-16' AND event_type <> 'view') AS b,
               max(value) FILTER (ts >= TIMESTAMP '2024-01-16' AND event_type <> 'click') AS e
        FROM events GROUP BY user_id, event_type
    )
    SELECT user_id, event_type, coalesce(e, b) AS value FROM sides
    WHERE e IS NOT NULL OR b IS NOT NULL
""")
def overlay_event_maps(table: Tables) -> DataFrame:
    late = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    kind = F.col("event_type")
    per_type = (
        table("events")
        .groupBy("user_id", "event_type")
        .agg(
            F.max(F.when(~late & (kind != "view"), F.col("value"))).alias("before"),
            F.max(F.when(late & (kind != "click"), F.col("value"))).alias("after"),
        )
    )

    def as_map(side: str):
        # At most one entry per event type is left by the first aggregation.
        entry = F.when(F.col(side).isNotNull(), F.struct(kind, F.col(side)))
        return F.map_from_entries(F.collect_list(entry))

    maps = per_type.groupBy("user_id").agg(
        as_map("before").alias("base"), as_map("after").alias("extra")
    )
    merged = overlay_maps(F.col("base"), F.col("extra"))
    return maps.select("user_id", F.explode(merged).alias("event_type", "value"))


@query("""
    SELECT event_id, status,
           CASE WHEN status = 'merged' THEN
                    '{"k":' || CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k')
                                    ELSE '"base"' END || ',"user":' || user_id ||
                    CASE WHEN event_type = 'signup' THEN ',"joined":true}' ELSE '}' END
                ELSE '{"k":"base","user":' || user_id || '}' END AS doc
    FROM (
        SELECT *, CASE event_type WHEN 'error' THEN 'invalid' WHEN 'click' THEN 'invalid'
                  WHEN 'purchase' THEN 'absent' ELSE 'merged' END AS status
        FROM events
    )
""")
def overlay_event_documents(table: Tables) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    extra = (
        F.when(kind == "error", F.rtrim(props, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == "signup", F.lit('{"joined": true}'))
        .when(kind == "view", props)
    )
    base = render_doc(F.lit("base").alias("k"), F.col("user_id").alias("user"))
    return overlay_json(table("events"), base, extra).select("event_id", "status", "doc")


@query("""
    SELECT p_partkey AS partkey,
           json_object('name', p_name, 'args', json_array('run', p_brand))::VARCHAR AS doc
    FROM part
""")
def render_part_documents(table: Tables) -> DataFrame:
    return table("part").select(
        F.col("p_partkey").alias("partkey"),
        render_doc(
            F.col("p_name").alias("name"), F.array(F.lit("run"), "p_brand").alias("args")
        ).alias("doc"),
    )


# --- state ------------------------------------------------------------------

_LATEST_SQL = """
    SELECT user_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""


def _latest_events(table: Tables) -> DataFrame:
    return active_state(
        table("events"), "user_id", "event_type", ["ts", "event_id"], tombstone="error"
    )


@query(f"SELECT * FROM ({_LATEST_SQL}) WHERE event_type <> 'error'")
def active_event_types(table: Tables) -> DataFrame:
    return _latest_events(table)


@query(f"""
    SELECT n.user_id, n.event_type,
           n.event_type = l.event_type AND l.event_type <> 'error' AS is_active
    FROM (SELECT DISTINCT user_id, event_type FROM events) n
    JOIN ({_LATEST_SQL}) l USING (user_id)
""")
def mark_active_event_types(table: Tables) -> DataFrame:
    names = table("events").select("user_id", "event_type").distinct()
    return mark_active(
        names, _latest_events(table), "user_id", "event_type", "event_type"
    )


# --- owned rows -------------------------------------------------------------


def _balances(table: Tables) -> DataFrame:
    return table("customer").select(
        F.col("c_custkey").alias("custkey"),
        F.col("c_nationkey").cast("long").alias("slot"),
        F.col("c_acctbal").alias("amount"),
        F.col("c_mktsegment").alias("owner"),
    )


def _pending(table: Tables, owner: str) -> DataFrame:
    """Orders ask for slots of their customers, who hold that of their nation."""
    return (
        table("orders")
        .groupBy(F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 25).alias("slot"))
        .agg(F.max("o_totalprice").alias("amount"))
        .withColumn("owner", F.lit(owner))
    )


_BALANCES_SQL = """
    current_rows AS (
        SELECT c_custkey AS custkey, c_nationkey::BIGINT AS slot, c_acctbal AS amount, c_mktsegment AS owner
        FROM customer
    ), incoming AS (
        SELECT o_custkey AS custkey, o_orderkey % 25 AS slot, max(o_totalprice) AS amount FROM orders
        GROUP BY 1, 2
    )
"""
_APPLY_SQL = f"""
    WITH {_BALANCES_SQL}
    SELECT custkey, slot, outcome,
           CASE WHEN outcome IN ('inserted', 'replaced') THEN new_amount
                ELSE old_amount END AS amount,
           CASE WHEN outcome IN ('inserted', 'replaced') THEN 'BUILDING'
                ELSE owner END AS owner
    FROM (
        SELECT custkey, slot, c.amount AS old_amount, i.amount AS new_amount, c.owner,
               CASE WHEN i.custkey IS NULL THEN 'kept'
                    WHEN c.custkey IS NULL THEN 'inserted'
                    WHEN c.owner = 'BUILDING' THEN 'replaced' ELSE 'conflict' END AS outcome
        FROM current_rows c FULL JOIN incoming i USING (custkey, slot)
    )
"""


@query(_APPLY_SQL)
def managed_apply_pending_orders(table: Tables) -> DataFrame:
    return managed_apply(
        _balances(table),
        _pending(table, "BUILDING"),
        ["custkey", "slot"],
        F.col("owner") == "BUILDING",
    )


@query(_APPLY_SQL)
def managed_apply_small_incoming(table: Tables) -> DataFrame:
    return managed_apply(
        _balances(table),
        _pending(table, "BUILDING"),
        ["custkey", "slot"],
        F.col("owner") == "BUILDING",
        small_incoming=True,
    )


def _southern_nations(table: Tables) -> DataFrame:
    regions = table("region").where("r_name IN ('AFRICA', 'AMERICA', 'ASIA')")
    return (
        table("nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
        .select(F.col("n_nationkey").alias("c_nationkey"))
    )


_SOUTHERN_SQL = """
    c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
                    WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA'))
"""


@query(f"""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    WHERE NOT (c_mktsegment = 'BUILDING' AND {_SOUTHERN_SQL})
""")
def managed_remove_customers(table: Tables) -> DataFrame:
    return managed_remove(
        table("customer"),
        _southern_nations(table),
        "c_nationkey",
        F.col("c_mktsegment") == "BUILDING",
    )


@query(f"""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    WHERE c_mktsegment = 'BUILDING' AND {_SOUTHERN_SQL}
""")
def removable_customers(table: Tables) -> DataFrame:
    return removable(
        table("customer"),
        _southern_nations(table),
        "c_nationkey",
        F.col("c_mktsegment") == "BUILDING",
    )


@query(f"""
    WITH {_BALANCES_SQL}, cleared AS (
        SELECT * FROM current_rows WHERE NOT (owner = 'BUILDING' AND (custkey, slot) IN (
            SELECT (o_custkey, o_orderkey % 25) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')))
    )
    SELECT custkey, slot, outcome,
           CASE WHEN outcome IN ('inserted', 'replaced') THEN new_amount
                ELSE old_amount END AS amount,
           CASE WHEN outcome IN ('inserted', 'replaced') THEN 'MACHINERY'
                ELSE owner END AS owner
    FROM (
        SELECT custkey, slot, c.amount AS old_amount, i.amount AS new_amount, c.owner,
               CASE WHEN i.custkey IS NULL THEN 'kept'
                    WHEN c.custkey IS NULL THEN 'inserted'
                    WHEN c.owner = 'BUILDING' THEN 'replaced' ELSE 'conflict' END AS outcome
        FROM cleared c FULL JOIN incoming i USING (custkey, slot)
    )
""")
def switch_customer_owner(table: Tables) -> DataFrame:
    urgent = table("orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return switch_owner(
        _balances(table),
        _pending(table, "MACHINERY"),
        ["custkey", "slot"],
        F.col("owner") == "BUILDING",
        scope=urgent.select(F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 25).alias("slot")),
        scope_keys=["custkey", "slot"],
        registry=table("customer").select(F.col("c_mktsegment").alias("owner")),
    )


# --- names ------------------------------------------------------------------

# Short names of event types; `error` is left unknown.
_EVENT_ALIASES = {
    "view": "page_view",
    "click": "page_click",
    "purchase": "order_placed",
    "signup": "user_created",
}
_ALIAS_SQL = """
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'page_click'
         WHEN 'purchase' THEN 'order_placed' WHEN 'signup' THEN 'user_created' END
"""


@query(f"SELECT event_id, event_type, {_ALIAS_SQL} AS canonical FROM events")
def canonical_event_types(table: Tables) -> DataFrame:
    events = table("events").select("event_id", "event_type")
    return with_canonical(events, _EVENT_ALIASES, "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def rejected_event_types(table: Tables) -> DataFrame:
    events = table("events").select("event_id", "event_type")
    return alias_lookup(events, _EVENT_ALIASES, "event_type")[1]


@query("""
    SELECT o_orderkey AS orderkey, o_custkey AS custkey, c_name AS canonical
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def canonical_customer_names(table: Tables) -> DataFrame:
    aliases = table("customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("canonical")
    )
    orders = table("orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")
    )
    return with_canonical(orders, aliases, "custkey")


@query("""
    SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS taken FROM documents
""")
def tag_labelled_documents(table: Tables) -> DataFrame:
    return tag_known(
        table("documents").select("doc_id", "source"), table("labels"), "doc_id", "taken"
    )


@query("""
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def unlabelled_documents(table: Tables) -> DataFrame:
    documents = table("documents").select("doc_id", "source")
    return exists_guard(documents, table("labels"), "doc_id")[1]


@query("""
    SELECT page_id, CASE WHEN contains(bare, '://') THEN bare ELSE 'docker://' || bare END AS ref
    FROM (SELECT page_id, CASE WHEN url LIKE 'https://%' THEN substr(url, 9)
                          ELSE url END AS bare FROM pages)
""")
def normalize_page_refs(table: Tables) -> DataFrame:
    bare = F.regexp_replace("url", "^https://", "")
    return table("pages").select(
        "page_id", normalize_ref(bare, fixed.DEFAULT_SCHEME).alias("ref")
    )


# --- inventory --------------------------------------------------------------


def _document_items(table: Tables) -> DataFrame:
    return table("documents").select(
        "source", "lang", F.concat_ws("/", "source", "lang", "doc_id").alias("path")
    )


@query("""
    SELECT source, lang, count(*) OVER (PARTITION BY source, lang) AS n_files,
           lang || '/' || doc_id AS path FROM documents
""")
def inventory_documents(table: Tables) -> DataFrame:
    return inventory(_document_items(table), ["source", "lang"], prefix="source")


@query("""
    SELECT source, lang, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path
    FROM (SELECT source, lang, source || '/' || lang || '/' || doc_id AS path FROM documents)
    GROUP BY source, lang
""")
def inventory_document_counts(table: Tables) -> DataFrame:
    return inventory_counts(_document_items(table), ["source", "lang"])


@query("""
    SELECT event_type, key, count(*) AS n
    FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2
""")
def count_property_keys(table: Tables) -> DataFrame:
    keys = json_keys(table("events"), "props", by="event_type", distinct=False)
    return keys.groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("""
    SELECT DISTINCT p_type, unnest([p_brand, p_name]) AS key FROM part ORDER BY 1, 2
""")
def list_server_keys(table: Tables) -> DataFrame:
    servers = F.create_map("p_brand", "p_size", "p_name", "p_size")
    docs = table("part").select(
        "p_type", render_doc(servers.alias("servers")).alias("doc")
    )
    return json_keys(docs, "doc", field="servers", by="p_type", ordered=True)


@query("""
    SELECT source, lang, sum(strlen(text) + 1)::BIGINT AS n_bytes
    FROM documents GROUP BY source, lang
""")
def load_document_tree(table: Tables) -> DataFrame:
    """Write the documents as one folder tree per source, then read the tree."""
    documents = table("documents")
    spark = documents.sparkSession
    root = new_shared_path(spark, "tree")
    # By range rather than by hash: a large source spreads over many files.
    laid_out = documents.repartitionByRange("source", "lang", "doc_id").select(
        F.col("source").alias("profile"), F.col("lang").alias("item"), "text"
    )
    save_new(laid_out, root, "text", partition_by=["profile", "item"])
    name = F.element_at(F.split("profile", "="), -1)
    kind = F.element_at(F.split("item", "="), -1)
    return (
        load_items(spark, root)
        .groupBy(name.alias("source"), kind.alias("lang"))
        .agg(F.sum("n_bytes").alias("n_bytes"))
    )


def _host() -> Column:
    return F.substring_index(F.substring_index("url", "://", -1), "/", 1)


def _page_tree(table: Tables) -> str:
    """The root of a tree with a folder for each host, with many pages in a file.

    A page is its id, its text and a mark that ends it.
    """
    pages = table("pages")
    root = new_shared_path(pages.sparkSession, "pages")
    # By range, so that a large host spreads over several files.
    laid_out = pages.select(
        _host().alias("profile"),
        F.lit("pages").alias("item"),
        F.concat(F.col("page_id").cast("string"), F.lit("\n"), "html", F.lit(_PAGE_END)).alias("text"),
    ).repartitionByRange("profile", "text")
    save_new(laid_out, root, "text", partition_by=["profile", "item"])
    return root


_PAGE_END = "\x1e"


def _unlabelled(column: str) -> Column:
    return F.element_at(F.split(column, "="), -1)


@query("""
    SELECT page_id, sha256(html) AS content_sha256, strlen(html) AS n_bytes FROM pages
""")
def load_page_contents(table: Tables) -> DataFrame:
    """Write the pages of each host as files, then read them and take them apart."""
    root = _page_tree(table)
    loaded = load_items(table("pages").sparkSession, root, with_content=True)
    pages = loaded.select(F.explode(F.split("content", f"{_PAGE_END}\n")).alias("page")).where("page <> ''")
    html = F.substr("page", F.locate("\n", F.col("page")) + 1)
    return pages.select(
        F.substring_index("page", "\n", 1).cast("long").alias("page_id"),
        F.sha2(html.cast("binary"), 256).alias("content_sha256"),
        F.octet_length(html).cast("long").alias("n_bytes"),
    )


_FILES_A_FOLDER = 10_000


@query("""
    SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, strlen(html) + 1 AS n_bytes FROM pages
""")
def list_page_files(table: Tables) -> DataFrame:
    """Write each page as a file, then list the tree from the tasks."""
    pages = table("pages")
    root = new_shared_path(pages.sparkSession, "pages")
    host = F.regexp_extract("url", "://([^/]*)", 1)
    # Numbered as they are read, so that ids may repeat and no folder has very many files.
    numbered = pages.select(
        F.coalesce(F.concat(F.lit("host="), F.url_encode(host)), F.lit("none")).alias("profile"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("page"),
        F.concat("html", F.lit("\n")).alias("content"),
        F.monotonically_increasing_id().alias("n"),
    )
    shard = F.floor(F.col("n") / _FILES_A_FOLDER).cast("string")
    name = F.concat_ws("/", "profile", shard, F.concat_ws(".", "page", "n"))
    save_new_files(numbered.select(name.alias("name"), "content"), root)
    page = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    return list_items(numbered.select("profile").distinct(), root).select(
        F.when(page != "none", page).cast("long").alias("page_id"),
        F.when(F.col("profile") != "none", F.url_decode(_unlabelled("profile"))).alias("host"),
        F.nullif("n_bytes", F.lit(0)).alias("n_bytes"),
    )


# --- snapshots --------------------------------------------------------------


@query("""
    WITH RECURSIVE walk AS (
        SELECT conv_id, turn, turn AS reached, 0 AS hops FROM conversations
        UNION ALL
        SELECT w.conv_id, w.turn, c.turn, hops + 1 FROM walk w
        JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.reached - 1
    )
    SELECT conv_id, turn, min(reached) AS root_turn, max(hops) AS hops
    FROM walk WHERE turn > 0 GROUP BY conv_id, turn
""")
def dereference_turns(table: Tables) -> DataFrame:
    here = F.struct("conv_id", "turn")
    before = F.struct("conv_id", (F.col("turn") - 1).alias("turn"))
    links = table("conversations").where("turn > 0").select(
        here.alias("src"), before.alias("dst")
    )
    return dereference(links).select(
        "src.conv_id", "src.turn", F.col("target.turn").alias("root_turn"), "hops"
    )


@query("""
    WITH numbered AS (
        SELECT event_id, user_id % 2 = 0 AS ring,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n,
               min(event_id) OVER (PARTITION BY user_id) AS first
        FROM events
    )
    SELECT event_id, CASE WHEN NOT ring THEN first END AS target,
           CASE WHEN NOT ring THEN n END AS hops,
           CASE WHEN ring THEN 'loop' ELSE 'resolved' END AS status
    FROM numbered WHERE n > 0 OR ring
""")
def dereference_events(table: Tables) -> DataFrame:
    """Each event links to its user's event before; of every second user the
    first event links to the last, so theirs are rings."""
    before = Window.partitionBy("user_id").orderBy("event_id")
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.when(F.col("user_id") % 2 == 0, F.last("event_id").over(whole))
    links = table("events").select(
        F.col("event_id"), F.coalesce(F.lag("event_id").over(before), last).alias("dst")
    )
    return dereference(links.where("dst IS NOT NULL"), "event_id")


@query("""
    WITH found AS (
        SELECT c_custkey AS custkey, 'nation' AS item, n_name AS content, 1 AS hops
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'
        UNION ALL
        SELECT c_custkey, 'region', r_name, 2
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'
        UNION ALL
        SELECT c_custkey, 'segment', c_mktsegment, 0 FROM customer
    )
    SELECT custkey, item, content, hops, false AS filled FROM found
    UNION ALL
    SELECT c_custkey, i.item, 'no ' || i.item, -1, true
    FROM customer CROSS JOIN (VALUES ('nation'), ('region'), ('segment'), ('notes')) i (item)
    WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.custkey = c_custkey AND f.item = i.item)
""")
def capture_customers(table: Tables) -> DataFrame:
    """Each customer links to a nation and, through it, to a region; the files
    of some nations and of one region are missing."""
    customer, nation, region = table("customer"), table("nation"), table("region")

    def at(kind: str, key: str):
        return F.concat(F.lit(kind + "/"), F.col(key))

    own = F.explode(F.array(*[F.lit(i) for i in ("nation", "region", "segment")]))
    targets = customer.select(
        F.col("c_custkey").alias("custkey"), own.alias("item")
    ).withColumn("path", F.concat_ws("/", F.lit("customer"), "custkey", "item"))
    nation_link = F.struct(
        F.concat(at("customer", "c_custkey"), F.lit("/nation")).alias("src"),
        at("nation", "c_nationkey").alias("dst"),
    )
    region_link = F.struct(
        F.concat(at("customer", "c_custkey"), F.lit("/region")).alias("src"),
        at("region-of", "c_nationkey").alias("dst"),
    )
    links = customer.select(F.inline(F.array(nation_link, region_link))).union(
        nation.select(
            at("region-of", "n_nationkey"),
            at("region", "n_regionkey"),
        )
    )
    east = region.where("r_name = 'MIDDLE EAST'")
    content = (
        nation.join(east, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti")
        .select(at("nation", "n_nationkey").alias("path"), F.col("n_name").alias("content"))
        .union(region.where("r_name <> 'AFRICA'").select(at("region", "r_regionkey"), "r_name"))
        .union(
            customer.select(
                F.concat(at("customer", "c_custkey"), F.lit("/segment")), "c_mktsegment"
            )
        )
    )
    return capture(
        targets,
        links,
        content,
        entity="custkey",
        item="item",
        items=["nation", "region", "segment", "notes"],
        defaults={"content": F.concat(F.lit("no "), "item"), "hops": -1},
    ).select("custkey", "item", "content", "hops", "filled")


@query("""
    WITH found AS (
        SELECT source, lang AS item, doc_id::VARCHAR AS inside, n_chars, 0 AS hops FROM documents
        UNION ALL
        SELECT source, 'english', doc_id::VARCHAR, n_chars, 1 FROM documents WHERE lang = 'en'
    )
    SELECT source, item, inside, n_chars, hops, false AS filled FROM found
    UNION ALL
    SELECT s.source, i.item, NULL, 0, NULL, true
    FROM (SELECT DISTINCT source FROM documents) s
    CROSS JOIN (VALUES ('en'), ('fr'), ('de'), ('es'), ('english'), ('other')) i (item)
    WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.source = s.source AND f.item = i.item)
""")
def capture_document_folders(table: Tables) -> DataFrame:
    """Sources with a folder of documents per language, and a link to one of them."""
    documents = table("documents")
    folder = F.concat_ws("/", F.lit("docs"), "source", "lang")
    folders = documents.select("source", F.col("lang").alias("item"), folder.alias("path"))
    english = documents.where("lang = 'en'").select(
        "source", F.lit("english").alias("item"), F.concat(F.lit("links/"), "source").alias("path")
    )
    links = english.distinct().select(
        F.col("path").alias("src"), F.concat_ws("/", F.lit("docs"), "source", F.lit("en")).alias("dst")
    )
    content = documents.select(F.concat_ws("/", folder, "doc_id").alias("path"), "n_chars")
    return capture(
        folders.union(english).distinct(),
        links,
        content,
        entity="source",
        item="item",
        items=["en", "fr", "de", "es", "english", "other"],
        defaults={"n_chars": 0},
    ).select("source", "item", "inside", "n_chars", "hops", "filled")


@query("""
    WITH inside AS (
        SELECT n_regionkey AS region, n_nationkey AS nation, c_custkey::VARCHAR AS name, c_acctbal AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT n_regionkey, n_nationkey, 'suppliers/' || s_suppkey, s_acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
    )
    SELECT 'region' AS item, region::BIGINT AS key, 'members/' || nation || '/' || name AS inside, balance, 1 AS hops FROM inside
    UNION ALL
    SELECT 'nation', nation::BIGINT, name, balance, 2 FROM inside
    UNION ALL
    SELECT 'nation', n.n_nationkey::BIGINT, 'region/members/' || i.nation || '/' || i.name, i.balance, 2
    FROM nation n JOIN inside i ON i.region = n.n_regionkey AND i.nation <> n.n_nationkey
""")
def capture_region_folders(table: Tables) -> DataFrame:
    """Regions hold links to folders of nations, those to folders of suppliers and
    back to the region; each nation is asked for through the link to its region."""
    customer, nation, supplier = table("customer"), table("nation"), table("supplier")
    region = table("region").select(F.col("r_regionkey").alias("n_regionkey"))

    def path(*parts: str) -> Column:
        return F.concat_ws("/", *[F.col(p[1:]) if p[0] == "$" else F.lit(p) for p in parts])

    def pair(src: Column, dst: Column) -> Column:
        return F.struct(src.alias("src"), dst.alias("dst"))

    member = path("region", "$n_regionkey", "members", "$n_nationkey")
    home = path("nation", "$n_nationkey")
    of_nation = F.array(
        pair(member, home),
        pair(path("nation", "$n_nationkey", "region"), path("region", "$n_regionkey")),
        pair(path("nation", "$n_nationkey", "suppliers"), path("supplier", "$n_nationkey")),
    )
    world = region.select(path("world", "$n_regionkey"), path("region", "$n_regionkey"))
    links = nation.select(F.inline(of_nation)).union(world)
    content = customer.select(
        path("nation", "$c_nationkey", "$c_custkey").alias("path"), F.col("c_acctbal").alias("balance")
    ).union(supplier.select(path("supplier", "$s_nationkey", "$s_suppkey"), "s_acctbal"))
    targets = region.select(
        F.lit("region").alias("item"),
        F.col("n_regionkey").cast("long").alias("key"),
        path("world", "$n_regionkey").alias("path"),
    ).union(
        nation.select(
            F.lit("nation"),
            F.col("n_nationkey").cast("long"),
            path("world", "$n_regionkey", "members", "$n_nationkey"),
        )
    )
    got = capture(targets, links, content, entity="key", item="item")
    return got.select("item", "key", "inside", "balance", "hops")


@query("""
    SELECT coalesce(c_custkey, s_suppkey) AS custkey,
           CASE WHEN c_custkey IS NULL OR (s_suppkey IS NOT NULL AND c_mktsegment = 'BUILDING')
                THEN 'supplier' ELSE c_mktsegment END AS owner,
           CASE WHEN c_custkey IS NULL OR (s_suppkey IS NOT NULL AND c_mktsegment = 'BUILDING')
                THEN s_acctbal ELSE c_acctbal END AS balance
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
    WHERE NOT (coalesce(c_custkey, s_suppkey) IN (SELECT n_nationkey FROM nation)
               AND (c_custkey IS NULL OR (s_suppkey IS NOT NULL AND c_mktsegment = 'BUILDING')))
""")
def change_customer_state(table: Tables) -> DataFrame:
    """Keep the customers as a state in buckets, write the suppliers over it, remove
    what is theirs of the keys of nations, and read the state."""
    customer = table("customer").select(
        F.col("c_custkey").alias("custkey"),
        F.col("c_mktsegment").alias("owner"),
        F.col("c_acctbal").alias("balance"),
    )
    incoming = table("supplier").select(
        F.col("s_suppkey").alias("custkey"), F.lit("supplier").alias("owner"), F.col("s_acctbal").alias("balance")
    )
    scope = table("nation").select(F.col("n_nationkey").cast("long").alias("custkey"))
    spark = customer.sparkSession
    root = new_shared_path(spark, "state")
    create_state(customer, root, "custkey", 16)
    apply_to_state(spark, root, incoming, "custkey", F.col("owner") == "BUILDING")
    remove_from_state(spark, root, scope, "custkey", F.col("owner") == "supplier")
    return read_state(spark, root)


@query("""
    SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+/.+') THEN
               CASE WHEN url LIKE 'https:%' THEN 'new ' ELSE 'old ' END || split_part(url, '/', 3) END AS owner
    FROM pages
""")
def own_pages_by_root(table: Tables) -> DataFrame:
    """Pages belong to the host they are below, by its old or new root."""
    pages = table("pages").select("page_id", "url")
    host = F.split_part("url", F.lit("/"), F.lit(3))

    def roots(scheme: str, name: str) -> DataFrame:
        return pages.select(
            F.concat(F.lit(f"{scheme}://"), host).alias("root"), F.concat(F.lit(f"{name} "), host).alias("owner")
        ).distinct()

    both = roots("http", "old").union(roots("https", "new"))
    return owner_of(pages, both, "url").select("page_id", "owner")


# --- profile workflows ------------------------------------------------------

_ITEM_VALUES_SQL = ", ".join(f"('{i}', '{t}')" for i, t in fixed.ITEM_TARGETS.items())


def _customer_registry(table: Tables) -> DataFrame:
    has_gateway = F.col("c_acctbal") >= 0
    return table("customer").select(
        F.col("c_name").alias("profile"),
        F.when(has_gateway, F.concat(F.lit("gw-"), "c_custkey")).alias("gateway_id"),
        "c_custkey",
    )


_REGISTRY_SQL = """
    registry AS (
        SELECT c_name AS profile, CASE WHEN c_acctbal >= 0 THEN 'gw-' || c_custkey END AS gateway_id,
               c_custkey FROM customer
    )
"""


def _quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _gateway_start(keys_in_order: bool) -> str:
    """A gateway document up to its id, as JSON text without spaces."""
    args = json.dumps([*fixed.GATEWAY_ARGS, ""], separators=(",", ":"))[: -len('"]')]
    command = f'"command":{json.dumps(fixed.GATEWAY_COMMAND)},'
    entry = f'"args":{args}' if keys_in_order else f'{command}"args":{args}'
    return _quoted(f'{{"{fixed.SERVERS_FIELD}":{{"{fixed.GATEWAY_NAME}":{{{entry}')


_GATEWAY_SQL = _gateway_start(keys_in_order=False)
_SORTED_GATEWAY_SQL = _gateway_start(keys_in_order=True)
_BLANK_SQL = f"""
    CASE WHEN item = 'mcp.json' THEN {_quoted(fixed.BLANK_SERVERS)}
         WHEN item = 'settings.json' THEN {_quoted(fixed.BLANK_SETTINGS)}
         WHEN item LIKE '%.json' THEN {_quoted(fixed.BLANK_JSON)}
         WHEN item LIKE '%.md' THEN {_quoted(fixed.BLANK_TEXT)} END
"""


@query(f"""
    WITH {_REGISTRY_SQL}
    SELECT profile, item,
           CASE WHEN item LIKE '%.json' OR item LIKE '%.md' THEN item END AS path,
           CASE WHEN item = 'mcp.json' AND gateway_id IS NOT NULL
                    THEN {_GATEWAY_SQL} || gateway_id || '"]}}}}}}'
                ELSE {_BLANK_SQL} END AS content
    FROM registry CROSS JOIN (VALUES {_ITEM_VALUES_SQL}) i (item, target)
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def create_customer_profiles(table: Tables) -> DataFrame:
    """Profiles of all customers; those with a pending order exist already."""
    names = _customer_registry(table)
    pending = table("orders").where("o_orderstatus = 'P'")
    existing = names.join(
        pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    )
    return profiles.create_profiles(names, existing)[0]


_SERVERS_SQL = f"""
    SELECT profile,
           CASE WHEN doc IS NULL THEN 'absent' WHEN seg = 'AUTOMOBILE' THEN 'invalid'
                WHEN seg = 'BUILDING' THEN 'empty' ELSE 'merged' END AS status,
           CASE seg WHEN 'FURNITURE' THEN
                         '{{"mcpServers":{{"MCP_DOCKER":{{"nation":' || nat || '}}}}}}'
                    WHEN 'HOUSEHOLD' THEN {_SORTED_GATEWAY_SQL} || gateway_id
                         || '"],"command":"docker"}},"remote":{{"url":"http://' || profile || '/"}}}}}}'
                    ELSE {_SORTED_GATEWAY_SQL} || gateway_id || '"],"command":"docker"}}}}}}'
                    END AS content
    FROM (SELECT r.*, c_mktsegment AS seg, c_nationkey AS nat,
                 CASE WHEN c_mktsegment <> 'MACHINERY' THEN 1 END AS doc
          FROM registry r JOIN customer c USING (c_custkey))
    WHERE gateway_id IS NOT NULL
"""


def _customer_extras(table: Tables) -> DataFrame:
    """Extra servers of every kind, depending on the segment."""
    segment = F.col("c_mktsegment")
    remote = F.struct(F.concat(F.lit("http://"), "c_name", F.lit("/")).alias("url"))
    extra = (
        F.when(segment == "AUTOMOBILE", F.lit('{"mcpServers": ['))
        .when(segment == "BUILDING", F.lit('{"other": 1}'))
        .when(
            segment == "FURNITURE",
            render_doc(
                F.struct(
                    F.struct(F.col("c_nationkey").alias("nation")).alias(fixed.GATEWAY_NAME)
                ).alias(fixed.SERVERS_FIELD)
            ),
        )
        .when(
            segment == "HOUSEHOLD",
            render_doc(F.struct(remote.alias("remote")).alias(fixed.SERVERS_FIELD)),
        )
    )
    return table("customer").select(
        F.col("c_name").alias("profile"), extra.alias("content")
    )


@query(f"WITH {_REGISTRY_SQL} {_SERVERS_SQL}")
def merge_customer_servers(table: Tables) -> DataFrame:
    registry, extras = _customer_registry(table), _customer_extras(table)
    return profiles.server_docs(registry, extras).select("profile", "status", "content")


def _part_items(table: Tables) -> DataFrame:
    name = F.array(*[F.lit(i) for i in profiles.ITEMS])
    return (
        table("lineitem")
        .groupBy(
            F.concat(F.lit("part-"), "l_partkey").alias("profile"),
            F.get(name, F.col("l_linenumber") - 1).alias("item"),
        )
        .agg(
            F.max("l_orderkey").cast("string").alias("path"),
            F.max("l_returnflag").alias("content"),
        )
    )


_PART_ITEMS_SQL = f"""
    items AS (SELECT item, target, row_number() OVER () AS n
              FROM (VALUES {_ITEM_VALUES_SQL}) v (item, target)),
    present AS (
        SELECT 'part-' || l_partkey AS profile, item, max(l_orderkey)::VARCHAR AS path,
               max(l_returnflag) AS content
        FROM lineitem JOIN items ON n = l_linenumber GROUP BY 1, 2
    )
"""


@query(f"""
    WITH {_PART_ITEMS_SQL}
    SELECT profile, item, path, content, false AS filled FROM present
    UNION ALL
    SELECT profile, item,
           CASE WHEN item LIKE '%.json' OR item LIKE '%.md' THEN item END,
           {_BLANK_SQL}, true
    FROM (SELECT 'part-' || p_partkey AS profile FROM part) CROSS JOIN items
    WHERE (profile, item) NOT IN (SELECT profile, item FROM present)
""")
def complete_part_items(table: Tables) -> DataFrame:
    registry = table("part").select(F.concat(F.lit("part-"), "p_partkey").alias("profile"))
    return profiles.complete_items(_part_items(table), registry)


@query(f"""
    WITH {_REGISTRY_SQL}, {_PART_ITEMS_SQL}, docs AS ({_SERVERS_SQL}), base AS (
        SELECT c_name AS profile, i.item, i.item AS path, 'old' AS content
        FROM customer CROSS JOIN items i WHERE i.item LIKE '%.json'
    )
    SELECT profile, b.item, b.path, coalesce(d.content, b.content) AS content
    FROM base b LEFT JOIN (SELECT *, 'mcp.json' AS item FROM docs) d USING (profile, item)
""")
def sync_customer_servers(table: Tables) -> DataFrame:
    files = [F.lit(i) for i in profiles.ITEMS if i.endswith(".json")]
    items = table("customer").select(
        F.col("c_name").alias("profile"), F.explode(F.array(*files)).alias("item")
    )
    items = items.withColumns({"path": F.col("item"), "content": F.lit("old")})
    return profiles.sync_servers(items, _customer_registry(table), _customer_extras(table))


def _customer_targets(table: Tables) -> DataFrame:
    """Per customer: a foreign target, linked ones, and one outside the map."""
    status = F.col("o_orderstatus")
    target = (
        F.when(status == "F", ".mcp.json")
        .when(status == "O", ".claude/settings.json")
        .otherwise("README")
    )
    last = F.max("o_orderpriority")
    return (
        table("orders")
        .groupBy(F.col("o_custkey").alias("scope"), target.alias("target"))
        .agg(last.alias("value"))
        .withColumn(
            "owner", F.when(F.col("target") == ".claude/settings.json", F.col("value"))
        )
    )


_TARGETS_SQL = """
    targets AS (
        SELECT o_custkey AS scope, CASE o_orderstatus WHEN 'F' THEN '.mcp.json'
                   WHEN 'O' THEN '.claude/settings.json' ELSE 'README' END AS target,
               max(o_orderpriority) AS value,
               CASE WHEN o_orderstatus = 'O' THEN max(o_orderpriority) END AS owner
        FROM orders GROUP BY o_custkey, o_orderstatus
    ), log AS (
        SELECT o_custkey AS scope,
               CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS profile
        FROM orders
        QUALIFY row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    )
"""


def _activation_log(table: Tables) -> DataFrame:
    return table("orders").select(
        F.col("o_custkey").alias("scope"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("profile"),
        "o_orderdate",
        "o_orderkey",
    )


_LOG_ORDER = ["o_orderdate", "o_orderkey"]


@query(f"""
    WITH {_TARGETS_SQL}, wanted AS MATERIALIZED (
        SELECT scope, i.target, profile || '/' || i.item AS value, profile AS owner
        FROM log CROSS JOIN (VALUES {_ITEM_VALUES_SQL}) i (item, target)
        WHERE profile IS NOT NULL
    ), both_sides AS MATERIALIZED (
        SELECT coalesce(t.scope, w.scope) AS scope, coalesce(t.target, w.target) AS target,
               t.scope IS NOT NULL AS held, w.scope IS NOT NULL AS asked, t.value AS old_value,
               t.owner AS old_owner, w.value AS new_value, w.owner AS new_owner
        FROM targets t FULL JOIN wanted w ON t.scope = w.scope AND t.target = w.target
    )
    SELECT scope, target,
           CASE WHEN asked AND (NOT held OR old_owner IS NOT NULL) THEN new_value ELSE old_value END AS value,
           CASE WHEN asked AND (NOT held OR old_owner IS NOT NULL) THEN new_owner ELSE old_owner END AS owner,
           CASE WHEN NOT asked THEN 'kept' WHEN NOT held THEN 'inserted'
                WHEN old_owner IS NOT NULL THEN 'replaced' ELSE 'conflict' END AS outcome
    FROM both_sides
""")
def activate_customer_profiles(table: Tables) -> DataFrame:
    requests = profiles.current_profiles(_activation_log(table), _LOG_ORDER)
    registry = table("orders").select(F.col("o_orderpriority").alias("profile"))
    return profiles.activate(_customer_targets(table), requests, registry)


@query(f"""
    WITH {_TARGETS_SQL}
    SELECT n.scope, n.profile, coalesce(n.profile = log.profile, false) AS is_active
    FROM (SELECT DISTINCT o_custkey AS scope, o_orderpriority AS profile FROM orders) n
    JOIN log USING (scope)
""")
def list_customer_profiles(table: Tables) -> DataFrame:
    names = table("orders").select(
        F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("profile")
    )
    return profiles.list_profiles(names.distinct(), _activation_log(table), _LOG_ORDER)


@query(f"""
    WITH {_TARGETS_SQL}
    SELECT t.scope, t.target, t.value, t.owner FROM targets t JOIN log l USING (scope)
    WHERE NOT (t.owner IS NOT NULL AND l.profile IS NOT NULL)
""")
def deactivate_customer_profiles(table: Tables) -> DataFrame:
    scopes = table("customer").select(F.col("c_custkey").alias("scope"))
    return profiles.deactivate(
        _customer_targets(table), scopes, _activation_log(table), _LOG_ORDER
    )


def _shown_parts(table: Tables) -> tuple[DataFrame, DataFrame]:
    name = F.array(*[F.lit(i) for i in profiles.ITEMS])
    items = table("lineitem").select(
        F.concat(F.lit("part-"), "l_partkey").alias("profile"),
        F.get(name, F.col("l_linenumber") - 1).alias("item"),
        F.col("l_orderkey").cast("string").alias("path"),
    )
    registry = table("part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("profile"),
        F.when(F.col("p_size") <= 25, F.col("p_name")).alias("gateway_id"),
    )
    return items, registry


_SHOWN_PARTS_SQL = f"""
    SELECT 'part-' || l_partkey AS profile, item, target, count(*) AS n_files,
           CASE WHEN p_size <= 25 THEN 'gateway' ELSE 'manual' END AS servers,
           p_size <= 25 AND p_partkey IN (SELECT s_suppkey FROM supplier) AS has_extras
    FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN (SELECT item, target, row_number() OVER () AS n
          FROM (VALUES {_ITEM_VALUES_SQL}) v (item, target)) ON n = l_linenumber
    GROUP BY ALL
"""


@query(f"SELECT profile, item, target, n_files, servers FROM ({_SHOWN_PARTS_SQL})")
def show_part_profiles(table: Tables) -> DataFrame:
    items, registry = _shown_parts(table)
    return profiles.show_profiles(items, registry).select(
        "profile", "item", "target", "n_files", "servers"
    )


@query(_SHOWN_PARTS_SQL)
def show_part_extras(table: Tables) -> DataFrame:
    """The same, where suppliers keep servers by hand for the parts of their number."""
    items, registry = _shown_parts(table)
    extras = table("supplier").select(F.concat(F.lit("part-"), "s_suppkey").alias("profile"))
    return profiles.show_profiles(items, registry, extras)
