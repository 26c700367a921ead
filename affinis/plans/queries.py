"""Queries over the star schema and text tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions import identifiers as I
from affinis.functions import literals as L
from affinis.functions import paths as P
from affinis.functions import scores as S
from affinis.keeping import dealt, shared_folder, tasks_for
from affinis.operators import anchors, basins, bridge, cochange, discover, facts, graph, heat, imports, order, resolve, reveal, seeds
from affinis.sources import files
from affinis.sources.store import FactStore
from affinis.streaming import baseline, provenance, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Today, for events, and for orders, which end earlier.
NOW, LAST = "2024-01-01 00:00:00", "2002-01-01 00:00:00"
#: Rows of edges that a task brings together.
PAIRS_A_TASK = 1_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and parts as one graph: what was ordered together is near."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o = F.col("o_orderkey") * 4 + 1
    a = orders.select((F.col("o_custkey") * 4).alias("src"), o.alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("w"))
    b = items.select((F.col("l_orderkey") * 4 + 1).alias("src"), (F.col("l_partkey") * 4 + 2).alias("dst"), F.lit("invokes").alias("kind"), F.lit(0.7).alias("w"))
    return a.unionByName(b)


EDGES_SQL = """
e0 AS (SELECT o_custkey * 4 AS src, o_orderkey * 4 + 1 AS dst, 1.0::DOUBLE AS w FROM orders
       UNION ALL SELECT l_orderkey * 4 + 1, l_partkey * 4 + 2, 0.7::DOUBLE FROM lineitem),
e1 AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS w FROM e0 WHERE src <> dst GROUP BY ALL),
both_ways AS (SELECT src, dst, w FROM e1 UNION ALL SELECT dst, src, w FROM e1),
deg AS (SELECT src AS node, sum(w) AS d FROM both_ways GROUP BY src)"""


def heat_sql(t: float, rounded: str) -> str:
    order = min(90, math.ceil(2.2 * t) + 16)
    return f"""
WITH RECURSIVE {EDGES_SQL},
m AS (SELECT b.src, b.dst, -b.w / (sqrt(x.d) * sqrt(y.d)) AS m FROM both_ways b JOIN deg x ON x.node = b.src JOIN deg y ON y.node = b.dst),
first_customer AS (SELECT min(o_custkey) * 4 AS node FROM orders),
r AS (
  SELECT 0 AS k, node AS n, CASE WHEN node = (SELECT node FROM first_customer) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cur, 0.0::DOUBLE AS prev FROM deg
  UNION ALL
  SELECT r.k + 1, r.n, (CASE WHEN r.k = 0 THEN 1 ELSE 2 END) * coalesce(s.v, 0) - r.prev, r.cur
  FROM r LEFT JOIN (SELECT q.k, m.dst AS n, sum(m.m * q.cur) AS v FROM r q JOIN m ON m.src = q.n GROUP BY q.k, m.dst) s ON s.n = r.n AND s.k = r.k
  WHERE r.k < {order}),
c AS (SELECT k, (CASE WHEN k = 0 THEN 1 ELSE 2 * pow(-1, k) END) * sum(exp((2 * m + k) * ln({t} / 2) - lgamma(m + 1) - lgamma(m + k + 1) - {t})) AS c FROM range({order} + 1) a(k), range(120) b(m) GROUP BY k),
heat AS (SELECT r.n AS node, sum(c.c * r.cur) AS heat FROM r JOIN c USING (k) GROUP BY r.n)
{rounded}"""


def purchase_heat(spark: SparkSession, sf_dir: str, t: float, kernel: bool | None = None) -> DataFrame:
    edges = purchase_edges(spark, sf_dir)
    start = table(spark, sf_dir, "orders").agg((F.min("o_custkey") * 4).alias("node"), F.lit(1.0).alias("mass"))
    return heat.heat(graph.kept(graph.conductance(edges, tasks_for(edges, PAIRS_A_TASK))), start, t, kernel=kernel)


@query(heat_sql(2.0, "SELECT node, round(heat, 9) AS heat FROM heat"))
def heat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_heat(spark, sf_dir, 2.0).select("node", F.round("heat", 9).alias("heat"))


@query(heat_sql(4.0, "SELECT node, round(heat, 7) AS heat FROM heat"))
def heat_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_heat(spark, sf_dir, 4.0).select("node", F.round("heat", 7).alias("heat"))


@query(heat_sql(2.0, """SELECT n_name AS folder, round(sum(heat), 7) AS mass, count(DISTINCT node) AS files
FROM heat JOIN customer ON node = c_custkey * 4 JOIN nation ON n_nationkey = c_nationkey WHERE heat > 1e-9 GROUP BY n_name"""))
def impact_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    warm = purchase_heat(spark, sf_dir, 2.0).where("heat > 1e-9")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 4).alias("node"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("name"))
    rows = warm.join(c, "node").join(table(spark, sf_dir, "nation"), "n_nationkey")
    rows = rows.select("node", F.col("n_name").alias("folder"), F.col("node").alias("file"), "name", F.lit("function").alias("kind"), "heat")
    return reveal.rollup(graph.kept(rows), F.col("folder"), F.lit(False)).select("folder", F.round("mass", 7).alias("mass"), F.col("files").cast("long").alias("files"))


@query(heat_sql(2.0, """, ranked AS (
  SELECT node, heat / max(heat) OVER () AS h, heat FROM heat),
 lit AS (SELECT node, h, heat, row_number() OVER (ORDER BY (node = (SELECT node FROM first_customer)) DESC, round(heat, 9) DESC, node) AS rank FROM ranked WHERE h >= 0.002 AND heat >= 1e-9)
SELECT rank, node, CASE WHEN h >= 0.3 OR node = (SELECT node FROM first_customer) THEN 'hot' WHEN h >= 0.02 THEN 'warm' ELSE 'glow' END AS tier FROM lit WHERE rank <= 400""").replace("\n, ranked", ", ranked"))
def reveal_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "orders").agg((F.min("o_custkey") * 4).alias("seed"))
    rows = purchase_heat(spark, sf_dir, 2.0).withColumn("heat", F.round("heat", 9)).crossJoin(F.broadcast(start))
    rows = rows.select(F.col("node").alias("id"), F.lit("").alias("name"), F.lit("file").alias("kind"), F.lit("").alias("file"), F.col("node").alias("line"), "heat", (F.col("node") == F.col("seed")).alias("is_seed"), F.lit(None).cast("string").alias("relation"))
    return reveal.tiers(rows).select(F.col("rank").cast("long").alias("rank"), F.col("id").alias("node"), "tier")


@query(f"WITH {EDGES_SQL} SELECT node, round(d, 6) AS d FROM deg")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = purchase_edges(spark, sf_dir)
    return graph.degrees(graph.conductance(edges, tasks_for(edges, PAIRS_A_TASK))).select("node", F.round("d", 6).alias("d"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem),
 b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
 r AS (SELECT min(l_suppkey) AS node, 0 AS hop FROM lineitem UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 8)
SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst"))
    return graph.hops(edges, items.agg(F.min("l_suppkey").alias("node")))


HREFS_SQL = """
sites AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS text FROM pages),
kinds AS (SELECT page_id, trim(text) AS t, CASE WHEN length(trim(text)) < 3 OR length(trim(text)) > 200 THEN NULL
  WHEN regexp_matches(trim(text), '^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$') THEN 'env'
  WHEN regexp_matches(regexp_replace(trim(text), '^(?:https?|wss?)://[^/]+', ''), '^(?:/[\\w.~+\\-{}*:$]+/?|/?[\\w.~+\\-]+(?:/[\\w.~+\\-{}*:$]+)+/?)$') THEN 'path'
  WHEN regexp_matches(trim(text), '^[A-Za-z][\\w$.\\-]{6,63}$') AND (contains(trim(text), '.') OR contains(trim(text), '-') OR contains(trim(text), '_') OR regexp_matches(substr(trim(text), 2), '[A-Z][a-z]')) THEN 'word' END AS kind FROM sites),
keys AS (SELECT page_id, kind, CASE kind WHEN 'env' THEN upper(t) WHEN 'word' THEN t ELSE regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '^(?:https?|wss?)://[^/]+', ''), '/'),
  lambda s: CASE WHEN regexp_matches(s, '^(?::[^/]+|\\{[^}/]*\\}|\\$\\{[^}/]*\\}|\\$[A-Za-z_]\\w*|<[^/>]+>|\\*+)$') THEN '{*}' ELSE s END), '/'), '(.)/$', '\\1') END AS key FROM kinds WHERE kind IS NOT NULL),
df AS (SELECT key, min(kind) AS kind, count(DISTINCT page_id) AS df FROM keys GROUP BY key),
total AS (SELECT sum(df) AS total FROM df),
spec AS (SELECT key, kind, df, least(1.0, ln(total / greatest(df, 1)) / ln(greatest(total, 2))) AS spec FROM df, total)"""


def href_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("line", "text"))
    return each.select(F.col("page_id").alias("file"), F.col("page_id").alias("node"), "line", "text")


@query(f"WITH {HREFS_SQL} SELECT key, kind, df, round(spec, 9) AS spec FROM spec")
def literal_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.document_frequency(bridge.keyed(href_sites(spark, sf_dir))).select("key", "kind", "df", F.round("spec", 9).alias("spec"))


@query(f"""WITH {HREFS_SQL},
once AS (SELECT DISTINCT key, page_id FROM keys),
w AS (SELECT key, CASE kind WHEN 'path' THEN 1.0 WHEN 'env' THEN 0.8 ELSE 0.55 END * (0.25 + 0.75 * spec) / greatest(1.0, df / 6.0) AS w FROM spec WHERE df BETWEEN 2 AND 48)
SELECT a.page_id AS a, b.page_id AS b, round(max(w.w), 9) AS w FROM once a JOIN once b ON a.key = b.key AND a.page_id < b.page_id JOIN w ON w.key = a.key GROUP BY ALL""")
def literal_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.bridges(href_sites(spark, sf_dir)).select("a", "b", F.round("w", 9).alias("w"))


@query(f"""WITH {HREFS_SQL},
o AS (SELECT key, page_id, row_number() OVER (PARTITION BY key ORDER BY page_id) AS k FROM keys)
SELECT o.key, count(*) AS occurrences, min(page_id) AS first_file, max(page_id) AS last_file FROM o WHERE k <= 192 GROUP BY o.key""")
def literal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = bridge.index(href_sites(spark, sf_dir))
    return occ.select("key", F.size("occ").cast("long").alias("occurrences"), F.array_min("occ.file").alias("first_file"), F.array_max("occ.file").alias("last_file"))


@query(f"""WITH {HREFS_SQL} SELECT page_id, count(*) AS sites, count(kind) AS literals FROM kinds GROUP BY page_id""")
def literal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return href_sites(spark, sf_dir).withColumn("kind", L.classify(F.col("text"))).groupBy(F.col("file").alias("page_id")).agg(F.count("*").alias("sites"), F.count("kind").alias("literals"))


def cochange_sql(item: str, select: str) -> str:
    return f"""
WITH i AS (SELECT DISTINCT l_orderkey AS c, {item} AS item FROM lineitem),
ok AS (SELECT c FROM i GROUP BY c HAVING count(*) BETWEEN 2 AND 24),
x AS (SELECT i.c, i.item, o.o_orderdate AS ts FROM i JOIN ok USING (c) JOIN orders o ON o.o_orderkey = i.c),
solo AS (SELECT item, count(*) AS solo FROM x GROUP BY item),
p AS (SELECT a.item AS a, b.item AS b, count(*) AS n, max(greatest(a.ts, b.ts)) AS last_ts FROM x a JOIN x b ON a.c = b.c AND a.item < b.item GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT p.*, least(0.5, 0.08 + 0.55 * n / (sa.solo + sb.solo - n) + 0.10 * least(n / 10, 1.0)) AS w FROM p JOIN solo sa ON sa.item = p.a JOIN solo sb ON sb.item = p.b),
eff AS (SELECT *, w * pow(0.5, greatest(0, date_diff('microsecond', last_ts, TIMESTAMP '{LAST}') / 86400000000.0) / 30) AS eff FROM s),
ends AS (SELECT a, b, w, last_ts, a AS item, b AS partner FROM eff UNION ALL SELECT a, b, w, last_ts, b, a FROM eff),
top AS (SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(ln(w) - greatest(0, date_diff('microsecond', last_ts, TIMESTAMP '{LAST}') / 86400000000.0) * ln(2) / 30, 9) DESC, partner) AS k FROM ends) WHERE k <= 16)
{select}"""


def commit_rows(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"))
    items = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(item).alias("item")), "l_orderkey")
    return items.distinct().join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "commit")


@query(cochange_sql("l_suppkey", "SELECT a, b, n, round(w, 9) AS w, last_ts FROM eff JOIN top USING (a, b)"))
def cochange_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(LAST).cast("timestamp_ntz")
    return cochange.kept(cochange.pairs(commit_rows(spark, sf_dir, "l_suppkey")), now).select("a", "b", "n", F.round("w", 9).alias("w"), "last_ts")


@query(cochange_sql("l_partkey", "SELECT a, b, n, round(w, 9) AS w FROM s"))
def cochange_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.pairs(commit_rows(spark, sf_dir, "l_partkey")).select("a", "b", "n", F.round("w", 9).alias("w"))


@query(cochange_sql("l_suppkey", """, sd AS (SELECT DISTINCT s_suppkey AS item FROM supplier WHERE s_nationkey = 0),
b2 AS (SELECT a AS item, b AS partner, eff FROM eff UNION ALL SELECT b, a, eff FROM eff)
SELECT partner, round(max(eff), 12) AS w FROM b2 JOIN sd USING (item) WHERE partner NOT IN (SELECT item FROM sd) GROUP BY partner HAVING max(eff) > 1e-6""").replace("\n, sd", ", sd"))
def history_reseed(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("item"))
    out = cochange.reseed(start, cochange.pairs(commit_rows(spark, sf_dir, "l_suppkey")), F.lit(LAST).cast("timestamp_ntz"))
    return out.select("partner", F.round("w", 12).alias("w"))


SUPPLIER_EDGES_SQL = cochange_sql("l_suppkey", """, g AS (SELECT a AS src, b AS dst, round(w, 9) AS w FROM eff JOIN top USING (a, b)),
adj AS (SELECT src AS node, dst AS nb, w FROM g UNION ALL SELECT dst, src, w FROM g),
near AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, nb) AS k FROM adj)
""").replace("\n, g", ", g")


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange_suppliers(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("join").alias("kind"), "w")


@query(SUPPLIER_EDGES_SQL + "SELECT node, nb AS neighbour, w, k AS rank FROM near")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(supplier_edges(spark, sf_dir)).select("node", F.col("to").alias("neighbour"), "w", F.col("rank").cast("long").alias("rank"))


@query(SUPPLIER_EDGES_SQL + """, pairs AS (SELECT x.node, x.nb AS p, y.nb AS q FROM near x JOIN near y ON x.node = y.node AND x.k < y.k WHERE x.k <= 12 AND y.k <= 12),
hit AS (SELECT DISTINCT node, nb FROM adj)
SELECT n.node, round(coalesce(t.tri, 0), 9) AS tri FROM (SELECT DISTINCT node FROM adj) n LEFT JOIN (SELECT p.node, count(h.nb) / count(*) AS tri FROM pairs p LEFT JOIN hit h ON h.node = p.p AND h.nb = p.q GROUP BY p.node) t USING (node)""")
def triangle_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_density(graph.neighbours(supplier_edges(spark, sf_dir))).select("node", F.round("tri", 9).alias("tri"))


@query()
def supplier_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins among pages over the bridges of at least 0.3, which are the graph here."""
    near = literal_bridges(spark, sf_dir).where("w >= 0.3").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("join").alias("kind"), "w")
    edges = graph.kept(near)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().select("node", F.lit(True).alias("eligible"), F.lit(True).alias("include"))
    return basins.detect(edges, nodes)


@query("""
SELECT e.event_id AS site, coalesce(s.event_id, -1) AS symbol FROM events e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON e.user_id = s.user_id AND e.ts >= s.ts
WHERE e.event_type <> 'signup'""")
def asof_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("line"), "event_id", "event_type")
    sites = e.where("event_type <> 'signup'").select("file", "line", F.col("event_id").alias("site"))
    return resolve.enclosing(sites, e.where("event_type = 'signup'").select("file", "line", F.col("event_id").alias("symbol"))).select("site", F.coalesce("symbol", F.lit(-1)).alias("symbol"))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey, s_suppkey % 50 AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_custkey % 50 AS key FROM customer JOIN nation ON n_nationkey = c_nationkey),
few AS (SELECT key, count(*) AS candidates FROM s GROUP BY key HAVING count(*) <= 48),
j AS (SELECT c_custkey, s_suppkey, candidates, CASE WHEN c_nationkey = s_nationkey THEN 0 WHEN c.n_regionkey = s.n_regionkey THEN 1 WHEN candidates = 1 THEN 2 END AS tier FROM c JOIN s USING (key) JOIN few USING (key)),
n AS (SELECT *, min(tier) OVER (PARTITION BY c_custkey) AS nearest FROM j WHERE tier IS NOT NULL),
k AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS chosen FROM n WHERE tier = nearest)
SELECT c_custkey AS call, s_suppkey AS target, tier, candidates, CASE WHEN candidates <= 8 THEN 0.7 WHEN candidates <= 24 THEN 0.45 ELSE 0.25 END::DOUBLE AS w FROM k WHERE chosen <= 3""")
def tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 50).alias("key"), F.col("s_suppkey").alias("target"), "s_nationkey", F.col("n_regionkey").alias("s_region"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("call"), (F.col("c_custkey") % 50).alias("key"), "c_nationkey", F.col("n_regionkey").alias("c_region"))
    return resolve.tiered(c, s, ["c_nationkey = s_nationkey", "c_region = s_region", "candidates = 1"])


@query("""
WITH f AS (SELECT page_id, regexp_replace(url, '^(?:https?|wss?)://', '') AS file FROM pages),
p AS (SELECT file, string_split(file, '/') AS s FROM f),
t AS (SELECT file, unnest([array_to_string(s[-k:], '/') for k in range(1, least(len(s), 3) + 1)]) AS suffix FROM p),
u AS (SELECT suffix, min(file) AS target FROM t GROUP BY suffix HAVING count(*) = 1),
i AS (SELECT page_id AS site, array_to_string(string_split(file, '/')[-2:], '/') AS spec FROM f)
SELECT site, spec, target FROM i JOIN u ON u.suffix = i.spec""")
def suffix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^(?:https?|wss?)://", "").alias("file"))
    parts = F.split("file", "/")
    two = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(F.col("file"))
    return resolve.by_suffix(f.select(F.col("page_id").alias("site"), two.alias("spec")), f.select("file"), ["", ".html"])


@query("""
WITH t AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1) AS terms FROM part),
s AS (SELECT p_partkey, list_transform(terms, lambda x: CASE WHEN length(x) > 5 AND ends_with(x, 'ing') THEN left(x, length(x) - 3) WHEN length(x) > 4 AND ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y'
 WHEN length(x) > 4 AND regexp_matches(x, '(ches|shes|sses|xes|zes)$') THEN left(x, length(x) - 2) WHEN length(x) > 3 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END) AS terms FROM t)
SELECT p_partkey, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM s""")
def identifier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(I.terms(F.col("p_name"))), " ").alias("terms"))


@query("""
WITH n AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS a, 'supplier000000007' AS b FROM supplier),
g AS (SELECT s_suppkey, a, b, [substr(a, i::BIGINT, 2) for i in range(1, length(a))] AS pa, [substr(b, i::BIGINT, 2) for i in range(1, length(b))] AS pb FROM n),
x AS (SELECT s_suppkey, p, count(*) AS c FROM (SELECT s_suppkey, unnest(pa) AS p FROM g) GROUP BY ALL),
y AS (SELECT s_suppkey, p, count(*) AS c FROM (SELECT s_suppkey, unnest(pb) AS p FROM g) GROUP BY ALL),
o AS (SELECT s_suppkey, sum(least(x.c, y.c)) AS o FROM x JOIN y USING (s_suppkey, p) GROUP BY s_suppkey)
SELECT s_suppkey, round(CASE WHEN a = b THEN 1.0 ELSE 2.0 * coalesce(o, 0) / (length(a) + length(b) - 2) END, 9)::DOUBLE AS dice FROM n LEFT JOIN o USING (s_suppkey)""")
def name_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", ""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(I.dice(name, F.lit("supplier000000007")), 9).alias("dice"))


@query("""
WITH q AS (SELECT split_part(p_name, ' ', 1) AS term FROM part ORDER BY p_partkey LIMIT 1),
m AS (SELECT p_partkey AS node, p_name, p_brand, CASE WHEN lower(p_name) = lower(term) THEN 1.0 WHEN starts_with(lower(p_name), lower(term)) THEN 0.8 WHEN contains(lower(p_name), lower(term)) THEN 0.5 END::DOUBLE AS score FROM part, q)
SELECT node, score FROM m WHERE score IS NOT NULL ORDER BY score DESC, p_brand, p_name, node LIMIT 16""")
def seed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    q = part.orderBy("p_partkey").limit(1).select(F.substring_index("p_name", " ", 1).alias("q"))
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.col("p_brand").alias("file"))
    return seeds.resolve(q, nodes).select("node", "score")


@query("""
WITH w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 1), lambda x: CASE WHEN length(x) > 5 AND ends_with(x, 'ing') THEN left(x, length(x) - 3) WHEN length(x) > 4 AND ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y'
  WHEN length(x) > 4 AND regexp_matches(x, '(ches|shes|sses|xes|zes)$') THEN left(x, length(x) - 2) WHEN length(x) > 3 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END) AS c, ['polished', 'small', 'part'] AS q FROM part),
g AS (SELECT *, len(list_intersect(q, c)) AS both_have, array_to_string(q, '') AS a, array_to_string(c, '') AS b FROM w),
pa AS (SELECT p_partkey, p, count(*) AS n FROM (SELECT p_partkey, unnest([substr(a, i::BIGINT, 2) for i in range(1, length(a))]) AS p FROM g) GROUP BY ALL),
pb AS (SELECT p_partkey, p, count(*) AS n FROM (SELECT p_partkey, unnest([substr(b, i::BIGINT, 2) for i in range(1, length(b))]) AS p FROM g) GROUP BY ALL),
o AS (SELECT p_partkey, sum(least(pa.n, pb.n)) AS o FROM pa JOIN pb USING (p_partkey, p) GROUP BY p_partkey),
s AS (SELECT p_partkey AS node, p_name AS name, p_brand AS file, greatest(0.72 * both_have / 3 + 0.28 * both_have / len(c), 2.0 * coalesce(o, 0) / (length(a) + length(b) - 2))::DOUBLE AS score FROM g LEFT JOIN o USING (p_partkey))
SELECT node, name, file, round(score, 9) AS score FROM s WHERE score >= 0.34 ORDER BY round(score, 12) DESC, name, file, node LIMIT 5""")
def seed_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.col("p_brand").alias("file"))
    return seeds.suggestions(spark.range(1).select(F.lit("polished small parts").alias("q")), nodes).select("node", "name", "file", F.round("score", 9).alias("score"))


@query("""
WITH h AS (SELECT p_brand AS key, count(*) AS n, count(*) FILTER (l_quantity >= 23) AS path_n, count(DISTINCT l_suppkey) AS files FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand)
SELECT key, n, path_n, files, round((path_n + 0.5) / (n + 1), 9)::DOUBLE AS rate FROM h WHERE n >= 4 AND files >= 2 AND (path_n + 0.5) / (n + 1) >= 0.55 AND key NOT LIKE '%#1%'""")
def signature_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("key"))
    sites = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select("key", F.col("l_suppkey").alias("file"), (F.col("l_quantity") >= 23).alias("is_path"))
    covered = part.where(F.col("key").contains("#1")).select("key")
    return discover.promoted(discover.histogram(sites), covered).select("key", "n", "path_n", "files", F.round("rate", 9).alias("rate"))


@query("""
WITH r AS (SELECT l_shipdate, l_suppkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_suppkey, l_linenumber, l_orderkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey AS label, max(l_suppkey) FILTER (k = 1) AS first_site, max(n) AS sites, count(DISTINCT l_suppkey) AS files, bool_and(l_returnflag = 'N') AS implicit FROM r GROUP BY l_partkey""")
def anchor_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("label"), F.col("l_suppkey").alias("file"), F.col("l_shipdate").alias("line"), (F.col("l_returnflag") == "N").alias("implicit"))
    return anchors.collapse(sites).select("label", F.col("file").alias("first_site"), "sites", "files", "implicit")


@query("""
WITH s AS (SELECT l_partkey AS label, l_orderkey AS handler, l_suppkey AS file, l_returnflag = 'N' AS implicit FROM lineitem),
p AS (SELECT label, count(*) AS n, count(DISTINCT file) AS files FROM s GROUP BY label),
e AS (SELECT label AS src, handler AS dst, CASE WHEN implicit THEN 0.5 ELSE 1.0 END / sqrt(n) AS w FROM s JOIN p USING (label) UNION ALL SELECT DISTINCT label, file, 0.35 / sqrt(files) FROM s JOIN p USING (label) WHERE files BETWEEN 2 AND 12)
SELECT src, count(*) AS edges, round(sum(w), 6) AS w FROM e GROUP BY src""")
def anchor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("label"), F.col("l_orderkey").alias("handler"), F.col("l_suppkey").alias("file"), (F.col("l_returnflag") == "N").alias("implicit"))
    return graph.anchor_edges(s).groupBy("src").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("w"))


NAMES = [".min.js", ".MIN.JS", ".min.go", ".bundle.ts", ".bundle.d/y.py", "min.js", ".txt"]


@query(f"""
WITH f AS (SELECT *, source || '/' || lang || {NAMES}[doc_id % 7 + 1] AS file FROM documents)
SELECT doc_id, file, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) >= 4000
 OR list_has_any([split_part(reverse(split_part(reverse(lower(file)), '/', 1)), '.', -2)], ['min', 'bundle']) AND split_part(lower(file), '.', -1) IN ('js', 'cjs', 'mjs', 'ts', 'cts', 'mts', 'jsx', 'tsx') AS generated,
 len(string_split(text, chr(10))) AS lines, ceil(length(text) / 4)::BIGINT AS tokens FROM f""")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("file", F.concat("source", F.lit("/"), "lang", name))
    return rows.select("doc_id", "file", P.is_generated(F.col("file"), text).alias("generated"), F.size(F.split(text, "\n")).cast("long").alias("lines"), S.token_estimate(text).cast("long").alias("tokens"))


@query("""
WITH b AS (SELECT doc_id, sha1(text) AS sha FROM documents), a AS (SELECT doc_id, sha1(CASE WHEN doc_id % 7 = 0 THEN text || ' more' ELSE text END) AS sha FROM documents WHERE doc_id % 11 <> 0
 UNION ALL SELECT doc_id + 1000000000, sha1(text) FROM documents WHERE doc_id % 13 = 0)
SELECT doc_id, CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (doc_id) WHERE b.sha IS DISTINCT FROM a.sha""")
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = lambda text: F.sha1(text.cast("binary")).alias("sha")
    before = docs.select("doc_id", sha(F.col("text")))
    after = docs.where("doc_id % 11 <> 0").select("doc_id", sha(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))))
    more = docs.where("doc_id % 13 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), sha(F.col("text")))
    return sync.drift(before, after.unionByName(more), "doc_id")


@query("""
WITH f AS (SELECT lang, sha256(doc_id || ':' || sha1(text)) AS own FROM documents),
p AS (SELECT lang, substr(own, 62, 3) AS part, sha256(concat_ws(':', count(*), sum(('0x' || substr(own, 1, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(own, 13, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(own, 25, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(own, 37, 12))::BIGINT)::VARCHAR)) AS digest FROM f GROUP BY ALL)
SELECT lang, left(sha1(string_agg(part || ':' || digest, chr(10) ORDER BY part || ':' || digest)), 12) AS version FROM p GROUP BY lang""")
def snapshot_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.tree_version(table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("file"), F.sha1(F.col("text").cast("binary")).alias("sha")), ("lang",))


@query("""
SELECT conv_id, sha1(string_agg(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), chr(10) ORDER BY trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))) AS fingerprint FROM conversations GROUP BY conv_id""")
def fact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("facts"))
    return rows.select("conv_id", sync.fingerprint(F.col("facts")).alias("fingerprint"))


@query(f"""
SELECT event_id, round(value * pow(0.5, greatest(0, date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 3600000000.0) / 4800.0), 9) AS mass,
 round(pow(0.5, (date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 86400000000.0) / 300.0), 9) AS fresh FROM events""")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.round(S.decayed(F.col("value"), us / 3600000000, 4800.0), 9).alias("mass"), F.round(S.recency(us / 86400000000, 300.0), 9).alias("fresh"))


@query("""
WITH u AS (SELECT page_id, regexp_replace(url, '^(?:https?|wss?)://[^/]+/?', '') AS path FROM pages), p AS (SELECT page_id, path, string_split(path, '/') AS s FROM u)
SELECT page_id, s[1] AS top, CASE len(s) WHEN 1 THEN '(root)' WHEN 2 THEN s[1] || '/' ELSE s[1] || '/' || s[2] || '/' END AS folder, regexp_matches(path, '(^|/)(test_|conftest)') AS test_file, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^(?:https?|wss?)://[^/]+/?", "")
    return table(spark, sf_dir, "pages").select("page_id", P.top_segment(path).alias("top"), P.folder2(path).alias("folder"), P.is_test_file(path).alias("test_file"), P.extension(path).alias("ext"))


@query("""
WITH l AS (SELECT p_partkey AS rank, 'part ' || p_partkey || ' ' || p_name AS line FROM part),
s AS (SELECT rank, line, sum(length(line) + 1) OVER (ORDER BY rank) AS size, count(*) OVER () - row_number() OVER (ORDER BY rank) AS rest FROM l),
k AS (SELECT rank, line, ceil((5 + size + CASE WHEN rest > 0 THEN length(rest::VARCHAR) + 16 ELSE 0 END) / 4)::BIGINT AS tokens FROM s)
SELECT rank, line, tokens, coalesce(rank <= (SELECT max(rank) FROM k WHERE tokens <= 800), false) AS shown FROM k""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return reveal.fit(part.select(F.col("p_partkey").alias("rank"), F.concat_ws(" ", F.lit("part"), F.col("p_partkey").cast("string"), "p_name").alias("line")), 800, "parts")


@query("""
WITH RECURSIVE r AS (SELECT event_type AS session, date_diff('day', DATE '1970-01-01', ts::DATE) AS step, user_id % 20 AS node, max(value / 997) AS mass FROM events GROUP BY ALL),
b AS (SELECT session, step, map_from_entries(list((node, mass))) AS warmed, row_number() OVER (PARTITION BY session ORDER BY step) AS k FROM r GROUP BY session, step),
f AS (
  SELECT session, 0::BIGINT AS k, 0::BIGINT AS step, MAP {}::MAP(BIGINT, DOUBLE) AS told, true AS armed, 0.0::DOUBLE AS surprise, false AS red FROM (SELECT DISTINCT session FROM b)
  UNION ALL
  SELECT session, k, step, CASE WHEN red THEN map_from_entries([(n, greatest(coalesce(cooled[n], 0), coalesce(warmed[n], 0))) for n in list_distinct(map_keys(cooled) || map_keys(warmed))]) ELSE cooled END, CASE WHEN red THEN false ELSE armed OR surprise <= 0.075 END, surprise, red
  FROM (SELECT *, armed AND surprise >= 0.15 AS red FROM (
    SELECT *, list_sum([0.0] || [CASE WHEN warmed[n] - coalesce(cooled[n], 0) > 1e-9 THEN warmed[n] - coalesce(cooled[n], 0) ELSE 0 END for n in map_keys(warmed)]) AS surprise FROM (
      SELECT b.session, b.k, b.step, b.warmed, f.armed, map_from_entries([(n, f.told[n] * pow(0.5, (b.step - f.step) * 24 / 48.0)) for n in map_keys(f.told) if f.told[n] * pow(0.5, (b.step - f.step) * 24 / 48.0) > 1e-9]) AS cooled
      FROM f JOIN b ON b.session = f.session AND b.k = f.k + 1))))
SELECT session, step, round(surprise, 7) AS surprise, red, armed, cardinality(told)::BIGINT AS remembered FROM f WHERE k > 0""")
def surprise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hours = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))) / 3600000000
    rows = e.select(F.col("event_type").alias("session"), (hours / 24).cast("long").alias("step"), hours.alias("hours"), (F.col("user_id") % 20).alias("node"), (F.col("value") / 997).alias("mass"), F.lit(False).alias("structural"))
    return sync.gate(rows).select("session", "step", F.round("surprise", 7).alias("surprise"), "red", "armed", "remembered")


@query("""
SELECT user_id::VARCHAR AS file, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS owners, CASE WHEN count(DISTINCT event_type) > 1 THEN 'mixed' WHEN min(event_type) = 'signup' THEN 'current' ELSE 'other' END AS kind FROM events GROUP BY user_id""")
def mutation_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    chain = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(
        F.col("user_id").cast("string").alias("file"), F.lag(F.col("event_id").cast("string")).over(chain).alias("before_sha"), F.col("event_id").cast("string").alias("after_sha"), F.col("event_type").alias("owner"),
        F.lit("t").alias("tool_call_id"), F.row_number().over(chain).cast("long").alias("commit_order"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
    )
    changes = rows.groupBy("file").agg(F.lit(None).cast("string").alias("before_sha"), F.max_by("after_sha", "commit_order").alias("after_sha"))
    return provenance.attribute(rows.withColumn("seq", F.col("commit_order")), changes, "signup").withColumn("owners", F.array_join("owners", ","))


PATHS_SQL = "p AS (SELECT page_id, regexp_replace(url, '^(?:https?|wss?)://[^/]+/?', '') AS path FROM pages)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^(?:https?|wss?)://[^/]+/?", "").alias("path"))


@query(f"""WITH {PATHS_SQL},
v AS (SELECT page_id, path, ['get', 'PostMapping', 'fetch', 're_path', 'root'][page_id % 5 + 1] AS m FROM p)
SELECT page_id, CASE upper(regexp_replace(m, 'Mapping$', '')) WHEN 'FETCH' THEN 'GET' WHEN 'RE_PATH' THEN 'ANY' WHEN 'ROOT' THEN 'ANY' ELSE upper(regexp_replace(m, 'Mapping$', '')) END AS verb, 'POST' AS said, '/' || path AS said_path,
 '/api/v1' || CASE WHEN trim(path, '/') = '' THEN '' ELSE '/' || trim(path, '/') END AS joined, '"' || path || '"' AS quoted, path AS plain FROM v""")
def route_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.array(*map(F.lit, ("get", "PostMapping", "fetch", "re_path", "root")))
    quoted = F.concat(F.lit('"'), "path", F.lit('"'))
    own = P.verb_in_path(F.concat(F.lit("POST /"), F.regexp_replace("path", r"\s", "")))
    rows = page_paths(spark, sf_dir)
    return rows.select("page_id", P.verb(F.element_at(methods, (F.col("page_id") % 5 + 1).cast("int"))).alias("verb"), own["verb"].alias("said"), own["path"].alias("said_path"), P.join_route(F.lit("/api/v1/"), F.concat("path", F.lit("/"))).alias("joined"), quoted.alias("quoted"), P.unquote(F.concat(F.lit(" f"), quoted)).alias("plain"))


@query(f"""WITH {PATHS_SQL},
f AS (SELECT page_id, ['src/' || path || '.ts', 'tests/' || path || '.py', 'node_modules/' || path || '.js', path || '/Cargo.lock', path || '.pyc', 'app/' || path || '/page.mdx', path || '/x_test.go', path || '.RS'][page_id % 8 + 1] AS file, page_id % 8 AS k FROM p),
e AS (SELECT *, string_split(file, '/') AS parts, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ends FROM f)
SELECT page_id, file, list_has_any(parts, {P.JUNK_DIRS}) OR lower(parts[-1]) IN {tuple(P.JUNK_NAMES)} OR ends_with(lower(parts[-1]), '.lock') AS junk,
 (ends IN {tuple([*P.LANGUAGES, *P.CONFIG])} AND ends NOT IN {tuple(P.BINARY)}) OR regexp_matches(file, '(^|/)app/(.+/)?page\\.(tsx|jsx|mdx)$|(^|/)src/routes/(.+/)?\\+page\\.(svelte|md)$') AS supported,
 list_has_any(list_transform(parts[:-2], lambda x: lower(x)), ['test', 'tests', '__tests__', 'fixture', 'fixtures']) OR lower(parts[-1]) IN ('test', 'tests', '__tests__', 'fixture', 'fixtures') OR starts_with(parts[-1], 'test_') OR starts_with(parts[-1], 'conftest')
 OR regexp_matches(parts[-1], '\\.(test|spec)\\.[tj]sx?$') OR ends_with(parts[-1], '_test.go') AS test,
 CASE WHEN ends IN {tuple(P.FAMILIES["ts"])} THEN 'ts' ELSE ends END AS family FROM e""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    made = [F.concat(F.lit(a), path, F.lit(b)) for a, b in (("src/", ".ts"), ("tests/", ".py"), ("node_modules/", ".js"), ("", "/Cargo.lock"), ("", ".pyc"), ("app/", "/page.mdx"), ("", "/x_test.go"), ("", ".RS"))]
    rows = page_paths(spark, sf_dir).select("page_id", F.element_at(F.array(*made), (F.col("page_id") % 8 + 1).cast("int")).alias("file"))
    file = F.col("file")
    return rows.select("page_id", "file", P.is_junk(file).alias("junk"), P.is_supported(file).alias("supported"), P.is_test_scope(file).alias("test"), P.family(file).alias("family"))


@query(f"""WITH {PATHS_SQL},
d AS (SELECT page_id, string_split(path, '/')[1] AS dir, path FROM p WHERE path NOT LIKE '%.%' AND path NOT LIKE '%/' AND path <> '')
SELECT 'app/' || path || '/(shop)/[id]/page.tsx' AS file, 'page' AS kind, 'ANY' AS verb, '/' || path || '/{{*}}' AS route FROM d
UNION ALL SELECT 'web/server/api/' || path || '.post.ts', 'route', 'POST', '/api/' || path FROM d
UNION ALL SELECT 'src/routes/' || path || '/+server.ts', 'route', unnest(['GET', 'DELETE']), '/' || path FROM d""")
def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_paths(spark, sf_dir).where("path not like '%.%' and path not like '%/' and path <> ''")
    made = [F.concat(F.lit(a), "path", F.lit(b)) for a, b in (("app/", "/(shop)/[id]/page.tsx"), ("web/server/api/", ".post.ts"), ("src/routes/", "/+server.ts"))]
    tree = rows.select(F.explode(F.array(*made)).alias("file")).withColumn("text", F.lit("export async function GET() {}\nexport const DELETE = 1"))
    return files.file_routes(tree).select("file", "kind", "verb", "route")


def fold_sql(path: str, absolute: bool) -> str:
    """DuckDB SQL for the segments of a path, with . and .. worked off one after the other."""
    above = "acc" if absolute else "list_append(acc, '..')"
    step = f"CASE WHEN s[1] IN ('', '.') THEN acc WHEN s[1] <> '..' THEN list_append(acc, s[1]) WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] ELSE {above} END"
    return f"array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda acc, s: {step}, []::VARCHAR[]), '/')"


@query(f"""WITH {PATHS_SQL},
q AS (SELECT page_id, path, ['./a/x/../' || path, path || '/../../../b', '../' || path, 'a//./' || path || '/..'][page_id % 4 + 1] AS loose,
 ['C:\\Repo\\' || replace(path, '/', '\\'), 'c:/repo/x/../' || path, '..\\out\\' || path, 'D:\\repo\\' || path, path, '.\\' || path, '/repo/' || path][page_id % 7 + 1] AS told,
 ['sub\\', 'sub/', 'other/'][page_id % 3 + 1] || replace(path, '/', '\\') AS git FROM p),
w AS (SELECT *, replace(told, '\\', '/') AS t, replace(git, '\\', '/') AS g FROM q),
r AS (SELECT *, CASE WHEN regexp_matches(t, '^[A-Za-z]:/') THEN substr(t, 1, 3) || {fold_sql("substr(t, 3)", True)} WHEN starts_with(t, '/') THEN CASE WHEN starts_with(t, '//') THEN '//' ELSE '/' END || {fold_sql("t", True)} ELSE 'C:/repo/' || {fold_sql("t", True)} END AS one,
 'C:/' || {fold_sql("'repo/' || t", True)} AS below FROM w),
s AS (SELECT *, CASE WHEN regexp_matches(t, '^([A-Za-z]:)?/') THEN one ELSE below END AS whole FROM r)
SELECT page_id, {fold_sql("loose", False)} AS resolved, CASE WHEN starts_with(g, 'sub/') THEN substr(g, 5) END AS inner_path, CASE WHEN starts_with(lower(whole), 'c:/repo/') THEN substr(whole, 9) END AS relative,
 starts_with('docs/' || path, 'docs/b') AND (length('docs/' || path) = 6 OR substr('docs/' || path, 7, 1) = '/') AS in_scope FROM s""")
def path_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, back = F.col("path"), F.translate("path", "/", "\\")
    pick = lambda *x: F.element_at(F.array(*(F.concat(*(F.lit(y) if isinstance(y, str) else y for y in parts)) for parts in x)), (F.col("page_id") % len(x) + 1).cast("int"))
    loose = pick(("./a/x/../", path), (path, "/../../../b"), ("../", path), ("a//./", path, "/.."))
    told = pick(("C:\\Repo\\", back), ("c:/repo/x/../", path), ("..\\out\\", path), ("D:\\repo\\", path), (path,), (".\\", path), ("/repo/", path))
    git = pick(("sub\\", back), ("sub/", back), ("other/", back))
    rows = page_paths(spark, sf_dir)
    return rows.select("page_id", P.resolve(loose).alias("resolved"), P.git_relative(git, "sub/").alias("inner_path"), P.within(told, "C:\\repo\\x\\..").alias("relative"), P.in_scope(F.concat(F.lit("docs/"), path), "@docs/b/").alias("in_scope"))


@query(f"""
WITH t AS (SELECT conv_id, turn, regexp_extract(text, '([A-Za-z]+)', 1) AS callee FROM conversations UNION ALL SELECT conv_id, turn, ['Print', 'loadUser', 'x', 'describe', 'JOIN'][turn % 5 + 1] FROM conversations)
SELECT conv_id, turn, callee FROM t WHERE length(callee) > 1 AND lower(callee) NOT IN ({", ".join(f"'{w}'" for w in anchors.WARDS)})""")
def telling_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract("text", "([A-Za-z]+)", 1).alias("callee"))
    more = rows.withColumn("callee", F.element_at(F.array(*map(F.lit, ("Print", "loadUser", "x", "describe", "JOIN"))), (F.col("turn") % 5 + 1).cast("int")))
    return anchors.telling_calls(rows.unionByName(more))


@query("""
WITH places AS (SELECT r_regionkey, replace(r_name, ' ', '') AS r_name FROM region),
s AS (SELECT n_name AS name, r_name AS file, 'class ' || n_name || ' extends ' || r_name || ' implements ' || upper(left(n_name, 1)) || 'x, Kept' AS sig FROM nation JOIN places ON r_regionkey = n_regionkey
 UNION ALL SELECT 'lib.' || r_name, 'lib', '' FROM places UNION ALL SELECT 'Kept', 'lib', '' FROM places WHERE r_regionkey = 0),
n AS (SELECT name || '@' || file AS id, lower(name) AS key FROM s UNION SELECT name || '@' || file, lower(split_part(name, '.', 2)) FROM s WHERE contains(name, '.')),
k AS (SELECT n_name || '@' || r_name AS src, unnest([lower(r_name), lower(left(n_name, 1) || 'x'), 'kept']) AS key FROM nation JOIN places ON r_regionkey = n_regionkey)
SELECT DISTINCT src, id AS dst FROM k JOIN n USING (key) WHERE src <> id""")
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").withColumn("r_name", F.replace("r_name", F.lit(" "), F.lit("")))
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    classes = nation.select(F.col("n_name").alias("name"), F.lit("class").alias("kind"), F.col("r_name").alias("file"), F.concat(F.lit("class "), "n_name", F.lit(" extends "), "r_name", F.lit(" implements "), F.upper(F.left("n_name", F.lit(1))), F.lit("x, Kept")).alias("sig"))
    lib = region.select(F.concat(F.lit("lib."), "r_name").alias("name")).unionByName(spark.createDataFrame([("Kept",)], "name string")).select("name", F.lit("type").alias("kind"), F.lit("lib").alias("file"), F.lit("").alias("sig"))
    return facts.inherits(classes.unionByName(lib))


IMPORTS_SQL = """
WITH f AS (SELECT unnest(['src/p' || p_partkey || '.ts', 'src/p' || p_partkey || '/index.ts', 'py/m' || p_partkey || '.py', 'go/k' || p_partkey || '/a.go', 'rs/r' || p_partkey || '/mod.rs']) AS file FROM part WHERE p_partkey % 7 <> 0),
i AS (SELECT p_partkey AS k, 'src/p' || p_partkey || '.test.ts' AS file, './p' || (p_partkey + 1) || '.js' AS spec, 'src/p' || (p_partkey + 1) || '.ts' AS target FROM part
 UNION ALL SELECT p_partkey, 'py/x.py', 'py.m' || p_partkey, 'py/m' || p_partkey || '.py' FROM part UNION ALL SELECT p_partkey, 'go/main/main.go', 'example.com/mod/k' || p_partkey, 'go/k' || p_partkey || '/a.go' FROM part
 UNION ALL SELECT p_partkey, 'rs/main.rs', 'crate::r' || p_partkey, 'rs/r' || p_partkey || '/mod.rs' FROM part UNION ALL SELECT p_partkey, 'web/a.tsx', '@app/src/p' || p_partkey, NULL FROM part)
"""


def source_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey").cast("string")
    part = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    paths = F.array(*(F.concat(F.lit(a), k, F.lit(b)) for a, b in (("src/p", ".ts"), ("src/p", "/index.ts"), ("py/m", ".py"), ("go/k", "/a.go"), ("rs/r", "/mod.rs"))))
    tree = part.where("p_partkey % 7 <> 0").select(F.explode(paths).alias("file"))
    after = (F.col("p_partkey") + 1).cast("string")
    specs = [(F.concat(F.lit("src/p"), k, F.lit(".test.ts")), F.concat(F.lit("./p"), after, F.lit(".js"))), (F.lit("py/x.py"), F.concat(F.lit("py.m"), k)), (F.lit("go/main/main.go"), F.concat(F.lit("example.com/mod/k"), k)), (F.lit("rs/main.rs"), F.concat(F.lit("crate::r"), k)), (F.lit("web/a.tsx"), F.concat(F.lit("@app/src/p"), k))]
    asked = part.select(F.explode(F.array(*(F.struct(a.alias("file"), b.alias("spec")) for a, b in specs))).alias("x")).select("x.*").withColumn("site", F.concat_ws(">", "file", "spec"))
    return asked, tree


@query(IMPORTS_SQL + "SELECT i.file, spec, target FROM i JOIN f ON f.file = i.target")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, tree = source_imports(spark, sf_dir)
    return imports.resolve(asked, tree).join(asked.select("site", "spec").hint("merge"), "site").select("file", "spec", "target")


@query(IMPORTS_SQL + "SELECT 'file:' || i.file AS src, 'file:' || target AS dst FROM i JOIN f ON f.file = i.target WHERE i.file LIKE '%.test.ts'")
def tests_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, tree = source_imports(spark, sf_dir)
    return facts.tests(imports.resolve(asked.where(P.is_test_file(F.col("file"))), tree))


@query("SELECT DISTINCT 'file:' || p_brand AS src, p_name || '@' || p_brand AS dst FROM part")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.contains(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file")))


@query(SUPPLIER_EDGES_SQL + """, hubs AS (SELECT node, sum(w) AS d FROM adj GROUP BY node ORDER BY round(sum(w), 6) DESC, node LIMIT 24), low AS (SELECT min(node) AS a FROM adj),
one AS (SELECT CASE WHEN src = low.a THEN dst ELSE src END AS node, CASE WHEN src = low.a THEN '→ callee' ELSE '← caller' END AS label, w FROM g, low WHERE (src = low.a) <> (dst = low.a))
SELECT h.node, round(h.d, 6) AS d, coalesce(o.label, '') AS label, coalesce(o.w, 0) AS w FROM hubs h LEFT JOIN one o USING (node)""")
def hub_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.kept(supplier_edges(spark, sf_dir)).select("src", "dst", F.lit("invokes").alias("kind"), "w", F.lit(0).alias("ord"))
    hubs = graph.degrees(graph.conductance(edges)).withColumn("d", F.round("d", 6)).orderBy(F.desc("d"), "node").limit(24)
    seed = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.min("node").alias("node"))
    told = graph.direct_relations(edges, seed).select("node", graph.relation_label(F.col("kind"), F.col("out"), F.lit("function")).alias("label"), "w")
    return hubs.join(told, "node", "left").select("node", "d", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("w", F.lit(0.0)).alias("w"))


@query(heat_sql(2.0, """, cust AS (SELECT c_custkey * 4 AS node, c_nationkey::VARCHAR AS file, heat FROM heat JOIN customer ON node = c_custkey * 4),
lit AS (SELECT node, file, heat, row_number() OVER (ORDER BY round(heat, 12) DESC, file, node) AS rank, heat / max(heat) OVER () AS h FROM cust WHERE node <> (SELECT node FROM first_customer)),
kept AS (SELECT * FROM lit WHERE h >= 0.002 AND heat >= 1e-9 AND rank <= 400),
nth AS (SELECT *, sum(CASE WHEN h < 0.3 AND h >= 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY rank) AS k FROM kept)
SELECT file, count(*) AS n, count(*) FILTER (h >= 0.3) AS hot, count(*) FILTER (h < 0.3 AND h >= 0.02 AND k <= 4) AS warm, count(*) FILTER (h < 0.02 OR (h < 0.3 AND k > 4)) AS glow FROM nth GROUP BY file""").replace("\n, cust AS", ", cust AS"))
def reveal_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    warm = purchase_heat(spark, sf_dir, 2.0).withColumn("heat", F.round("heat", 12))
    start = table(spark, sf_dir, "orders").agg((F.min("o_custkey") * 4).alias("seed"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 4).alias("node"), F.col("c_nationkey").cast("string").alias("file")).join(F.broadcast(start), F.col("node") == F.col("seed"), "left_anti")
    rows = c.join(warm, "node").select(F.col("node").alias("id"), F.lit("").alias("name"), F.lit("function").alias("kind"), "file", F.col("node").alias("line"), "heat", F.lit(False).alias("is_seed"), F.lit(None).cast("string").alias("relation"))
    count = lambda tier: F.count(F.when(F.col("tier") == tier, 1)).alias(tier)
    return reveal.tiers(graph.kept(rows)).groupBy("file").agg(F.count("*").alias("n"), count("hot"), count("warm"), count("glow"))


@query("""
WITH b AS (SELECT doc_id AS file, sha1(text) AS sha, sha1(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS fp FROM documents),
a AS (SELECT doc_id AS file, sha1(t) AS sha, sha1(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS fp FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || '  ' WHEN 1 THEN text || ' more' ELSE text END AS t FROM documents))
SELECT file FROM b JOIN a USING (file) WHERE a.sha <> b.sha AND a.fp <> b.fp""")
def semantic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    after = docs.withColumn("text", F.when(F.col("file") % 5 == 0, F.concat("text", F.lit("  "))).when(F.col("file") % 5 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    sha = lambda d: d.select("file", F.sha1(F.col("text").cast("binary")).alias("sha"))
    prints = lambda d: d.select("file", sync.fingerprint(F.array("text")).alias("fingerprint"))
    return sync.semantic(sync.drift(sha(docs), sha(after)), prints(docs), prints(after))


@query("""
WITH b AS (SELECT p_partkey AS anchor, p_brand AS file FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT p_partkey AS anchor, p_brand AS file, p_partkey % 4 = 0 AS implicit FROM part WHERE p_partkey % 5 <> 0),
x AS (SELECT anchor, coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'added' ELSE 'removed' END AS change, coalesce(implicit, false) AS implicit FROM b FULL JOIN a USING (anchor) WHERE a.file IS NULL OR b.file IS NULL)
SELECT anchor, file, change, implicit, file LIKE '%#1%' AS evidential FROM x""")
def anchor_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("anchor"), F.col("p_brand").alias("file"))
    before = part.where("anchor % 3 <> 0").withColumn("implicit", F.lit(False))
    after = part.where("anchor % 5 <> 0").withColumn("implicit", F.col("anchor") % 4 == 0)
    return sync.evidence(baseline.anchor_deltas(before, after), part.where("file like '%#1%'").select("file"))


@query("""
WITH s AS (SELECT url AS file, round(sum(length(html)) / 1000, 0) AS surprise FROM pages GROUP BY url),
o AS (SELECT regexp_replace(file, '^(?:https?|wss?)://[^/]+/?', '') AS file, max(surprise) AS surprise FROM s GROUP BY 1),
t AS (SELECT string_split(file, '/')[1] AS scope, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1)
SELECT file, surprise, row_number() OVER (ORDER BY surprise DESC, regexp_matches(lower(file), '(^|/)(tests?|__tests__|fixtures?)(/|$)'), file) AS rank FROM o WHERE string_split(file, '/')[1] IN (SELECT scope FROM t)""")
def surprise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by surprise, below the top folders that hold more than one."""
    s = table(spark, sf_dir, "pages").groupBy("url").agg(F.round(F.sum(F.length("html")) / 1000, 0).alias("surprise"))
    rows = s.groupBy(F.regexp_replace("url", "^(?:https?|wss?)://[^/]+/?", "").alias("file")).agg(F.max("surprise").alias("surprise"))
    scopes = rows.groupBy(P.top_segment(F.col("file")).alias("scope")).agg(F.count("*").alias("n")).where("n > 1")
    ranked = order.numbered(baseline.attended(rows, scopes).withColumn("test", P.is_test_scope(F.col("file"))), F.desc("surprise"), "test", "file")
    return ranked.select("file", "surprise", F.col("number").alias("rank"))


@query(f"""WITH {HREFS_SQL}, top AS (SELECT key AS norm FROM spec WHERE kind = 'path' ORDER BY df DESC, key LIMIT 40), q AS (SELECT norm FROM top UNION SELECT regexp_extract(norm, '^/[^/]+') FROM top),
routes AS (SELECT page_id + 1000000000 AS node, '/' || regexp_replace(url, '^(?:https?|wss?)://[^/]+/?', '') AS route FROM pages),
m AS (SELECT norm, k.page_id AS node, CASE WHEN k.key = norm THEN 1.0 ELSE 0.8 END AS score FROM keys k, q WHERE k.key = norm OR (k.kind = 'path' AND starts_with(k.key, norm || '/'))
 UNION ALL SELECT norm, node, 0.9 FROM routes, q WHERE route = norm OR starts_with(route, norm || '/'))
SELECT norm AS q, node, max(score)::DOUBLE AS score FROM m GROUP BY ALL""")
def seed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the most frequent paths, and the folders at their top, find in links and in the routes of pages: in all of them, not in the first of each key."""
    keys = graph.kept(bridge.keyed(href_sites(spark, sf_dir)))
    index = keys.select("key", "kind", F.array(F.struct("file", "line", "node")).alias("occ"))
    top = bridge.document_frequency(keys).where("kind = 'path'").orderBy(F.desc("df"), "key").limit(40).select(F.col("key").alias("q"))
    asked = top.unionByName(top.select(F.regexp_extract("q", "^/[^/]+", 0).alias("q"))).distinct()
    routes = page_paths(spark, sf_dir).select((F.col("page_id") + 1000000000).alias("node"), F.concat(F.lit("/"), "path").alias("route"))
    return seeds.literal_matches(asked, index, routes).groupBy("q", "node").agg(F.max("score").alias("score"))


def first_paths_sql(hops: int) -> str:
    """Breadth first, one CTE a hop: of all ways to a node that was not reached before, the one of the least place."""
    reason = "CASE kind WHEN 'invokes' THEN 'call' WHEN 'imports' THEN 'import' WHEN 'tests' THEN 'test' END"
    told = f"CASE WHEN {reason} IS NULL OR list_contains(reasons, {reason}) THEN reasons ELSE list_append(reasons, {reason}) END"
    steps = [f"""h{k} AS (SELECT nb AS node, {k} AS hop, min(list_append(place, nth)) AS place, arg_min({told}, list_append(place, nth)) AS reasons FROM h{k - 1} JOIN n USING (node) WHERE nb NOT IN ({" UNION ALL ".join(f"SELECT node FROM h{j}" for j in range(k))}) GROUP BY nb)""" for k in range(1, hops + 1)]
    return f"""
WITH k AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem),
e AS (SELECT src, dst, ['invokes', 'imports', 'tests', 'contains'][(src * 7 + dst) % 4 + 1] AS kind, [0.7, 0.3, 0.9][(src + dst) % 3 + 1] AS w FROM k),
b AS (SELECT src AS node, dst AS nb, kind, w FROM e UNION ALL SELECT dst, src, kind, w FROM e),
n AS (SELECT node, nb, kind, row_number() OVER (PARTITION BY node ORDER BY kind = 'contains', w DESC, nb) AS nth FROM b),
h0 AS (SELECT min(src) AS node, 0 AS hop, [1::BIGINT] AS place, []::VARCHAR[] AS reasons FROM e),
{", ".join(steps)}
SELECT node, hop, array_to_string(reasons, ',') AS reasons FROM ({" UNION ALL ".join(f"SELECT node, hop, reasons FROM h{k}" for k in range(hops + 1))})"""


@query(first_paths_sql(7))
def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each supplier and part is reached from the first supplier, over edges of four kinds and three weights."""
    s, d = F.col("src"), F.col("dst")
    pairs = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst")), "src", "dst").distinct()
    kind = F.element_at(F.array(*map(F.lit, ("invokes", "imports", "tests", "contains"))), ((s * 7 + d) % 4 + 1).cast("int"))
    edges = graph.kept(pairs.select("src", "dst", kind.alias("kind"), F.element_at(F.array(*map(F.lit, (0.7, 0.3, 0.9))), ((s + d) % 3 + 1).cast("int")).alias("w")))
    return graph.path_reasons(edges, edges.agg(F.min("src").alias("node"))).select("node", "hop", F.array_join("reasons", ",").alias("reasons"))


REFRESH_SQL = """
WITH h AS (SELECT page_id, html FROM pages),
t AS (SELECT page_id, html AS old, CASE WHEN page_id % 7 = 0 THEN html || '<a href="/more/x">' ELSE html END AS new, page_id % 11 = 0 AS gone, page_id % 5 = 0 AS touched FROM h),
f AS (SELECT page_id AS file, CASE WHEN old <> new THEN 'extracted' ELSE 'anchored' END AS change, new AS html FROM t WHERE NOT gone
 UNION ALL SELECT page_id, 'deleted', '' FROM t WHERE gone UNION ALL SELECT page_id + 1000000000, 'added', html FROM h WHERE page_id % 13 = 0),
x AS (SELECT file, change, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM f)
SELECT file::VARCHAR AS file, change, len(hrefs)::BIGINT AS links, len(list_filter(hrefs, lambda x: starts_with(x, '/')))::BIGINT AS inner_links FROM x"""


@query(REFRESH_SQL)
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages kept as facts, brought from one snapshot to the next: what was done to each page, and the facts in force."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), "page_id", "html")
    edited = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit('<a href="/more/x">'))).otherwise(F.col("html"))
    added = pages.where("page_id % 13 = 0").select((F.col("page_id") + 1000000000).cast("string").alias("file"), "page_id", "html")
    before = pages.withColumn("version", F.lit("1"))
    after = pages.where("page_id % 11 <> 0").withColumns({"html": edited, "version": F.when((F.col("page_id") % 7 == 0) | (F.col("page_id") % 5 == 0), "2").otherwise("1")}).unionByName(added.withColumn("version", F.lit("1")))
    links = lambda df, fact: df.select("file", F.lit(fact).alias("fact"), F.lit(1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit('href="([^"]*)"'), 1)).alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("kind", "sig")))
    store = FactStore(spark, f"{shared_folder(spark)}/links-{uuid.uuid4().hex}")
    for number, snapshot in enumerate((before, after)):
        read = lambda asked, rows=snapshot: asked.select("file").join(rows, "file").select("file", F.sha1(F.col("html").cast("binary")).alias("sha"), F.lit("html").alias("lang"), F.col("html").alias("text"), F.lit(False).alias("generated"))
        done = store.refresh(snapshot.select("file", F.length("html").cast("long").alias("size"), "version"), read, lambda df: links(df, "link"), lambda df: links(df, "anchor").where("startswith(name, '/')"), f"rules {number}")
    facts_ = store.facts().groupBy("file").agg(F.count(F.when(F.col("fact") == "link", 1)).alias("links"), F.count(F.when(F.col("fact") == "anchor", 1)).alias("inner_links"))
    return done.changes.join(facts_, "file", "left").select("file", "change", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("inner_links", F.lit(0)).cast("long").alias("inner_links"))


def fields_sql(t: float) -> str:
    """``heat_sql`` for several changes side by side: the state is of a change and a node."""
    order = min(90, math.ceil(2.2 * t) + 16)
    return f"""
WITH RECURSIVE {EDGES_SQL},
m AS (SELECT b.src, b.dst, -b.w / (sqrt(x.d) * sqrt(y.d)) AS m FROM both_ways b JOIN deg x ON x.node = b.src JOIN deg y ON y.node = b.dst),
seeds AS (SELECT DISTINCT c_nationkey AS change, o_custkey * 4 AS node FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 3),
r AS (
  SELECT 0 AS k, s.change, deg.node AS n, CASE WHEN x.node IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS cur, 0.0::DOUBLE AS prev FROM deg CROSS JOIN (SELECT DISTINCT change FROM seeds) s LEFT JOIN seeds x ON x.node = deg.node AND x.change = s.change
  UNION ALL
  SELECT r.k + 1, r.change, r.n, (CASE WHEN r.k = 0 THEN 1 ELSE 2 END) * coalesce(s.v, 0) - r.prev, r.cur
  FROM r LEFT JOIN (SELECT q.k, q.change, m.dst AS n, sum(m.m * q.cur) AS v FROM r q JOIN m ON m.src = q.n GROUP BY ALL) s ON s.n = r.n AND s.k = r.k AND s.change = r.change
  WHERE r.k < {order}),
c AS (SELECT k, (CASE WHEN k = 0 THEN 1 ELSE 2 * pow(-1, k) END) * sum(exp((2 * m + k) * ln({t} / 2) - lgamma(m + 1) - lgamma(m + k + 1) - {t})) AS c FROM range({order} + 1) a(k), range(120) b(m) GROUP BY k),
heat AS (SELECT r.change, r.n AS node, sum(c.c * r.cur) AS heat FROM r JOIN c USING (k) GROUP BY ALL)
SELECT change::VARCHAR AS change, node % 4 AS kind, count(*) FILTER (round(heat, 9) > 1e-6) AS warm, round(sum(heat), 5) AS mass FROM heat GROUP BY ALL"""


@query(fields_sql(2.0))
def warmed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat of the customers of three nations, each a change of its own, computed together."""
    nations = table(spark, sf_dir, "customer").where("c_nationkey < 3").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("change"))
    start = table(spark, sf_dir, "orders").select("o_custkey").distinct().join(nations, "o_custkey").select("change", (F.col("o_custkey") * 4).alias("node"), F.lit(1.0).alias("mass"))
    edges = purchase_edges(spark, sf_dir)
    made = heat.fields(graph.kept(graph.conductance(edges, tasks_for(edges, PAIRS_A_TASK))), start, 2.0)
    return made.groupBy("change", (F.col("node") % 4).alias("kind")).agg(F.count(F.when(F.round("heat", 9) > 1e-6, 1)).alias("warm"), F.round(F.sum("heat"), 5).alias("mass"))


CALLS_SQL = r'''
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 AS lang, o_orderkey::VARCHAR AS t FROM orders),
x AS (SELECT k, CASE lang WHEN 0 THEN '// r.get("/no/' || t || '")' || chr(10) || 'app' || chr(10) || '  .get(' || chr(10) || '    "/orders/' || t || '/:id",' || chr(10) || '    h(1, [2, 3]));' || chr(10) || 'r.post("/a/' || t || '", x); r.put(''/b/' || t || '/'', y); log("r.get(x)")'
 WHEN 1 THEN '@app.route("/p/' || t || '")' || chr(10) || 'def f():' || chr(10) || '    """' || chr(10) || '    no call' || chr(10) || '    """' || chr(10) || '    return c.delete(' || chr(10) || '        "/q/{id}/' || t || '")  # c.get("/no")'
 ELSE 'func Routes() {' || chr(10) || chr(9) || 'r.GET("/g/' || t || '", h); mux.HandleFunc("PATCH /h/' || t || '", h)' || chr(10) || chr(9) || 'r.GET("not a path", h)' || chr(10) || '}' END AS text FROM s),
c AS (SELECT k, regexp_replace(text, '(//|# )[^\n]*', '', 'g') AS text FROM x),
m AS (SELECT k, unnest(regexp_extract_all(text, '\.(?i:get|post|put|delete|route|handlefunc)\(\s*["''](?:[A-Z]+ )?/[^"'']*["'']')) AS call FROM c),
p AS (SELECT k, upper(regexp_extract(call, '^\.(\w+)', 1)) AS method, regexp_extract(call, '["'']([A-Z]*) ?/', 1) AS said, regexp_extract(call, '["''](?:[A-Z]+ )?(/[^"'']*)["'']', 1) AS path FROM m)
SELECT k::VARCHAR AS file, CASE WHEN said <> '' THEN said ELSE method END AS verb, regexp_replace(regexp_replace(path, '(:[^/]+|\{[^}/]*\})', '{*}'), '(.)/$', '\1') AS route FROM p'''


@query(CALLS_SQL)
def route_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that sources in three languages declare, a source for each order: over lines, side by side, beside comments and texts."""
    t = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('// r.get("/no/'), t, F.lit('")\napp\n  .get(\n    "/orders/'), t, F.lit('/:id",\n    h(1, [2, 3]));\nr.post("/a/'), t, F.lit("\", x); r.put('/b/"), t, F.lit("/', y); log(\"r.get(x)\")")))
    text = text.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('@app.route("/p/'), t, F.lit('")\ndef f():\n    """\n    no call\n    """\n    return c.delete(\n        "/q/{id}/'), t, F.lit('")  # c.get("/no")')))
    text = text.otherwise(F.concat(F.lit('func Routes() {\n\tr.GET("/g/'), t, F.lit('", h); mux.HandleFunc("PATCH /h/'), t, F.lit('", h)\n\tr.GET("not a path", h)\n}')))
    lang = F.element_at(F.array(*map(F.lit, ("TypeScript", "Python", "Go"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return anchors.matches(orders.select(t.alias("file"), lang.alias("lang"), text.alias("text"))).select("file", "verb", "route")
