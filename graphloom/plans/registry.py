"""Names of the relational and graph queries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.operators import calls, commands, graph, layout, rollup, scorecard, search
from graphloom.plans import code_tree, code_tree_sql
from graphloom.sources import adapters as A

ISEED = "f:c1"
NSEED = "7"
SEEDS = ["f:c1", "f:c2", "f:s3"]

#: SQL of the adapters, as common table expressions.
GEO = "geo AS (SELECT r_name || '/' || n_name || '/customer-' || c_custkey path, floor(abs(c_acctbal))::bigint loc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name || '/supplier-' || s_suppkey, floor(abs(s_acctbal))::bigint FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
DIRS = GEO + ", dirs AS (SELECT d dir, count(*) files, sum(loc)::bigint loc FROM (SELECT unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) d, loc FROM geo) GROUP BY d)"
TRADE = "trade AS (SELECT DISTINCT 'f:c' || o_custkey src, 'f:s' || l_suppkey dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
FILES = "files AS (SELECT 'f:c' || c_custkey id, c_nationkey::bigint module FROM customer UNION ALL SELECT 'f:s' || s_suppkey, s_nationkey::bigint FROM supplier)"
STEPS = "steps AS (SELECT DISTINCT o.who src, n.o_custkey::varchar dst FROM (SELECT o_custkey::varchar who, unnest([min(o_orderkey), max(o_orderkey)]) k FROM orders GROUP BY 1) o JOIN orders n ON n.o_orderkey = k + 1 WHERE o.who <> n.o_custkey::varchar)"
CALLS = """sym AS (SELECT p_partkey id, p_brand path, p_name || ' ' || p_size AS name FROM part),
op AS (SELECT l_orderkey, l_partkey, min(l_linenumber) line FROM lineitem GROUP BY 1, 2),
ld AS (SELECT l_orderkey, arg_min(l_partkey, (line, l_partkey)) src FROM op GROUP BY 1),
refs AS (SELECT ld.src, a.path src_path, b.name, op.line, b.path dst_path FROM op JOIN ld USING (l_orderkey) JOIN sym a ON a.id = ld.src JOIN sym b ON b.id = op.l_partkey WHERE op.l_partkey <> ld.src),
imp AS (SELECT path, dep FROM (SELECT src_path path, dst_path dep, row_number() OVER (PARTITION BY src_path ORDER BY count(*) DESC, dst_path) r FROM refs WHERE src_path <> dst_path GROUP BY 1, 2) WHERE r <= 3),
n1 AS (SELECT name, count(*) n_all, min(id) d_all FROM sym GROUP BY 1),
n2 AS (SELECT path, name, count(*) n_here, min(id) d_here FROM sym GROUP BY 1, 2),
n3 AS (SELECT imp.path, n2.name, sum(n_here)::bigint n_seen, min(d_here) d_seen FROM imp JOIN n2 ON n2.path = imp.dep GROUP BY 1, 2),
res AS (SELECT refs.src, src_path path, refs.name, line,
 CASE WHEN n_here = 1 THEN 'bound' WHEN n_here > 1 THEN 'ambiguous' WHEN n_seen = 1 THEN 'bound' WHEN n_seen > 1 THEN 'ambiguous' WHEN n_all = 1 THEN 'bound' WHEN n_all IS NULL THEN 'unresolved' ELSE 'ambiguous' END verdict,
 CASE WHEN n_here = 1 THEN d_here WHEN n_here > 1 THEN NULL WHEN n_seen = 1 THEN d_seen WHEN n_seen > 1 THEN NULL WHEN n_all = 1 THEN d_all END dst,
 CASE WHEN n_here = 1 THEN 0.95::double WHEN n_here > 1 THEN NULL WHEN n_seen = 1 THEN 0.8::double WHEN n_seen > 1 THEN NULL WHEN n_all = 1 THEN 0.6::double END conf
 FROM refs LEFT JOIN n1 ON n1.name = refs.name LEFT JOIN n2 ON n2.path = src_path AND n2.name = refs.name LEFT JOIN n3 ON n3.path = src_path AND n3.name = refs.name),
ced AS (SELECT src, dst, max(conf) conf, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, count(DISTINCT line) n_lines FROM res WHERE verdict = 'bound' AND src <> dst GROUP BY 1, 2)"""


def _reach(edges: str, seeds: str, depth: int, pick: str) -> str:
    return f"bfs(id, hop) AS (SELECT unnest({seeds}), 0 UNION SELECT {pick}, hop + 1 FROM bfs JOIN {edges} WHERE hop < {depth})"


OUT, IN = "e.dst", "e.src"
FORWARD, BACKWARD = "e ON e.src = bfs.id", "e ON e.dst = bfs.id"


def _both(table: str) -> str:
    return f"(SELECT src, dst FROM {table} UNION SELECT dst, src FROM {table})"


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trade_nodes(spark, sf_dir)


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    symbols, refs = A.part_symbols(spark, sf_dir), A.order_calls(spark, sf_dir)
    found = calls.resolve(refs.select(F.col("src").alias("sym"), F.col("src_path").alias("path"), "name", "line"), symbols, A.brand_imports(refs))
    return found, symbols


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents")


def degrees(s, d):
    return graph.degrees(_nodes(s, d).select("id"), A.trade_edges(s, d))


def map_sizes(s, d):
    return graph.map_sizes(A.trade_edges(s, d))


def hubs_files(s, d):
    return graph.file_hubs(A.trade_edges(s, d))


def hubs_top(s, d):
    return graph.top(hubs_files(s, d), 20, F.desc(F.col("importers") + F.col("imports_out")), "id")


def dir_rollup(s, d):
    return rollup.directories(A.geo_files(s, d))


def dir_collapse(s, d):
    return graph.top(rollup.collapsed(dir_rollup(s, d)), 12, F.desc("loc"), "dir")


def one_hop_in(s, d):
    return graph.one_hop(A.trade_edges(s, d), "f:s3", "in", "imports")


def one_hop_out(s, d):
    return graph.one_hop(A.trade_edges(s, d), ISEED, "out", "imports")


def bfs_depth3_out(s, d):
    return graph.reach(A.step_edges(s, d), _ids(s, NSEED), 3, "out")


def bfs_depth3_in(s, d):
    return graph.reach(A.step_edges(s, d), _ids(s, NSEED), 3, "in")


def bfs_depth2_both(s, d):
    return graph.reach(A.trade_edges(s, d), _ids(s, ISEED), 2, "both", cap=None).select("id", "hop")


def impact_by_file(s, d):
    hit = graph.reach(A.trade_edges(s, d), _ids(s, "f:s3"), 3, "in").join(_nodes(s, d).select("id", "module"), "id")
    return hit.groupBy("module").agg(F.min("hop").alias("hop"), F.count(F.lit(1)).alias("reached"))


def deps_transitive(s, d):
    return graph.reach(A.step_edges(s, d), _ids(s, NSEED), 12, "out").filter(F.col("id") != NSEED).select("id", "hop")


def neighbors(s, d):
    return graph.reach(A.step_edges(s, d), _ids(s, NSEED), 2, "both").filter(F.col("id") != NSEED).select("id", "hop")


def subgraph_multi_seed(s, d):
    hit = graph.reach(A.trade_edges(s, d), _ids(s, *SEEDS), 1, "both").join(_nodes(s, d), "id")
    return hit.groupBy("module").agg(F.min("hop").alias("hop"), F.count(F.lit(1)).alias("nodes"))


def scc(s, d):
    return graph.strong_components(A.step_edges(s, d)).select("id", "component", F.col("size").cast("long").alias("size"))


def cycles(s, d):
    return scc(s, d).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"), F.count(F.lit(1)).alias("size"))


def call_resolution(s, d):
    edges = calls.edges(_resolved(s, d)[0])
    return edges.select("src", "dst", "conf", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def call_unbound(s, d):
    return calls.unbound(_resolved(s, d)[0])


def call_counters(s, d):
    return calls.counters(_resolved(s, d)[0])


def who_calls_verdict(s, d):
    found, symbols = _resolved(s, d)
    return calls.callers_verdict(calls.edges(found), calls.unbound(found), symbols)


def conf_tags(s, d):
    return calls.edges(_resolved(s, d)[0]).groupBy(T.conf_tag(F.col("conf")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def _named(s, d):
    files = A.geo_files(s, d)
    return files.select(F.concat(F.lit("f:"), "path").alias("id"), F.lit("File").alias("kind"), T.basename(F.col("path")).alias("name"), "path", F.lit(None).cast("int").alias("line"), F.col("loc").alias("indeg"), F.lit(0).alias("outdeg"))


def resolve_target(s, d):
    return search.resolve(_named(s, d), "Customer-1").select("id", "tier", "total")


def resolve_exact_name(s, d):
    return search.resolve(_named(s, d), "supplier-1").select("id", "tier", "total")


def like_escape_ci(s, d):
    return A.table(s, d, "part").filter(T.like_ci(F.col("p_name"), "RE_") | T.like_ci(F.col("p_type"), "An")).select("p_partkey", "p_name")


def library_names(s, d):
    return A.page_imports(s, d).withColumn("library", T.library_name(F.col("raw"))).groupBy("library").agg(F.count(F.lit(1)).alias("n"))


def text_facts(s, d):
    docs = _documents(s, d)
    return docs.select("doc_id", *[c.alias(n) for n, c in T.line_facts(F.col("text")).items() if n not in ("branches", "max_nesting")])


def branch_count(s, d):
    facts = T.line_facts(F.col("text"))
    return _documents(s, d).select("doc_id", facts["branches"].alias("branches"), facts["max_nesting"].alias("max_nesting"))


def _doc_files(s, d):
    facts = T.line_facts(F.col("text"))
    symbols = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|\n)(\S+)"), F.lit(1)))).cast("long")
    return _documents(s, d).select("doc_id", "source", facts["loc"].alias("loc"), facts["code_lines"].alias("code_lines"), facts["branches"].alias("branches"), symbols.alias("n_symbols"))


def dup_signature(s, d):
    return _doc_files(s, d).groupBy("code_lines", "branches", "n_symbols").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")


def duplication_factor(s, d):
    return scorecard.duplication(_doc_files(s, d))


def p95_index(s, d):
    return scorecard.p95(A.table(s, d, "orders"), "o_totalprice")


def scorecard_factors(s, d):
    files = _doc_files(s, d)
    sums = files.agg(F.avg("loc").alias("loc"), F.avg(F.when(F.col("n_symbols") > 0, F.col("n_symbols"))).alias("symbols"), F.count_if(F.col("loc") > 600).alias("large"))
    links = scorecard.coupling(A.trade_edges(s, d), _nodes(s, d))
    loc = F.col("loc")
    return sums.crossJoin(F.broadcast(links)).select(scorecard.lower_better(loc, 200, 700).alias("file_size"), scorecard.lower_better(loc, 150, 600).alias("load_size"), scorecard.band(F.col("symbols"), 1, 12, 0, 45).alias("cohesion"), scorecard.lower_better(F.col("fan_out"), 4, 20).alias("coupling"), scorecard.higher_better(F.col("symbols"), 0.05, 30).alias("documented"), "large", "risky")


def naming_clarity(s, d):
    names = _documents(s, d).select(F.explode(F.array_distinct(F.split("text", " "))).alias("name"))
    return names.filter("name <> ''").agg(F.count_if(scorecard.cryptic(F.col("name"))).alias("cryptic"), F.count(F.lit(1)).alias("names"))


def module_pair_weights(s, d):
    return graph.pair_weights(A.trade_edges(s, d), _nodes(s, d)).drop("kind")


def budget_cut(s, d):
    lines = _documents(s, d).filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return search.budget_cut(lines, 1000, "doc_id").select("doc_id", "ord", "used")


def prune_topk(s, d):
    deg = graph.map_sizes(A.trade_edges(s, d)).select("id", "degree")
    kind = F.when(F.col("id").startswith("f:s"), "File").when(F.substring("id", -1, 1).isin("1", "2", "3"), "Class").otherwise("Function")
    nodes = _nodes(s, d).select("id").join(deg, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), kind.alias("kind"))
    kept, both = graph.prune(nodes, A.trade_edges(s, d), 120)
    n = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return kept.join(n, "id", "left").select("id", "kind", F.coalesce("n", F.lit(0)).alias("n_edges"))


def event_flow(s, d):
    return A.event_steps(s, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def nearest_line(s, d):
    at = A.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("tp"), (F.col("l_linenumber") + F.lit(1)).alias("tl"), F.lit("x").alias("name")).distinct()
    symbols = A.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.lit("x").alias("name"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("id"))
    return calls.nearest(at, symbols).select("tp", "tl", "d_at")


def entry_points(s, d):
    nodes = _nodes(s, d).withColumn("path", F.concat(F.lit("m"), "module", F.lit("/"), F.substring("id", 3, 99), F.when(F.col("id").endswith("c7"), "/server.py").otherwise("/x.py")))
    code = graph.degrees(nodes.select("id", "path"), A.trade_edges(s, d)).select("id", "path", "outdeg")
    return commands.entry_points(code, nodes.filter("id like '%c11'").select("path"), A.trade_edges(s, d), pool=2000)


def union_pools(s, d):
    edges = A.trade_edges(s, d)
    big = graph.file_hubs(edges).filter("importers > 40").select("id")
    return big.union(graph.file_hubs(edges).filter("imports_out > 40").select("id")).distinct()


def not_imported(s, d):
    return _nodes(s, d).join(A.trade_edges(s, d).select(F.col("dst").alias("id")), "id", "left_anti").groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def kind_counts(s, d):
    return _nodes(s, d).withColumn("kind", F.substring("id", 3, 1)).groupBy("kind", "module").agg(F.count(F.lit(1)).alias("n"))


def stable_ids(s, d):
    rows = A.table(s, d, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.sha1("p_type").alias("body"), F.col("p_partkey").alias("line"))
    return rows.select("line", T.duplicate_ids("path", "name", "body").alias("id"))


def top_per_module(s, d):
    hubs = graph.file_hubs(A.trade_edges(s, d)).join(_nodes(s, d), "id")
    order = Window.partitionBy("module").orderBy(F.desc(F.col("importers") + F.col("imports_out")), "id")
    return hubs.withColumn("r", F.row_number().over(order)).filter("r <= 12").select("module", "id", "r")


def path_predicates(s, d):
    path = F.regexp_replace("url", "^https?://", "")
    return A.table(s, d, "pages").select("page_id", T.basename(path).rlike(commands.LAUNCHER).alias("launcher"), path.rlike(commands.TEST_PATH).alias("test"))


def unbound_named(s, d):
    found, symbols = _resolved(s, d)
    named = calls.unbound(found).join(symbols.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src", "left")
    return named.groupBy(F.coalesce("caller", "path").alias("caller")).agg(F.count(F.lit(1)).alias("n"))


def set_difference(s, d):
    large = A.table(s, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))
    return A.table(s, d, "customer").select(F.col("c_custkey").alias("id")).subtract(large)


def edge_kind_filter(s, d):
    every = A.trade_edges(s, d).unionByName(A.event_steps(s, d).withColumn("kind", F.lit("calls")))
    return graph.of_kinds(every, ["CALLS", "nothing"]).groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"))


def grid_layout(s, d):
    deg = graph.map_sizes(A.trade_edges(s, d)).select("id", "degree")
    return layout.grid(_nodes(s, d).join(deg, "id", "left").fillna({"degree": 0})).select("id", F.col("column").alias("grid_column"), F.col("row").alias("grid_row"))


def coverage_by_path(s, d):
    sites = _resolved(s, d)[0].groupBy("path").agg(F.count_if(F.col("verdict") == "bound").alias("bound"), F.count_if(F.col("verdict") == "ambiguous").alias("ambiguous"))
    return sites.withColumn("coverage", F.call_function("div", 100 * F.col("bound"), F.greatest(F.col("bound") + F.col("ambiguous"), F.lit(1))))


def undirected_neighbors(s, d):
    edges = A.step_edges(s, d)
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = graph.map_sizes(edges).select(F.col("id").alias("dst"), "degree")
    order = Window.partitionBy("src").orderBy(F.desc("degree"), "dst")
    return both.join(degree, "dst").withColumn("r", F.row_number().over(order)).filter("r <= 12").select("src", "dst", "r")


def fan_totals(s, d):
    return graph.degrees(_nodes(s, d).select("id"), A.trade_edges(s, d)).agg(F.coalesce(F.sum("indeg"), F.lit(0)).alias("total_in"), F.max("outdeg").alias("most_out"), F.count_if(F.col("indeg") > 12).alias("hubs"))


_QUERIES = (path_predicates, unbound_named, set_difference, edge_kind_filter, grid_layout, coverage_by_path, undirected_neighbors, fan_totals, degrees, map_sizes, hubs_files, hubs_top, dir_rollup, dir_collapse, one_hop_in, one_hop_out, bfs_depth3_out, bfs_depth3_in, bfs_depth2_both, impact_by_file, deps_transitive, neighbors, subgraph_multi_seed, scc, cycles, call_resolution, call_unbound, call_counters, who_calls_verdict, conf_tags, resolve_target, resolve_exact_name, like_escape_ci, library_names, text_facts, branch_count, dup_signature, duplication_factor, p95_index, scorecard_factors, naming_clarity, module_pair_weights, budget_cut, prune_topk, event_flow, nearest_line, entry_points, union_pools, not_imported, kind_counts, stable_ids, top_per_module)

#: What the SQL compares with, written out here and not taken from the code it checks. RE2 knows no
#: look-behind, so a question mark takes the character before it along, and those that count not are left out.
_BRANCH = r"\b(if|else\s+if|elif|for|foreach|while|case|when|catch|except|rescue|and|or)\b|&&|\|\||\?\?|[=!<>]\?\?|[=!<>]\?|\?"
_LAUNCH = r"(?i)(^|/)(main|index|app|cli|server|run|__main__|setup|entry)\b"
_TEST = r"(^|/)tests?/|(^|/)spec/|(^|/)test_[^/]*$|[._-]tests?\.[a-z]+$|[a-z]Tests?\.[A-Za-z]+$"
_LINES = "ln AS (SELECT doc_id, text, source, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END ls FROM documents)"
_DOCF = _LINES + f", df AS (SELECT doc_id, source, len(ls)::bigint loc, len(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t\\r]')))::bigint code_lines, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_BRANCH}'), lambda x: NOT regexp_matches(x, '^[=!<>][?]$')))::bigint branches, len(list_distinct(regexp_extract_all(text, '(?:^|\\n)(\\S+)', 1)))::bigint n_symbols FROM ln)"
_HUBS = "hubs AS (SELECT id, sum(i)::bigint importers, sum(o)::bigint imports_out FROM (SELECT src id, 0 i, 1 o FROM trade UNION ALL SELECT dst, 1, 0 FROM trade) GROUP BY id)"


def _sql() -> dict[str, str]:
    hop_min = "SELECT id, min(hop) hop"
    clamp = lambda x: f"greatest(0.0::double, least(100.0::double, {x}))"
    scc = "clo(a, b) AS (SELECT src, dst FROM steps UNION SELECT clo.a, n.dst FROM clo JOIN steps n ON n.src = clo.b), mut AS (SELECT x.a id, x.b other FROM clo x JOIN clo y ON x.a = y.b AND x.b = y.a), comp AS (SELECT id, min(other) component, count(DISTINCT other)::bigint size FROM mut GROUP BY id HAVING count(DISTINCT other) > 1)"
    named = GEO + ", nm AS (SELECT 'f:' || path id, path, split_part(path, '/', 3) AS name, loc indeg FROM geo)"
    tiers = lambda t: f"CASE WHEN id = '{t}' THEN 1 WHEN path = '{t}' THEN 5 WHEN name = '{t}' THEN 6 WHEN lower(path) LIKE lower('%/{t}') THEN 7 WHEN contains(lower(name), lower('{t}')) OR contains(lower(path), lower('{t}')) THEN 8 END"
    found = lambda t: f"WITH {named}, ti AS (SELECT *, {tiers(t)} tier FROM nm), f AS (SELECT * FROM ti WHERE tier = (SELECT min(tier) FROM ti)) SELECT id, tier, (SELECT count(*) FROM f) total FROM f ORDER BY indeg DESC, id LIMIT 25"
    prune_kind = "CASE WHEN id LIKE 'f:s%' THEN 'File' WHEN right(id, 1) IN ('1', '2', '3') THEN 'Class' ELSE 'Function' END"
    return {
        "path_predicates": f"SELECT page_id, regexp_matches(regexp_extract(p, '[^/]*$'), '{_LAUNCH}') launcher, regexp_matches(p, '{_TEST}') test FROM (SELECT page_id, regexp_replace(url, '^https?://', '') p FROM pages)",
        "unbound_named": f"WITH {CALLS} SELECT coalesce(sym.name, res.path) caller, count(*) n FROM res LEFT JOIN sym ON sym.id = res.src WHERE verdict = 'ambiguous' GROUP BY 1",
        "set_difference": "SELECT c_custkey id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000",
        "edge_kind_filter": "SELECT 'calls' kind, src, count(*) n FROM (SELECT event_type src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) dst FROM events) WHERE dst IS NOT NULL GROUP BY src",
        "grid_layout": f"WITH {TRADE}, {FILES}, g AS (SELECT id, module, (SELECT count(*) FROM trade WHERE src = f.id OR dst = f.id) degree FROM files f), p AS (SELECT id, row_number() OVER (PARTITION BY module ORDER BY degree DESC, id) - 1 i, ceil(sqrt(count(*) OVER (PARTITION BY module)))::int w FROM g) SELECT id, i % w grid_column, i // w grid_row FROM p",
        "coverage_by_path": f"WITH {CALLS}, c AS (SELECT path, count(*) FILTER (verdict = 'bound') bound, count(*) FILTER (verdict = 'ambiguous') ambiguous FROM res GROUP BY 1) SELECT *, 100 * bound // greatest(1, bound + ambiguous) coverage FROM c",
        "undirected_neighbors": f"WITH {STEPS}, b AS {_both('steps')}, g AS (SELECT id, count(*) degree FROM (SELECT src id FROM steps UNION ALL SELECT dst FROM steps) GROUP BY id) SELECT src, dst, r FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY degree DESC, dst)::int r FROM b JOIN g ON g.id = dst) WHERE r <= 12",
        "fan_totals": f"WITH {TRADE}, {FILES}, g AS (SELECT (SELECT count(*) FROM trade WHERE dst = f.id) i, (SELECT count(*) FROM trade WHERE src = f.id) o FROM files f) SELECT sum(i)::bigint total_in, max(o) most_out, count(*) FILTER (i > 12) hubs FROM g",
        "degrees": f"WITH {TRADE}, {FILES} SELECT id, coalesce((SELECT count(*) FROM trade WHERE dst = id), 0) indeg, coalesce((SELECT count(*) FROM trade WHERE src = id), 0) outdeg FROM files",
        "map_sizes": f"WITH {TRADE} SELECT id, count(*) degree, 1.0::double + sqrt(least(count(*), 40)::double) size FROM (SELECT src id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY id",
        "hubs_files": f"WITH {TRADE}, {_HUBS} SELECT * FROM hubs",
        "hubs_top": f"WITH {TRADE}, {_HUBS} SELECT * FROM hubs ORDER BY importers + imports_out DESC, id LIMIT 20",
        "dir_rollup": f"WITH {DIRS} SELECT * FROM dirs",
        "dir_collapse": f"WITH {DIRS}, ch AS (SELECT CASE WHEN dir = '.' THEN NULL WHEN instr(dir, '/') = 0 THEN '.' ELSE split_part(dir, '/', 1) END p, max(files) most FROM dirs GROUP BY 1) SELECT * FROM dirs WHERE dir NOT IN (SELECT dir FROM dirs d JOIN ch ON ch.p = d.dir WHERE dir <> '.' AND most >= 0.9 * d.files) ORDER BY loc DESC, dir LIMIT 12",
        "one_hop_in": f"WITH {TRADE} SELECT src id, 1.0::double conf, (SELECT count(*) FROM trade WHERE dst = 'f:s3') total FROM trade WHERE dst = 'f:s3' ORDER BY src LIMIT 500",
        "one_hop_out": f"WITH {TRADE} SELECT dst id, 1.0::double conf, (SELECT count(*) FROM trade WHERE src = '{ISEED}') total FROM trade WHERE src = '{ISEED}' ORDER BY dst LIMIT 500",
        "bfs_depth3_out": f"WITH RECURSIVE {STEPS}, {_reach('steps ' + FORWARD, f'[{NSEED!r}]', 3, OUT)} {hop_min}, false capped FROM bfs GROUP BY id",
        "bfs_depth3_in": f"WITH RECURSIVE {STEPS}, {_reach('steps ' + BACKWARD, f'[{NSEED!r}]', 3, IN)} {hop_min}, false capped FROM bfs GROUP BY id",
        "bfs_depth2_both": f"WITH RECURSIVE {TRADE}, {_reach(_both('trade') + ' ' + FORWARD, f'[{ISEED!r}]', 2, OUT)} {hop_min} FROM bfs GROUP BY id",
        "impact_by_file": f"WITH RECURSIVE {TRADE}, {FILES}, {_reach('trade ' + BACKWARD, '[' + repr('f:s3') + ']', 3, IN)} SELECT module, min(hop) hop, count(*) reached FROM (SELECT id, min(hop) hop FROM bfs GROUP BY id) JOIN files USING (id) GROUP BY module",
        "deps_transitive": f"WITH RECURSIVE {STEPS}, {_reach('steps ' + FORWARD, f'[{NSEED!r}]', 12, OUT)} {hop_min} FROM bfs WHERE id <> '{NSEED}' GROUP BY id",
        "neighbors": f"WITH RECURSIVE {STEPS}, {_reach(_both('steps') + ' ' + FORWARD, f'[{NSEED!r}]', 2, OUT)} {hop_min} FROM bfs WHERE id <> '{NSEED}' GROUP BY id",
        "subgraph_multi_seed": f"WITH RECURSIVE {TRADE}, {FILES}, {_reach(_both('trade') + ' ' + FORWARD, str(SEEDS), 1, OUT)} SELECT module, min(hop) hop, count(*) nodes FROM (SELECT id, min(hop) hop FROM bfs GROUP BY id) JOIN files USING (id) GROUP BY module",
        "scc": f"WITH RECURSIVE {STEPS}, {scc} SELECT * FROM comp",
        "cycles": f"WITH RECURSIVE {STEPS}, {scc} SELECT component, string_agg(id, ',' ORDER BY id) members, count(*) size FROM comp GROUP BY component",
        "call_resolution": f"WITH {CALLS} SELECT src, dst, conf, lines FROM ced",
        "call_unbound": f"WITH {CALLS} SELECT name, src, path, line FROM res WHERE verdict = 'ambiguous'",
        "call_counters": f"WITH {CALLS} SELECT count(*) FILTER (verdict = 'external') \"external\", count(*) FILTER (verdict = 'unresolved') unresolved, count(*) FILTER (verdict = 'ambiguous') ambiguous, count(*) FILTER (verdict = 'bound') bound, count(*) FILTER (conf = 1.0) compiled, 100 * count(*) FILTER (verdict = 'bound') // greatest(1, count(*) FILTER (verdict IN ('bound', 'ambiguous'))) coverage FROM res",
        "who_calls_verdict": f"WITH {CALLS}, c AS (SELECT dst id, count(*) callers, sum(n_lines)::bigint sites, count(*) FILTER (conf < 0.95) guesses FROM ced GROUP BY 1), u AS (SELECT name, count(*) unresolved FROM res WHERE verdict = 'ambiguous' GROUP BY 1) SELECT sym.id, sym.name, coalesce(callers, 0) callers, coalesce(sites, 0) sites, coalesce(guesses, 0) guesses, coalesce(unresolved, 0) unresolved, coalesce(guesses, 0) = 0 AND coalesce(unresolved, 0) = 0 AND coalesce(callers, 0) <= 500 complete FROM sym LEFT JOIN c USING (id) LEFT JOIN u USING (name) WHERE callers > 0 OR unresolved > 0",
        "conf_tags": f"WITH {CALLS} SELECT CASE WHEN conf >= 0.95 THEN '' WHEN conf >= 0.8 THEN ' ~' ELSE ' ?' END tag, count(*) n FROM ced GROUP BY 1",
        "resolve_target": found("Customer-1"),
        "resolve_exact_name": found("supplier-1"),
        "like_escape_ci": r"SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re\_%' ESCAPE '\' OR lower(p_type) LIKE '%an%'",
        "library_names": f"WITH l AS (SELECT regexp_replace(unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), '^/', '') raw FROM pages), {code_tree_sql.library('l')} SELECT library, count(*) n FROM lib GROUP BY 1",
        "text_facts": f"WITH {_DOCF} SELECT ln.doc_id, loc, loc - code_lines blank_lines, code_lines, sha1(coalesce(text, '')) hash, ceil(coalesce(length(text), 0) / 4)::bigint est_tokens FROM df JOIN ln USING (doc_id)",
        "branch_count": f"WITH {_DOCF} SELECT ln.doc_id, branches, coalesce(list_max(list_transform(ls, lambda x: length(replace(regexp_extract(x, '^([ \\t]*)', 1), chr(9), '    ')) // 4)), 0)::bigint max_nesting FROM df JOIN ln USING (doc_id)",
        "dup_signature": f"WITH {_DOCF} SELECT code_lines, branches, n_symbols, count(*) c FROM df GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "duplication_factor": f"WITH {_DOCF} SELECT sum(c - 1)::double / sum(c)::double duplication FROM (SELECT count(*) c FROM df GROUP BY code_lines, branches, n_symbols)",
        "p95_index": "SELECT o_totalprice p95 FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) r, count(*) OVER () n FROM orders) WHERE r = CASE WHEN n > 5 THEN floor(n * 0.95) ELSE n END",
        "scorecard_factors": f"WITH {TRADE}, {FILES}, {_DOCF}, a AS (SELECT avg(loc) loc, avg(CASE WHEN n_symbols > 0 THEN n_symbols END) symbols, count(*) FILTER (loc > 600) \"large\" FROM df), o AS (SELECT (SELECT count(*) FROM trade)::double / (SELECT count(*) FROM files) fan_out, (SELECT count(*) FROM (SELECT dst FROM trade GROUP BY dst HAVING count(*) > 12)) risky) SELECT {clamp('(700.0::double - loc) / 500 * 100')} file_size, {clamp('(600.0::double - loc) / 450 * 100')} load_size, CASE WHEN symbols BETWEEN 1 AND 12 THEN 100.0::double ELSE greatest(0.0::double, CASE WHEN symbols < 1 THEN symbols * 100 ELSE (45.0::double - symbols) / 33 * 100 END) END cohesion, {clamp('(20.0::double - fan_out) / 16 * 100')} coupling, {clamp('(symbols - 0.05::double) / (30 - 0.05::double) * 100')} documented, \"large\", risky FROM a, o",
        "naming_clarity": "WITH n AS (SELECT unnest(list_distinct(string_split(text, ' '))) AS name FROM documents) SELECT count(*) FILTER ((length(name) <= 2 AND name NOT IN ('id', 'ok', 'db', 'io')) OR (length(name) <= 3 AND upper(name) = name AND lower(name) <> name)) cryptic, count(*) AS names FROM n WHERE name <> ''",
        "module_pair_weights": f"WITH {TRADE}, {FILES} SELECT least(m.module, k.module) a, greatest(m.module, k.module) b, count(*) n, count(*) FILTER (m.module = k.module) inside FROM trade JOIN files m ON m.id = src JOIN files k ON k.id = dst GROUP BY 1, 2",
        "budget_cut": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 ord FROM documents), u AS (SELECT doc_id, ord, sum(ceil(length(line) / 4)::bigint + 1) OVER (PARTITION BY doc_id ORDER BY ord)::bigint used FROM l) SELECT doc_id, ord, used FROM u WHERE used <= 988",
        "prune_topk": f"WITH {TRADE}, {FILES}, g AS (SELECT f.id, (SELECT count(*) FROM trade WHERE src = f.id OR dst = f.id) degree, {prune_kind} kind FROM files f), q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) r, greatest(0, 120 - (SELECT count(*) FROM g WHERE kind = 'File')) room, (SELECT count(*) FROM g WHERE kind = 'Class') nc FROM g), k AS (SELECT id, kind FROM q WHERE kind = 'File' OR (kind = 'Class' AND r <= floor(room * 0.3)) OR (kind = 'Function' AND r <= room - least(floor(room * 0.3), nc))) SELECT id, kind, (SELECT count(*) FROM trade WHERE src = k.id AND dst IN (SELECT id FROM k)) n_edges FROM k",
        "event_flow": "SELECT src, dst, count(*) n FROM (SELECT event_type src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2",
        "nearest_line": "WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber + 1 tl FROM lineitem) SELECT a.l_orderkey::varchar tp, tl, arg_min(l_partkey, (abs(l_linenumber - tl), l_linenumber, l_partkey)) d_at FROM a JOIN lineitem l ON l.l_orderkey = a.l_orderkey GROUP BY 1, 2",
        "entry_points": f"WITH {TRADE}, {FILES}, g AS (SELECT id, 'm' || module || '/' || substr(id, 3) || CASE WHEN ends_with(id, 'c7') THEN '/server.py' ELSE '/x.py' END path, (SELECT count(*) FROM trade WHERE src = id) outdeg, ends_with(id, 'c11') m, ends_with(id, 'c7') l, id NOT IN (SELECT dst FROM trade) u FROM files), p AS (SELECT * FROM (SELECT * FROM g ORDER BY outdeg DESC, id LIMIT 2000) UNION SELECT * FROM g WHERE m) SELECT path, CASE WHEN m THEN 'main()' WHEN l THEN 'named' ELSE 'unimported' END why, 100 * m::int + 40 * l::int + 10 * u::int score FROM p ORDER BY score DESC, outdeg DESC, id LIMIT 8",
        "union_pools": f"WITH {TRADE}, {_HUBS} SELECT id FROM hubs WHERE importers > 40 UNION SELECT id FROM hubs WHERE imports_out > 40",
        "not_imported": f"WITH {TRADE}, {FILES} SELECT module, count(*) n FROM files WHERE id NOT IN (SELECT dst FROM trade) GROUP BY 1",
        "kind_counts": f"WITH {FILES} SELECT substr(id, 3, 1) kind, module, count(*) n FROM files GROUP BY 1, 2",
        "stable_ids": "WITH x AS (SELECT p_partkey line, p_brand, p_name, p_type, count(*) OVER (PARTITION BY p_brand, p_name) n, row_number() OVER (PARTITION BY p_brand, p_name, p_type ORDER BY p_partkey) twin FROM part) SELECT line, 's:' || p_brand || '#' || p_name || CASE WHEN n = 1 THEN '' ELSE '~' || substr(sha1(p_type), 1, 6) || CASE WHEN twin > 1 THEN '.' || twin ELSE '' END END id FROM x",
        "top_per_module": f"WITH {TRADE}, {FILES}, {_HUBS} SELECT module, id, r FROM (SELECT module, id, row_number() OVER (PARTITION BY module ORDER BY importers + imports_out DESC, id)::int r FROM hubs JOIN files USING (id)) WHERE r <= 12",
    }


def queries() -> dict:
    return {f.__name__: f for f in (*_QUERIES, *code_tree.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return _sql() | code_tree_sql.oracle_sql()
