"""DuckDB SQL for the queries of code_tree: what the tree must give, from the relational tables alone.

Nothing here is taken from the code that it checks. The text of a file never exists in SQL but
for span: line numbers, lengths and digests follow from how many lines each part adds.
"""

from __future__ import annotations

TREE = """pt AS (SELECT p_partkey k, replace(p_brand, 'Brand#', '')::int brand, 'brand_' || replace(p_brand, 'Brand#', '') || '/size_' || p_size || '_' || (p_partkey // 20000) || '.py' path,
 CASE WHEN p_partkey % 97 = 0 THEN 'main' ELSE replace(p_name, ' ', '_') || '_' || (p_partkey % 40) END AS name, p_name doc FROM part),
op AS (SELECT l_orderkey, l_partkey, min(l_linenumber) line FROM lineitem GROUP BY 1, 2),
ld AS (SELECT l_orderkey, arg_min(l_partkey, (line, l_partkey)) src FROM op GROUP BY 1),
pairs AS (SELECT DISTINCT ld.src k, op.l_partkey callee FROM op JOIN ld USING (l_orderkey) WHERE op.l_partkey <> ld.src),
cl AS (SELECT pairs.k, a.path, callee, b.path dst_path, b.name FROM pairs JOIN pt a ON a.k = pairs.k JOIN pt b ON b.k = callee),
imp AS (SELECT DISTINCT path, dst_path dep FROM cl WHERE callee % 4 = 0 AND path <> dst_path),
hd AS (SELECT path, max(brand) % 5 = 0 os, (max(brand) % 5 = 0)::int + (SELECT count(*) FROM imp WHERE imp.path = pt.path) h FROM pt GROUP BY path),
nm AS (SELECT DISTINCT k, path, name FROM cl),
nl AS (SELECT k, count(*) n, string_agg('    ' || name || '()', chr(10) ORDER BY name) text FROM nm GROUP BY k),
f0 AS (SELECT pt.*, (pt.k % 3 = 0)::int d, (pt.k % 5 = 0)::int b, coalesce(n, 0) n, h,
 'def ' || name || '():' || CASE WHEN pt.k % 3 = 0 THEN chr(10) || '~' ELSE '' END || CASE WHEN pt.k % 5 = 0 THEN chr(10) || '    if 1 and 2: return 0' ELSE '' END || coalesce(chr(10) || nl.text, '') || chr(10) || '    return ' || pt.k code
 FROM pt JOIN hd USING (path) LEFT JOIN nl ON nl.k = pt.k),
f1 AS (SELECT *, 2 + d + b + n length, replace(code, '~', repeat(' ', 10 + length(doc))) body, replace(code, '~', '    \"\"\"' || doc || '\"\"\"') raw, count(*) OVER (PARTITION BY path, name) same FROM f0),
fn AS (SELECT *, (h + 1 + coalesce(sum(length + 1) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int line,
 's:' || path || '#' || name || CASE WHEN same = 1 THEN '' ELSE '~' || substr(sha1(body), 1, 6) END id FROM f1)"""

CALLS = (
    TREE
    + """,
st AS (SELECT * FROM (SELECT fn.id src, fn.name own, nm.path, nm.name, (fn.line + fn.d + fn.b + row_number() OVER (PARTITION BY nm.k ORDER BY nm.name))::int line FROM nm JOIN fn ON fn.k = nm.k) WHERE name <> own),
n1 AS (SELECT name, count(*) n_all, min(id) d_all FROM fn GROUP BY 1),
n2 AS (SELECT path, name, count(*) n_here, min(id) d_here FROM fn GROUP BY 1, 2),
n3 AS (SELECT imp.path, n2.name, sum(n_here) n_seen, min(d_here) d_seen FROM imp JOIN n2 ON n2.path = imp.dep GROUP BY 1, 2),
res AS (SELECT st.*, CASE WHEN n_here = 1 THEN d_here WHEN n_here > 1 THEN NULL WHEN n_seen = 1 THEN d_seen WHEN n_seen > 1 THEN NULL WHEN n_all = 1 THEN d_all END dst,
 CASE WHEN n_here = 1 THEN 0.95::double WHEN n_here > 1 THEN NULL WHEN n_seen = 1 THEN 0.8::double WHEN n_seen > 1 THEN NULL WHEN n_all = 1 THEN 0.6::double END conf
 FROM st JOIN n1 USING (name) LEFT JOIN n2 ON n2.path = st.path AND n2.name = st.name LEFT JOIN n3 ON n3.path = st.path AND n3.name = st.name),
ced AS (SELECT src, dst, max(conf) conf, list_sort(list(DISTINCT line)) ls FROM res WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
ied AS (SELECT 'f:' || path src, 'f:' || dep dst FROM imp UNION ALL SELECT 'f:' || path, 'lib:os' FROM hd WHERE os),
dirs AS (SELECT DISTINCT split_part(path, '/', 1) dir FROM pt),
nodes AS (SELECT id, 'Function' kind, path, line FROM fn UNION ALL SELECT 'f:' || path, 'File', path, NULL FROM hd UNION ALL SELECT 'd:' || dir, 'Dir', dir, NULL FROM dirs UNION ALL SELECT 'd:.', 'Dir', '.', NULL UNION ALL SELECT DISTINCT 'lib:os', 'Library', NULL, NULL FROM hd WHERE os),
used AS (SELECT src, dst FROM ced UNION ALL SELECT src, dst FROM ied),
deg AS (SELECT nodes.*, coalesce(i, 0) indeg, coalesce(o, 0) outdeg FROM nodes LEFT JOIN (SELECT dst id, count(*) i FROM used GROUP BY 1) USING (id) LEFT JOIN (SELECT src id, count(*) o FROM used GROUP BY 1) USING (id))"""
)


def _busiest(kind: str, by: str) -> str:
    return f"(SELECT id FROM deg WHERE kind = '{kind}' ORDER BY {by} DESC, id LIMIT 1)"


CALLED, CALLING = _busiest("Function", "indeg"), _busiest("Function", "outdeg")

_REACH = "UNION SELECT {pick}, hop + 1 FROM bfs JOIN {edges} e ON e.{at} = bfs.id WHERE hop < {depth})"
_BOTH = "(SELECT src, dst FROM ced UNION SELECT dst, src FROM ced)"


def _reach(seeds: str, edges: str, depth: int, into: bool = False) -> str:
    """A recursive table bfs(id, hop), and near, with the least hop of each."""
    at, pick = ("dst", "e.src") if into else ("src", "e.dst")
    return f"bfs(id, hop) AS ({seeds} " + _REACH.format(pick=pick, edges=edges, at=at, depth=depth) + ", near AS (SELECT id, min(hop) hop FROM bfs GROUP BY id)"


def library(source: str) -> str:
    """Tables that end in lib: the rows of source with the library that raw names."""
    roots = "'org', 'com', 'io', 'net', 'javax', 'jakarta', 'edu', 'gov', 'uk', 'co', 'dev', 'cloud', 'app', 'me'"
    heads = "'from', 'import', 'require', 'include', 'use', 'package', 'module', 'export', 'default', 'as'"
    bare = lambda x: f"regexp_replace(regexp_replace({x}, '^[<>\"''\\s]+', ''), '[<>\"''\\s]+$', '')"
    picked = f"CASE WHEN len(ps) > 1 THEN CASE WHEN ps[1] IN ('.', '..') THEN t ELSE ps[1] END WHEN contains(t, '.') THEN CASE WHEN ds[1] IN ({roots}) AND len(ds) > 1 THEN ds[1] || '.' || ds[2] ELSE ds[1] END ELSE split_part(t, ':', 1) END"
    return f"""l1 AS (SELECT *, {bare('raw')} t FROM {source}), l2 AS (SELECT *, regexp_split_to_array(t, '[/\\\\]') ps, list_filter(string_split(t, '.'), lambda x: x <> '') ds FROM l1), l3 AS (SELECT *, {bare(picked)} n FROM l2),
lib AS (SELECT *, CASE WHEN length(n) BETWEEN 1 AND 40 AND split_part(n, '.', 1) NOT IN ({heads}) AND len(list_filter(string_split(n, '.'), lambda x: NOT regexp_matches(x, '^@?[A-Za-z_][\\w.\\-]*$'))) = 0 THEN n END AS library FROM l3)"""


_FORMS = """kp AS (SELECT p_partkey k, 'pkg' || replace(p_brand, 'Brand#', '') home, p_size size, CASE WHEN p_partkey % 23 = 0 THEN 'pkg' || replace(p_brand, 'Brand#', '') || '/__init__' WHEN p_partkey % 29 = 0 THEN 'pkg' || replace(p_brand, 'Brand#', '') || '/deep/only_' || p_partkey ELSE 'pkg' || replace(p_brand, 'Brand#', '') || '/m' || p_size END stem FROM part),
kq AS (SELECT *, size % 7 = 0 AND NOT ends_with(stem, '__init__') rb, regexp_extract(stem, '[^/]*$') tail, replace(stem, '/', '.') dotted FROM kp),
kr AS (SELECT *, stem || CASE WHEN rb THEN '.rb' ELSE '.py' END path, [dotted, '.' || tail, tail, '..' || dotted, './' || tail, 'org.nowhere.' || tail, home, stem || CASE WHEN rb THEN '.rb' ELSE '.py' END, 'deep.' || tail, '.'][k % 10 + 1] raw FROM kq),
files AS (SELECT DISTINCT path, stem, rb, CASE WHEN ends_with(stem, '/__init__') THEN home END pack FROM kr),
ask AS (SELECT DISTINCT a.path, a.rb, b.raw FROM kr a JOIN kr b ON a.k = b.k + 1),
ky AS (SELECT path file, rb, stem, unnest([{'key': path, 'prio': 0}, {'key': stem, 'prio': 1}, {'key': replace(stem, '/', '.'), 'prio': 1}, {'key': pack, 'prio': 2}]) e FROM files),
ex AS (SELECT file, rb, e.key AS key, e.prio prio FROM ky WHERE e.key IS NOT NULL),
lo AS (SELECT DISTINCT path file, rb, 'base' kind, unnest([regexp_extract(stem, '[^/]*$'), pack]) AS key FROM files UNION SELECT path, rb, 'suffix', unnest(list_transform(range(1, len(string_split(stem, '/')) + 1), lambda i: array_to_string(list_slice(string_split(stem, '/'), i, len(string_split(stem, '/'))), '/'))) FROM files),
a1 AS (SELECT *, length(regexp_extract(raw, '^[.]*')) lv, ltrim(raw, '.') nm, regexp_replace(path, '/[^/]*$', '') dir FROM ask),
a2 AS (SELECT *, replace(nm, '.', '/') dt, CASE WHEN lv = 2 THEN CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END ELSE dir END up FROM a1),
tries AS (SELECT path, raw, rb, unnest(CASE WHEN nm = '' THEN [] WHEN starts_with(raw, './') THEN [{'pos': 0, 'key': dir || nm}] WHEN lv > 0 THEN [{'pos': 0, 'key': CASE WHEN up = '' THEN dt ELSE up || '/' || dt END}] ELSE [{'pos': 0, 'key': dir || '/' || nm}, {'pos': 1, 'key': dir || '/' || dt}, {'pos': 2, 'key': nm}, {'pos': 3, 'key': dt}] END) c FROM a2),
hit AS (SELECT t.path, t.raw, arg_min(file, (c.pos, prio, file)) f FROM tries t JOIN ex ON ex.key = c.key WHERE file <> t.path AND ex.rb = t.rb GROUP BY 1, 2),
uni AS (SELECT a2.path, a2.raw, min(file) f FROM a2 JOIN lo ON lo.kind = CASE WHEN contains(nm, '.') THEN 'suffix' ELSE 'base' END AND lo.key = CASE WHEN contains(nm, '.') THEN dt ELSE regexp_extract(nm, '[^/]*$') END WHERE lv = 0 AND nm <> '' AND file <> a2.path AND lo.rb = a2.rb GROUP BY 1, 2 HAVING count(DISTINCT file) = 1),
l AS (SELECT a2.path, a2.raw, lv, coalesce(hit.f, uni.f) resolved FROM a2 LEFT JOIN hit USING (path, raw) LEFT JOIN uni USING (path, raw))"""

_SCAN = """sc AS (SELECT DISTINCT p_partkey // 60 h, ['src', 'build', 'node_modules', 'target', '.hidden', 'env', 'docs', 'out', 'jspm_packages', 'gen', 'coverage'][p_partkey % 11 + 1] folder, ['a.py', 'b.min.js', 'c.JAVA', 'd.md', 'package-lock.json', 'f.lock', 'g.d.ts', 'h.R', 'i.go', 'notes.TXT', 'j.unknown', 'k.bundle.js', 'l.tmp.py'][(p_partkey // 11) % 13 + 1] file FROM part),
kept AS (SELECT 'p' || h || '/' || folder || '/' || file path, file FROM sc WHERE folder NOT IN ('node_modules', '.hidden', 'jspm_packages') AND NOT (folder IN ('build', 'target', 'out', 'coverage') AND h % 2 = 0) AND NOT (folder = 'env' AND h % 3 = 0)
 AND NOT (h % 4 = 1 AND (folder = 'gen' OR (file = 'l.tmp.py' AND folder <> 'src')))
 UNION ALL SELECT DISTINCT 'p' || h || CASE WHEN h % 2 = 0 THEN '/pom.xml' ELSE '/readme.md' END, CASE WHEN h % 2 = 0 THEN 'pom.xml' ELSE 'readme.md' END FROM (SELECT p_partkey // 60 h FROM part)),
named AS (SELECT path, CASE file WHEN 'a.py' THEN 'python' WHEN 'l.tmp.py' THEN 'python' WHEN 'c.JAVA' THEN 'java' WHEN 'h.R' THEN 'r' WHEN 'i.go' THEN 'go' WHEN 'd.md' THEN 'markdown' WHEN 'notes.TXT' THEN 'markdown' WHEN 'readme.md' THEN 'markdown' WHEN 'package-lock.json' THEN 'config' WHEN 'pom.xml' THEN 'config' END lang FROM kept)"""

_NUMBER = "ascii(substr(sha1(path), 1, 1)) * 100 + ascii(substr(sha1(path), 2, 1)) * 10 + ascii(substr(sha1(path), 3, 1))"


_CYCLES = "e AS (SELECT * FROM ied WHERE dst LIKE 'f:%'), clo(a, b) AS (SELECT src, dst FROM e UNION SELECT clo.a, e.dst FROM clo JOIN e ON e.src = clo.b), mut AS (SELECT x.a id, x.b other FROM clo x JOIN clo y ON x.a = y.b AND x.b = y.a), comp AS (SELECT id, min(other) component FROM mut GROUP BY id HAVING count(DISTINCT other) > 1)"


def _statistics() -> str:
    """A row for each number: its name and value."""
    file = "fl AS (SELECT path, split_part(path, '/', 1) dir, max(h) + sum(length + 1) loc, max(h) + sum(length - d) code, sum(d) comment, 2 * sum(b) complexity, count(*) n FROM fn GROUP BY path)"
    names = "na AS (SELECT name FROM fn UNION ALL SELECT regexp_extract(path, '([^/.]*)[.]py$', 1) FROM hd)"
    cryptic = "(length(name) <= 2 AND name NOT IN ('id', 'ok', 'db', 'io')) OR (length(name) <= 3 AND upper(name) = name AND lower(name) <> name)"
    values = {
        "files": "(SELECT count(*) FROM fl)",
        "loc": "(SELECT avg(loc) FROM fl)",
        "large": "(SELECT count(*) FROM fl WHERE loc > 600)",
        "nesting": "1",
        "code": "(SELECT sum(code) FROM fl)",
        "comment": "(SELECT sum(comment) FROM fl)",
        "typed": "0",
        "file_complexity": "(SELECT avg(complexity) FROM fl)",
        "cryptic": f"(SELECT avg(({cryptic})::int) FROM na)",
        "per_dir": "(SELECT avg(c) FROM (SELECT count(*) c FROM fl GROUP BY dir))",
        "depth": "1",
        "readme": "0",
        "entry": "0",
        "docs": "0",
        "functions": "(SELECT count(*) FROM fn)",
        "length": "(SELECT avg(length) FROM fn)",
        "long": "(SELECT count(*) FROM fn WHERE length > 80)",
        "complexity": "(SELECT avg(1 + 2 * b) FROM fn)",
        "tangled": "0",
        "documented": "(SELECT avg(d) FROM fn)",
        "cohesion": "(SELECT avg(n) FROM fl)",
        "twins": "(SELECT sum(c - 1) FROM (SELECT count(*) c FROM fl GROUP BY code, complexity, n))",
        "links": "(SELECT count(*) FROM imp)",
        "risky": "(SELECT count(*) FROM (SELECT dep FROM imp GROUP BY dep HAVING count(*) > 12))",
        "file_nodes": "(SELECT count(*) FROM hd)",
        "libraries": "(SELECT count(DISTINCT os) FROM hd WHERE os)",
        "cycles": "(SELECT count(DISTINCT component) FROM comp)",
        "p95": "(SELECT c FROM (SELECT 1 + 2 * b c, row_number() OVER (ORDER BY b) r, count(*) OVER () n FROM fn) WHERE r = CASE WHEN n > 5 THEN floor(n * 0.95) ELSE n END)",
    }
    return f"WITH RECURSIVE {CALLS}, {_CYCLES}, {file}, {names} " + " UNION ALL ".join(f"SELECT '{name}' AS name, {value}::double AS value" for name, value in values.items())


def oracle_sql() -> dict[str, str]:
    return {
        "tree_statistics": _statistics(),
        "tree_files": f"WITH {TREE} SELECT path, (max(h) + sum(length + 1))::int loc, (max(h) + sum(length - d))::int code_lines, sum(d)::int comment_lines, count(*)::int blank_lines, (2 * sum(b))::int complexity, 1 max_nesting, false has_types, 0 unparsed, 'ast' frontend FROM fn GROUP BY path",
        "tree_symbols": f"WITH {TREE} SELECT id, path, name, line, length::int length, 1 + 2 * b complexity, d = 1 documented FROM fn",
        "tree_imports": f"WITH {TREE} SELECT path, replace(replace(dep, '.py', ''), '/', '.') raw, dep resolved, NULL::varchar AS library FROM imp UNION ALL SELECT path, 'os', NULL, 'os' FROM hd WHERE os",
        "tree_calls": f"WITH {CALLS} SELECT src, dst, conf, array_to_string(ls, ',') AS lines FROM ced",
        "tree_open_calls": f"WITH {CALLS} SELECT name, src, path, line FROM res WHERE dst IS NULL",
        "tree_degrees": f"WITH {CALLS} SELECT id, kind, indeg, outdeg FROM deg",
        "tree_contains": f"WITH {TREE} SELECT 'd:.' src, count(DISTINCT split_part(path, '/', 1)) n FROM hd UNION ALL SELECT 'd:' || split_part(path, '/', 1), count(*) FROM hd GROUP BY 1 UNION ALL SELECT 'f:' || path, count(*) FROM fn GROUP BY 1",
        "tree_patterns": f"WITH {TREE} SELECT path, name, 'Function' kind, line, length::int length, 1 + 2 * b complexity, d = 1 documented, (SELECT count(*) FROM nm WHERE nm.k = fn.k AND nm.name <> fn.name) calls FROM fn",
        "tree_java": f"WITH {TREE}, m AS (SELECT pt.k, split_part(path, '/', 1) home, (SELECT count(*) FROM pairs WHERE pairs.k = pt.k) n FROM pt), j AS (SELECT *, (4 + coalesce(sum(n + 3) OVER (PARTITION BY home ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int line, 's:' || home || '/Parts.java#f' || k id FROM m) SELECT a.id src, b.id dst, 1.0::double conf, (a.line + row_number() OVER (PARTITION BY a.k ORDER BY b.k))::varchar AS lines FROM pairs JOIN j a ON a.k = pairs.k JOIN j b ON b.k = callee",
        "tree_reindex": f"WITH {TREE}, z AS (SELECT path, {_NUMBER} x FROM hd) SELECT path, CASE WHEN x % 10 = 0 OR x % 7 = 0 THEN 'parsed' ELSE 'same' END state FROM z WHERE x % 11 <> 0",
        "tree_scan": f"WITH {_SCAN} SELECT path, lang, CASE lang WHEN 'markdown' THEN 'doc' WHEN 'config' THEN 'config' ELSE 'code' END kind FROM named WHERE lang IS NOT NULL",
        "import_resolution": f"WITH {_FORMS}, {library('l')} SELECT path, raw, resolved, CASE WHEN resolved IS NULL AND lv = 0 THEN library END AS library FROM lib",
        "cmd_entry_points": f"WITH {CALLS}, code AS (SELECT * FROM deg WHERE kind = 'File'), mains AS (SELECT DISTINCT path FROM fn WHERE name = 'main'), sco AS (SELECT id, path, outdeg, path IN (SELECT path FROM mains) m, id NOT IN (SELECT dst FROM ied) u FROM code) SELECT path, CASE WHEN m THEN 'main()' ELSE 'unimported' END why, 100 * m::int + 10 * u::int score FROM sco ORDER BY score DESC, outdeg DESC, id LIMIT 8",
        "cmd_overview": f"WITH {CALLS}, fl AS (SELECT path, max(h) + sum(length + 1) loc FROM fn GROUP BY path), dr AS (SELECT d AS name, count(*) files, sum(loc)::bigint n FROM (SELECT loc, unnest(['.', split_part(path, '/', 1)]) d FROM fl) GROUP BY 1), big AS (SELECT max(files) most FROM dr WHERE name <> '.') SELECT * FROM (SELECT 'dirs' section, name, n FROM dr ORDER BY n DESC, name LIMIT 12) UNION ALL SELECT * FROM (SELECT 'hubs', dst, count(*) n FROM ied WHERE dst LIKE 'f:%' GROUP BY dst ORDER BY n DESC, dst LIMIT 8) UNION ALL SELECT 'libraries', dst, count(*) FROM ied WHERE dst LIKE 'lib:%' GROUP BY dst UNION ALL SELECT 'languages', 'python', count(*) FROM hd UNION ALL SELECT 'edges', 'calls', count(*) FROM ced UNION ALL SELECT 'edges', 'imports', count(*) FROM ied UNION ALL SELECT 'edges', 'contains', (SELECT count(*) FROM dirs) + (SELECT count(*) FROM hd) + (SELECT count(*) FROM fn)",
        "cmd_find": f"WITH {CALLS}, m AS (SELECT deg.id, indeg + outdeg g FROM deg JOIN fn USING (id) WHERE contains(name, 'blue_bolt') OR contains(fn.path, 'blue_bolt')) SELECT id, 8 tier, (SELECT count(*) FROM m) total FROM m ORDER BY g DESC, id LIMIT 50",
        "cmd_outline": f"WITH {CALLS}, t AS (SELECT {_busiest('File', 'indeg')} id) SELECT 'symbols' section, fn.id, line FROM fn, t WHERE 'f:' || path = t.id UNION ALL SELECT 'imports', dst, NULL FROM ied, t WHERE src = t.id UNION ALL SELECT * FROM (SELECT 'importers', src, NULL FROM ied, t WHERE dst = t.id ORDER BY src LIMIT 200)",
        "cmd_who_calls": f"WITH {CALLS}, t AS (SELECT id, name FROM fn WHERE id = {CALLED}), c AS (SELECT ced.* FROM ced, t WHERE dst = t.id), u AS (SELECT res.* FROM res, t WHERE res.name = t.name AND res.dst IS NULL), s AS (SELECT * FROM c ORDER BY conf DESC, src LIMIT 500) SELECT 'verdict' section, t.id path, (SELECT count(*) FROM c)::int line, (SELECT count(*) FROM c WHERE conf < 0.95)::int guesses, (SELECT count(*) FROM u)::int unresolved, (SELECT count(*) FROM u) = 0 AND (SELECT count(*) FROM c WHERE conf < 0.95) = 0 AND (SELECT count(*) FROM c) <= 500 complete FROM t UNION ALL SELECT 'site', fn.path, unnest(ls), NULL, NULL, NULL FROM s JOIN fn ON fn.id = s.src UNION ALL SELECT 'open', path, line, NULL, NULL, NULL FROM (SELECT path, line FROM u ORDER BY path, line LIMIT 50)",
        "cmd_calls": f"WITH {CALLS}, c AS (SELECT * FROM ced WHERE src = {CALLING}) SELECT dst id, conf, CASE WHEN conf >= 0.95 THEN '' WHEN conf >= 0.8 THEN ' ~' ELSE ' ?' END tag, (SELECT count(*) FROM c) total FROM c",
        "cmd_neighbors": f"WITH RECURSIVE {CALLS}, {_reach(f'SELECT {CALLED}, 0', _BOTH, 2)} SELECT id, hop FROM near WHERE hop > 0",
        "cmd_deps": f"WITH {CALLS}, c AS (SELECT DISTINCT dst id FROM ied WHERE src = {_busiest('File', 'outdeg')}) SELECT id, 1 hop, (SELECT count(*) FROM c) total FROM c ORDER BY CASE WHEN id = 'lib:os' THEN '' ELSE substr(id, 3) END, id LIMIT 500",
        "cmd_dependents": f"WITH {CALLS}, c AS (SELECT src id FROM ied WHERE dst = 'lib:os') SELECT id, 1 hop, (SELECT count(*) FROM c) total FROM c",
        "cmd_impact": f"WITH RECURSIVE {CALLS}, {_reach(f'SELECT {CALLED}, 0', 'ced', 2, into=True)}, g AS (SELECT path, hop FROM near JOIN fn USING (id) WHERE hop > 0) SELECT path, min(hop) hop, count(*)::int symbols, (SELECT count(*) FROM g) reached FROM g GROUP BY path",
        "cmd_subgraph": f"WITH RECURSIVE {CALLS}, {_reach(f'SELECT unnest([{CALLED}, {CALLING}]), 0', _BOTH, 1)} SELECT path, min(hop) hop, count(*)::int symbols, 1 missed FROM near JOIN fn USING (id) GROUP BY path",
        "cmd_span": f"WITH {CALLS}, t AS (SELECT * FROM fn WHERE id = {CALLING}), ls AS (SELECT CASE WHEN (SELECT brand FROM t) % 5 = 0 THEN ['import os'] ELSE [] END || coalesce((SELECT list('import ' || replace(replace(dep, '.py', ''), '/', '.') ORDER BY 'import ' || replace(replace(dep, '.py', ''), '/', '.')) FROM imp WHERE path = (SELECT path FROM t)), []) || (SELECT string_split(string_agg(raw || chr(10), chr(10) ORDER BY k), chr(10)) FROM fn WHERE path = (SELECT path FROM t)) x), n AS (SELECT unnest(x) text, generate_subscripts(x, 1)::int line FROM ls) SELECT n.line, n.text, false stale FROM n, t WHERE n.line BETWEEN t.line - 1 AND t.line + t.length",
        "cmd_hubs": f"WITH {CALLS}, i AS (SELECT * FROM ied WHERE dst LIKE 'f:%') SELECT * FROM (SELECT id, count(*) n FROM (SELECT src id FROM i UNION ALL SELECT dst FROM i) GROUP BY id ORDER BY n DESC, id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, indeg FROM deg WHERE kind = 'Function' AND indeg > 0 ORDER BY indeg DESC, id LIMIT 20)",
        "cmd_cycles": f"WITH RECURSIVE {CALLS}, {_CYCLES} SELECT component, count(*)::int size, sha1(string_agg(id, ',' ORDER BY id)) members FROM comp GROUP BY component",
    }
