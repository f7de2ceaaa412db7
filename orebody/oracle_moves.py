"""DuckDB SQL for the queries of queries_moves.py."""

from __future__ import annotations

from dataclasses import fields

from .config import Config
from .oracle import _ALL, _C, _L, _M, _e
from .oracle import ORACLE as _ENGINE
from .oracle_plans import _OI, _P

_A = "ad AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u FROM pages)"
_STRIP = r"'(\.d)?\.[A-Za-z0-9]+$', ''"
#: Tokens of each page's text as (page, token, path, absolute, ext), and the moves.
_PR = rf"""{_A}, tx AS (SELECT page_id, 'see ' || u || ' or /srv/' || u || ' or ./' || replace(u, '/', '\') || ' or x/' || u AS t FROM ad), tk AS (SELECT page_id, unnest(regexp_extract_all(t, '[A-Za-z0-9_@.\-\\/]+')) AS token FROM tx), nt AS (SELECT *, starts_with(replace(token, '\', '/'), '/') AS ab, regexp_replace(replace(token, '\', '/'), '^(\./|/+)', '') AS path FROM tk),
    ok AS (SELECT *, string_split(path, '/') AS s, contains(string_split(path, '/')[-1], '.') AS ext FROM nt WHERE contains(path, '/') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..'])), ks AS (SELECT page_id, token, ext, array_to_string(s[i:], '/') AS key FROM (SELECT *, unnest(CASE WHEN ab THEN range(1, len(s) + 1) ELSE [1] END) AS i FROM ok)),
    mv AS (SELECT u AS source, 'moved/' || min(page_id) AS target FROM ad WHERE page_id % 3 = 0 GROUP BY 1), kn AS (SELECT source AS key, source AS donor, target, true AS ext FROM mv UNION ALL SELECT regexp_replace(source, {_STRIP}), source, regexp_replace(target, {_STRIP}), false FROM mv),
    pr AS (SELECT page_id AS file, length(token) - length(key) AS start, length(token) AS "end", token AS "from", CASE WHEN contains(token, '\') THEN replace(target, '/', '\') ELSE target END AS "to", donor FROM ks JOIN kn USING (key, ext))"""
_REACH = f"WITH RECURSIVE {_e()}, {_M}, s AS (SELECT path AS id FROM m WHERE domain = 'Brand#1' UNION SELECT e.dst FROM s JOIN e ON e.src = s.id AND NOT e.type_only)"
_ND = "nd AS (SELECT l_orderkey % 40 AS plan, l_orderkey AS file, l_suppkey AS name, l_returnflag = 'A' AS ty, l_orderkey % 10 = 3 AS test FROM lineitem)"
_IN = f"{_ND}, inf AS (SELECT plan, name, CASE WHEN bool_or(NOT ty AND NOT test) THEN 'runtime' ELSE 'dev' END AS section, CASE WHEN (plan + name) % 5 = 0 THEN NULL WHEN name % 2 = 0 THEN '1' WHEN plan % 3 = 0 THEN NULL ELSE '2' END AS version, CASE WHEN (plan + name) % 5 = 0 THEN 'undeclared' WHEN name % 2 <> 0 AND plan % 3 = 0 THEN 'ambiguous' END AS fault FROM nd WHERE (plan, name) NOT IN (SELECT s_suppkey % 40, s_suppkey FROM supplier) GROUP BY 1, 2)"
_JO = "ph AS (SELECT owner AS plan, path AS k, file AS path, 'libs/' || lower(owner) || '/src/' || path AS target FROM m), jr AS (SELECT plan, path, NULL AS target, 'write-file' AS kind, 5 AS p FROM ph WHERE k % 7 = 0 UNION ALL SELECT plan, path, target, 'move-asset', 1 FROM ph WHERE k % 10 = 7 UNION ALL SELECT plan, path, NULL, 'rewrite-import', 3 FROM ph WHERE k % 4 = 1 UNION ALL SELECT plan, path, target, 'move', 0 FROM ph WHERE k % 3 = 0 AND k % 10 <> 7 UNION ALL SELECT plan, path, NULL, 'migrate-path-keys', 7 FROM ph WHERE k % 97 = 0 UNION ALL SELECT plan, path, NULL, 'rewrite-path-reference', 2 FROM ph WHERE k % 11 = 0), jo AS (SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY p, path) - 1 AS idx, kind, path, target FROM jr)"
#: operation_issues where every part's own file is a declared consumer.
_OWN = _P.replace("SELECT DISTINCT owner AS plan, 'src/' || lower(owner) || '/' || path % 150 AS file FROM m WHERE path % 6 <> 0", "SELECT DISTINCT owner AS plan, file FROM m")
_TC = f"WITH RECURSIVE {_e(45)}, {_M}, tc AS (SELECT path AS id FROM m WHERE path % 30 = 0 UNION SELECT e.dst FROM tc JOIN e ON e.src = tc.id AND e.src % 3 = 0 AND e.dst % 3 = 0), th AS (SELECT id, id IN (SELECT dst FROM e WHERE src NOT IN (SELECT id FROM tc)) AS held FROM tc)"
_SR = "sr AS (SELECT e.src, e.dst, CASE WHEN e.dst % 7 = 0 THEN (CASE WHEN e.src % 2 = 0 THEN NULL ELSE 'import x from \"@engine/' || lower(m.owner) || '''s\"; // ./' || e.dst END) ELSE 'import x from ' || q || '@engine/' || lower(m.owner) || q || '; // ./' || e.dst END AS rewritten FROM (SELECT *, CASE WHEN src % 2 = 0 THEN '''' ELSE '\"' END AS q FROM e) e JOIN m ON m.path = e.dst)"
_DOM = "SELECT m.path, m.domain AS d, m.owner AS o, m.owner || '/' || m.domain AS od FROM m"

_PREP = f"""WITH RECURSIVE {_e(45)}, bad AS (SELECT src AS id, src, dst FROM e WHERE NOT type_only), st AS (SELECT p_partkey // 2 AS key, p_partkey AS id FROM part),
    r AS (SELECT key, id, 0 AS depth FROM st UNION SELECT r.key, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id AND e.type_only WHERE r.depth < 60 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.id = r.id)),
    rf AS (SELECT r.key, bad.src, bad.dst FROM r JOIN bad USING (id) QUALIFY row_number() OVER (PARTITION BY r.key ORDER BY r.depth, bad.src, bad.dst) = 1)"""

_LK = """ld AS (SELECT o_custkey AS lock, 'packages/p' || o_orderkey AS root, CASE l_returnflag WHEN 'A' THEN 'dependencies' WHEN 'R' THEN 'devDependencies' ELSE 'optionalDependencies' END AS section, CASE WHEN l_partkey % 2 = 0 THEN '@s' || l_suppkey || '/p' || l_partkey ELSE 'p' || l_partkey END AS name, any_value(o_orderkey) AS r, any_value(l_partkey) AS d, max(l_quantity)::BIGINT AS q, min(l_linenumber) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4)"""
ORACLE: dict[str, str] = {
    "path_rewrites": f"WITH {_PR} SELECT * FROM pr",
    "path_reference_warnings": rf"""WITH {_PR}, g AS (SELECT string_split(string_split(donor, '/')[1], '.')[-1] AS "group", file, donor FROM pr) SELECT "group", count(*) AS n, count(DISTINCT file) AS files, arg_min(file || ':' || donor, (file, donor)) AS first FROM g GROUP BY 1""",
    "literal_fits": r"WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '''s' WHEN 1 THEN '${' || p_name || '}' WHEN 2 THEN p_name || '\' ELSE p_name END AS t, ['\"', '''', '`', '/'][p_partkey % 4 + 1] AS d FROM part) SELECT p_partkey, d <> '/' AND NOT contains(t, d) AND NOT contains(t, '\') AND (d <> '`' OR NOT contains(t, '${')) AS fits FROM p".replace('\\"', '"'),
    "specifier_rewrites": f"WITH {_e()}, {_M}, {_SR} SELECT * FROM sr",
    "codemod_replay": f"WITH {_e()}, {_M}, {_SR} SELECT src, dst FROM sr WHERE rewritten IS NOT NULL AND dst % 13 = 0",
    "escape_rewrites": f"WITH {_e(45)}, {_M} SELECT e.src AS file, string_agg(DISTINCT './' || e.dst || '>@engine/' || lower(b.owner), ' ' ORDER BY './' || e.dst || '>@engine/' || lower(b.owner)) AS rewrites FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.owner <> b.owner GROUP BY 1",
    "import_operations": f"""WITH {_e(45)} SELECT src AS file, count(*) AS rewrites, sha256(string_agg('import "./' || dst || '";', chr(10) ORDER BY dst)) AS before, sha256(string_agg('import "@engine/p' || dst || '";', chr(10) ORDER BY dst)) AS after, count(*) FILTER (dynamic) AS dynamic FROM e WHERE src % 13 <> 0 GROUP BY 1""",
    "fs_rewrites": f"WITH {_e()}, {_M} SELECT a.file AS source, '../' || lower(b.owner) || '/' || e.dst AS \"from\", '../../libs/' || lower(b.owner) || '/src/' || e.dst AS \"to\" FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE e.dst % 4 = 0",
    "emitted_specifiers": f"WITH {_e()}, {_M} SELECT e.src AS file, '../' || lower(b.owner) || '/./' || e.dst || '.js' AS specifier, 'libs/' || e.dst || '.ts' AS \"to\" FROM e JOIN m b ON b.path = e.dst WHERE e.dst % 3 <> 0",
    "entry_points": """WITH p AS (SELECT s_suppkey AS k, unnest([CASE WHEN s_suppkey % 5 = 0 THEN 'whole.ts' END, CASE WHEN s_suppkey % 2 = 0 THEN 'import.ts' END, CASE WHEN s_suppkey % 3 = 0 THEN 'default.ts' END, CASE WHEN s_suppkey % 7 = 0 THEN 'types.d.ts' END, CASE WHEN s_suppkey % 4 <> 0 THEN 'main.ts' END, 'index.d.ts']) AS n, unnest([1, 2, 3, 4, 5, 6]) AS o FROM supplier), f AS (SELECT k, arg_min(n, o) AS n FROM p WHERE n IS NOT NULL AND (k + length(n)) % 3 <> 0 GROUP BY 1) SELECT 'libs/' || s_suppkey AS owner, 'libs/' || s_suppkey || '/' || n AS entry FROM supplier LEFT JOIN f ON k = s_suppkey""",
    "alias_paths": f"WITH {_M} SELECT path, CASE path % 4 WHEN 0 THEN 'app/' || file || '.ts' WHEN 1 THEN 'styles/' || lower(owner) || '.css' WHEN 2 THEN 'src/config.ts' END AS resolved FROM m",
    "target_paths": r"""WITH m AS (SELECT p_partkey AS k, 'src/' || lower(p_type) || '/' || p_partkey AS file FROM part), r AS (SELECT k, CASE k % 4 WHEN 0 THEN file WHEN 1 THEN 'a/' || k || '.ts' WHEN 2 THEN k || '.ts' END AS relative, CASE k % 4 WHEN 0 THEN k::VARCHAR WHEN 3 THEN k::VARCHAR ELSE k || '.ts' END AS name, (k % 6 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) % 6 AS a FROM m),
        s AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE a WHEN 0 THEN 'src' WHEN 1 THEN 'src/deep' WHEN 5 THEN 'src/win' END END AS subpath FROM r) SELECT k AS path, relative, subpath, CASE WHEN subpath IS NULL THEN relative WHEN subpath = 'src' THEN name ELSE substr(subpath, 5) || '/' || name END AS module FROM s""",
    "extension_violations": f"WITH {_e(45)}, r AS (SELECT src AS file, dst AS line, CASE WHEN dst % 2 = 0 THEN './' ELSE 'pkg/' END || dst || ['.ts', '.tsx', '', '.css', '.mjs'][dst % 5 + 1] AS specifier FROM e) SELECT * FROM r WHERE starts_with(specifier, '.') AND NOT (suffix(specifier, '.ts') OR suffix(specifier, '.tsx') OR suffix(specifier, '.css'))",
    "text_excerpts": "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 40) || '...' || substr(text, length(text) - 19, 20) END AS excerpt FROM documents WHERE text IS NOT NULL",
    "trimmed_diffs": "WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n // 2 AS front, n - n // 2 - 1 AS back, 1 AS changed FROM d",
    "recommendation_advice": f"{_ALL} SELECT advice, status, count(*) AS n FROM (SELECT unnest(advice) AS advice, status FROM j) GROUP BY 1, 2",
    "candidate_effort": f"{_ALL} SELECT id, review_units, risk, cohesion, files, tests, assets, consumers, escapes, warnings, len(codes) AS blockers FROM j",
    "candidate_classes": f"WITH {_e()}, {_M}, b AS (SELECT a.owner || '/' || a.domain AS cand, count(DISTINCT e.dst) AS blockers FROM e JOIN m a ON a.path = e.src WHERE e.dst % 50 = 0 GROUP BY 1), f AS (SELECT DISTINCT owner || '/' || domain AS cand, domain FROM m) SELECT f.cand, coalesce(blockers, 0) AS blockers, CASE WHEN blockers > 0 OR domain = 'Brand#3' THEN 'preparation' ELSE 'extraction' END AS class FROM f LEFT JOIN b USING (cand)",
    "first_reasons": "SELECT l_orderkey AS id, l_returnflag AS code, l_linestatus AS detail, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey) = 1",
    "candidate_details": f"WITH {_M}, c AS (SELECT domain AS cand, file || CASE WHEN path % 2 = 0 THEN '.ts' ELSE '/a.ts' END AS p, path % 10 AS k FROM m) SELECT cand, coalesce(string_agg(p, ',' ORDER BY p) FILTER (k NOT IN (3, 7)), '') AS files, coalesce(string_agg(p, ',' ORDER BY p) FILTER (k = 3), '') AS tests, coalesce(string_agg(p, ',' ORDER BY p) FILTER (k = 7), '') AS assets, count(*) AS closure FROM c GROUP BY 1",
    "claiming_candidates": f"WITH {_M}, c AS (SELECT domain AS cand, file || CASE WHEN path % 2 = 0 THEN '.ts' ELSE '/a.ts' END AS p FROM m), q AS (SELECT * FROM (VALUES ('./src/promo/', 'src/promo'), ('src/small/1', 'src/small/1'), ('src/economy/29', 'src/economy/29')) v(path, root)) SELECT DISTINCT q.path, cand FROM c JOIN q ON p = root OR starts_with(p, root || '/')",
    "evaluation_warnings": f"{_REACH}, f AS (SELECT m.* FROM m JOIN s ON s.id = m.path) SELECT count(*) AS modules, count(*) FILTER (path % 4 = 0) AS effectful, count(*) FILTER (path % 4 = 0 AND domain <> 'Brand#1') AS beyond, min(path) FILTER (path % 4 = 0) AS first, (SELECT string_agg(owner, ',' ORDER BY r, owner) FROM (SELECT owner, min(path % 4) AS r FROM f GROUP BY 1 ORDER BY 2, 1 LIMIT 3)) AS packages FROM f",
    "conflict_report": """WITH a AS (SELECT l_orderkey AS plan, l_partkey AS path, ['consumer-source', 'lockfile-importer', 'move-target', 'generated-source', 'task-file', 'package-manifest', 'workspace-registry'][(l_partkey + CASE WHEN l_quantity > 49 THEN l_linenumber ELSE 0 END) % 7 + 1] AS role, l_suppkey * 100 + l_orderkey % 100 AS key FROM lineitem),
        p AS (SELECT path, count(DISTINCT plan) AS plans, list(DISTINCT role) AS roles FROM a GROUP BY 1 HAVING count(DISTINCT plan) > 1), sh AS (SELECT DISTINCT path FROM a GROUP BY path, key HAVING count(DISTINCT plan) > 1)
        SELECT path, plans, CASE WHEN list_contains(roles, 'generated-source') THEN 'generated-artifact' WHEN list_contains(roles, 'move-target') THEN 'moved-path' WHEN list_contains(roles, 'consumer-source') THEN 'consumer-source' WHEN list_contains(roles, 'lockfile-importer') THEN 'lockfile-importer' WHEN list_contains(roles, 'workspace-registry') THEN 'workspace-registry' WHEN list_contains(roles, 'package-manifest') THEN 'package-manifest' ELSE 'scaffold-output' END AS category, CASE WHEN len(roles) = 1 AND roles[1] IN ('consumer-source', 'lockfile-importer', 'workspace-registry') AND path NOT IN (SELECT path FROM sh) THEN 'mergeable' ELSE 'exclusive' END AS disposition FROM p""",
    "owners_of_orders": f"WITH {_M}, u AS (SELECT l_orderkey, domain AS x FROM lineitem JOIN m ON path = l_partkey UNION SELECT l_orderkey, owner FROM lineitem JOIN m ON path = l_partkey) SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS names FROM u GROUP BY 1",
    "shared_files": "WITH l AS (SELECT DISTINCT p_brand, l_suppkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45), n AS (SELECT p_brand, count(DISTINCT p_size) AS n FROM l GROUP BY 1) SELECT p_brand, l_suppkey FROM l JOIN n USING (p_brand) GROUP BY 1, 2, n HAVING count(*) = n",
    "unselected_dependencies": f"WITH {_e()} SELECT DISTINCT dst AS id FROM e WHERE src % 4 = 0 AND dst % 4 <> 0",
    "equal_sets": "WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 3) FILTER (l_linenumber < 4)) AS a, list_sort(list(DISTINCT l_suppkey % 3) FILTER (l_linenumber >= 4)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(a, []) = coalesce(b, []) AS equal FROM g",
    "last_reports": "SELECT l_partkey AS path, l_suppkey AS report, sum(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey DESC) = 1",
    "sorted_inserts": "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders UNION SELECT o_custkey, 1995 FROM orders) SELECT o_custkey, string_agg(y::VARCHAR, ',' ORDER BY y) AS years FROM y GROUP BY 1",
    "rollup_counts": "SELECT p_type, p_brand, grouping(p_type, p_brand) AS level, count(*) AS n, sum(p_size)::BIGINT AS size, true AS near FROM part GROUP BY ROLLUP (p_type, p_brand)",
    "consumer_sections": "SELECT l_suppkey AS owner, l_partkey AS package, CASE WHEN bool_or(l_returnflag = 'R') THEN 'runtime' ELSE 'dev' END AS section FROM lineitem GROUP BY 1, 2",
    "declaration_batch": "SELECT p_brand AS file, count(*) AS declarations, count(DISTINCT p_name) AS names, count(*) FILTER (p_retailprice >= 1000) AS exported, max(p_size) AS largest FROM part GROUP BY 1",
    "journal_order": f"WITH {_M}, {_JO} SELECT * FROM jo",
    "plan_pipeline": f"WITH {_OWN}, {_OI}, {_JO}, a AS (SELECT plan, count(*) AS operations, count(*) FILTER (kind LIKE 'move%') AS moves, arg_min(path, idx) AS first, arg_max(path, idx) AS last FROM jo GROUP BY 1) SELECT a.*, (SELECT count(DISTINCT subject) FROM oz WHERE oz.plan = a.plan) AS faulty FROM a",
    "consolidation_order": f"WITH {_P} SELECT plan, idx, kind, row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN kind = 'rewrite-import' THEN 0 WHEN mv THEN 1 ELSE 2 END, idx) AS place FROM op",
    "inferred_dependencies": f"WITH {_IN} SELECT * FROM inf",
    "jsx_dependencies": f"""WITH {_IN}, so AS (SELECT p_partkey % 40 AS plan, p_partkey % 120 AS owner, p_partkey % 3 = 0 AS tsx FROM part), du AS (SELECT plan FROM so WHERE plan % 4 <> 0 GROUP BY 1 HAVING bool_or(tsx)), vs AS (SELECT so.plan, count(DISTINCT s_nationkey % 2) AS k, min('18.' || s_nationkey % 2) AS v FROM (SELECT DISTINCT plan, owner FROM so) so JOIN supplier ON s_suppkey % 120 = so.owner WHERE s_nationkey < 8 GROUP BY 1)
        SELECT plan, name::VARCHAR AS name, section, version::VARCHAR AS version, fault FROM inf UNION ALL SELECT du.plan, 'react', 'runtime', CASE WHEN k IS NULL THEN '17.0' WHEN k = 1 THEN v END, CASE WHEN k > 1 THEN 'ambiguous' END FROM du LEFT JOIN vs USING (plan)""",
    "dependency_decisions": f"WITH {_IN}, w AS (SELECT plan, name, string_agg(DISTINCT CASE WHEN test THEN 'test-import' WHEN ty THEN 'type-only-import' ELSE 'production-import' END, ',' ORDER BY CASE WHEN test THEN 'test-import' WHEN ty THEN 'type-only-import' ELSE 'production-import' END) AS reasons, count(DISTINCT file) AS sources FROM nd GROUP BY 1, 2) SELECT plan, name, 'target-' || section AS decision, reasons, sources FROM inf JOIN w USING (plan, name) UNION ALL SELECT s_suppkey % 40, s_suppkey, 'donor-remove', 'no-retained-consumer', 0 FROM supplier WHERE s_acctbal < 0",
    "effect_inventory": f"{_REACH}, u AS (SELECT 'moved' AS origin, path FROM m WHERE domain = 'Brand#1' UNION ALL SELECT 'generated', path FROM m WHERE path % 20 = 0 UNION ALL SELECT 'reached', id FROM s WHERE id NOT IN (SELECT path FROM m WHERE domain = 'Brand#1') UNION ALL SELECT 'package', path FROM m WHERE zone = 'package') SELECT origin, ['call', 'assignment', 'import', 'decorator'][path % 4 + 1] AS kind, count(*) AS n, min(path::VARCHAR) AS first FROM u WHERE path % 3 = 0 GROUP BY 1, 2",
    "asset_reachability": f"WITH {_e(45)}, li AS (SELECT * FROM e WHERE src % 10 <> 3), us AS (SELECT src, dst FROM e WHERE src % 2 = 0 AND dst % 10 = 7), kp AS (SELECT DISTINCT src FROM us WHERE dst IN (SELECT dst FROM li WHERE src % 2 = 1)) SELECT src AS importer, dst AS asset FROM us WHERE src NOT IN (SELECT dst FROM li) AND src NOT IN (SELECT src FROM kp)",
    "plan_refresh": f"""WITH {_P}, a AS (SELECT plan, idx, kind, target, post FROM op WHERE idx % 11 <> 0), b AS (SELECT plan, idx, CASE WHEN idx % 30 = 1 THEN 'copy' ELSE kind END AS kind, target, CASE WHEN idx % 18 = 1 THEN 'x' ELSE post END AS post FROM op WHERE idx % 12 <> 0),
        j AS (SELECT coalesce(a.plan, b.plan) AS plan, coalesce(a.idx, b.idx) AS idx, a.idx IS NULL AS added, b.idx IS NULL AS removed, concat_ws(',', CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.post <> b.post THEN 'post' END) AS f FROM a FULL JOIN b ON a.plan = b.plan AND a.idx = b.idx) SELECT plan, idx, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS change, CASE WHEN added OR removed THEN '' ELSE f END AS fields FROM j WHERE added OR removed OR f <> ''""",
    "plan_review": f"WITH {_P} SELECT plan, count(*) AS operations, count(*) FILTER (mv) AS moves, count(*) FILTER (starts_with(kind, 'rewrite')) AS rewrites, count(*) FILTER (kind IN ('write-file', 'delete-file')) AS writes, coalesce(sum(line_count) FILTER (mv), 0)::BIGINT AS moved_lines, arg_max(source, (line_count, source)) FILTER (mv) AS largest FROM op JOIN m ON m.path = idx GROUP BY 1",
    "review_lines": f"WITH {_P}, r AS (SELECT plan, count(*) AS o, count(*) FILTER (mv) AS k, coalesce(sum(line_count) FILTER (mv), 0)::BIGINT AS l, arg_max(source, (line_count, source)) FILTER (mv) AS g FROM op JOIN m ON m.path = idx GROUP BY 1) SELECT plan, plan || ': ' || o || ' operations, ' || k || ' moves of ' || l || ' lines, largest ' || coalesce(g, 'none') AS line FROM r",
    "move_metrics": f"WITH {_M} SELECT application, count(*) FILTER (path % 3 = 0) AS moved_files, coalesce(sum(line_count) FILTER (path % 3 = 0), 0)::BIGINT AS moved_lines, sum(line_count)::BIGINT AS lines_before, sum(CASE WHEN path % 3 <> 0 THEN line_count ELSE 0 END)::BIGINT AS lines_after FROM m GROUP BY 1",
    "rendered_moves": "WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN replace(text, ' the ', ' THE ') ELSE text END AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id AS source, doc_id + 1000000 AS target, CASE WHEN t = text THEN 'move' ELSE 'move-with-rewrite' END AS kind, sha256(text) AS pre, sha256(t) AS post FROM d",
    "public_subpaths": "WITH p AS (SELECT p_partkey AS source, replace(p_name, ' ', '/') || '-' || p_partkey % 90 AS b FROM part) SELECT source, './' || b AS key, './src/' || b || '.ts' AS target, count(*) OVER (PARTITION BY b) > 1 AS clash FROM p",
    "changed_files": "SELECT p_partkey AS path FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 6 = 0 OR p_partkey % 7 = 0",
    "owned_outputs": "SELECT p_partkey AS path, CASE WHEN p_partkey % 6 = 0 THEN 'excluded' ELSE 'kept' END AS fate FROM part WHERE p_partkey % 4 = 0",
    "generated_records": "SELECT p_partkey AS path, CASE WHEN p_partkey % 6 = 0 THEN 'header' WHEN p_partkey % 4 = 0 THEN 'trigger' ELSE 'preparer' END AS origin FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0",
    "pruned_sections": "WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey, s_acctbal < 2000 AS gone FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey) SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) FILTER (NOT coalesce(gone, false)) AS \"left\" FROM l GROUP BY 1",
    "dirty_paths": f"WITH {_M}, d AS (SELECT DISTINCT CASE WHEN path % 2 = 0 THEN file || '/deep/a' ELSE regexp_extract(file, '^(src/[a-z]+)', 1) END AS p, CASE WHEN path % 2 = 0 THEN path END AS k FROM m WHERE path % 3 = 0) SELECT DISTINCT p AS path FROM d WHERE k % 4 = 0 OR (k IS NULL AND EXISTS (SELECT 1 FROM m WHERE m.path % 4 = 0 AND starts_with(m.file, d.p || '/')))",
    "receipt_faults": "WITH o AS (SELECT o_orderkey AS id, o_custkey AS record, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS said, o_orderkey % 5 AS c FROM orders), j AS (SELECT id, CASE WHEN r.c_custkey IS NULL THEN 'no-record' WHEN 'Customer#' || lpad(said::VARCHAR, 9, '0') <> r.c_name THEN 'digest' WHEN c > 3 THEN 'unlinked' END AS fault FROM o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 20 <> 0) r ON r.c_custkey = record) SELECT * FROM j WHERE fault IS NOT NULL",
    "folder_members": f"WITH {_M}, p AS (SELECT string_split(file || CASE WHEN path % 2 = 0 THEN '.ts' ELSE '/a.ts' END, '/') AS s FROM m), i AS (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p) SELECT DISTINCT array_to_string(s[:i - 1], '/') AS folder, s[i] AS name, CASE WHEN i = len(s) THEN 'file' ELSE 'folder' END AS kind FROM i WHERE s[i] NOT IN ('1', 'a.ts')",
    "canonical_inputs": f"WITH {_M} SELECT CASE path % 3 WHEN 0 THEN '/work/repo/' || file WHEN 1 THEN '/work/repo/deps/x' || path % 9 || '/' || file ELSE '/tmp/' || file END AS path, ['repository', 'installed', 'external'][path % 3 + 1] AS namespace, CASE path % 3 WHEN 0 THEN file WHEN 1 THEN 'x' || path % 9 || '/' || file ELSE '/tmp/' || file END AS name FROM m",
    "derived_reports": "WITH l AS (SELECT DISTINCT l_orderkey AS report, l_partkey AS need, coalesce(p_retailprice < 1050, false) AS ok FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) SELECT report, CASE WHEN bool_and(ok) THEN 'available' ELSE 'unavailable' END AS state, coalesce(string_agg(need::VARCHAR, ',' ORDER BY need) FILTER (NOT ok), '') AS lacking FROM l GROUP BY 1",
    "findings_lines": f"WITH {_OWN}, {_OI}, i AS (SELECT plan, rule, count(*) AS n FROM oz GROUP BY 1, 2) SELECT plan, string_agg('- ' || rule || ': ' || n, chr(10) ORDER BY rule) AS text FROM i GROUP BY 1",
    "campaign_phases": "WITH l AS (SELECT o_custkey AS campaign, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN 'extraction' ELSE 'preparation' END, o_orderkey) AS kind, arg_max(o_orderstatus, o_orderkey) AS s, count(*) FILTER (o_orderstatus = 'F') AS applied FROM orders GROUP BY 1) SELECT campaign, CASE s WHEN 'P' THEN 'stopped' WHEN 'F' THEN kind || '-applied' ELSE kind || '-planned' END AS phase, CASE WHEN s = 'P' THEN 'none' WHEN s <> 'F' THEN 'apply' WHEN kind = 'preparation' THEN 'plan' ELSE 'record' END AS next, applied FROM l",
    "artifact_integrity": "WITH d AS (SELECT doc_id AS path, text FROM documents WHERE text IS NOT NULL) SELECT path, CASE WHEN path % 9 = 0 THEN 'added' WHEN path % 8 = 0 THEN 'removed' ELSE 'changed' END AS change FROM d WHERE NOT (path % 9 = 0 AND path % 8 = 0) AND (path % 9 = 0 OR path % 8 = 0 OR path % 10 = 0)",
    "unauthorized_paths": f"WITH {_M} SELECT file AS path, regexp_extract(file, '^(src/[a-z]+)', 1) AS root FROM m WHERE path % 5 <> 0 AND owner NOT IN ('SMALL', 'PROMO')",
    "inclusion_faults": "SELECT p_partkey AS path, CASE WHEN p_partkey % 21 = 0 THEN 'idle-proof' ELSE 'no-proof' END AS fault FROM part WHERE (p_partkey % 14 = 0 AND p_partkey % 21 <> 0) OR (p_partkey % 21 = 0 AND p_partkey % 14 <> 0)",
    "multi_file_seams": f"WITH {_L}, {_M} SELECT a.domain AS a, b.domain AS b, CASE WHEN l_returnflag = 'A' THEN 'type' ELSE 'value' END AS space, count(*) AS n, (a.domain LIKE '%1') <> (b.domain LIKE '%1') AS crossing FROM l JOIN m a ON a.path = l_partkey JOIN m b ON b.path = nxt WHERE l_quantity >= 40 AND l_partkey <> nxt AND a.domain <> b.domain GROUP BY 1, 2, 3",
    "seam_components": f"WITH RECURSIVE {_e(49).replace(', e AS (', ', e0 AS (')}, {_M}, e AS (SELECT DISTINCT a.owner || '/' || a.domain AS src, b.owner || '/' || b.domain AS dst FROM e0 JOIN m a ON a.path = e0.src JOIN m b ON b.path = e0.dst WHERE a.domain <> b.domain OR a.owner <> b.owner), {_C} SELECT id, comp FROM c",
    "symbol_workspace": 'WITH a AS (SELECT l_partkey AS g, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT g, count(*) AS affinities, max(n) / sum(n) AS top FROM a GROUP BY 1), k AS (SELECT l_partkey AS g, count(DISTINCT l_suppkey) AS consumers FROM lineitem GROUP BY 1) SELECT g AS "group", consumers, affinities, affinities > 1 AND top <= 0.6 AS split FROM t JOIN k USING (g)',
    "evacuation_report": f"""WITH RECURSIVE {_e()}, {_C}, {_M}, sel AS (SELECT c.* FROM c JOIN m ON m.path = c.id WHERE m.application = 'web' AND (starts_with(m.file, 'src/promo/') OR starts_with(m.file, 'src/small/'))), w AS (SELECT c.*, c.id IN (SELECT id FROM sel) AS s, c.comp IN (SELECT comp FROM c WHERE id % 97 = 0) AS held FROM c WHERE comp IN (SELECT comp FROM sel)),
        u AS (SELECT id, CASE WHEN held THEN 'retained' WHEN s THEN 'selected' ELSE 'absorbed' END AS role FROM w UNION ALL SELECT DISTINCT e.dst, 'dependency' FROM e JOIN w ON w.id = e.src AND NOT w.held WHERE e.dst NOT IN (SELECT id FROM w)), mv AS (SELECT id FROM u WHERE role IN ('selected', 'absorbed')), k AS (SELECT CASE WHEN dst % 97 = 0 THEN 'composition' WHEN dst % 5 = 0 THEN 'retained' ELSE 'outside' END AS reason FROM e WHERE src IN (SELECT id FROM mv) AND dst NOT IN (SELECT id FROM mv))
        SELECT 'role:' || role AS what, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'cut:' || reason, count(*) FROM k GROUP BY 1""",
    "consolidation_candidates": f"WITH {_e()}, {_M}, f AS (SELECT owner || '/' || domain AS cand, path, line_count FROM m WHERE zone = 'package'), o AS (SELECT cand, count(*) AS files, sum(line_count)::BIGINT AS lines, sha256(string_agg(path::VARCHAR, chr(10) ORDER BY path)) AS id FROM f GROUP BY 1), s AS (SELECT f.cand, count(DISTINCT e.src) AS consumers FROM e JOIN f ON f.path = e.dst LEFT JOIN f g ON g.path = e.src AND g.cand = f.cand WHERE g.path IS NULL GROUP BY 1) SELECT o.*, coalesce(consumers, 0) AS consumers FROM o LEFT JOIN s USING (cand)",
    "promotion_candidates": f"WITH {_e()}, {_M} SELECT e.dst AS source, count(*) FILTER (a.owner = b.owner) AS inside, count(*) FILTER (a.owner <> b.owner) AS outside, count(DISTINCT a.owner) = 1 AS single FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE b.zone = 'package' GROUP BY 1",
    "test_closure": f"{_TC} SELECT * FROM th",
    "test_package": f"{_TC} SELECT 'tests' AS plan, row_number() OVER (ORDER BY file) - 1 AS idx, 'move' AS kind, file AS path, 'tests/' || file AS target FROM th JOIN m ON m.path = th.id WHERE NOT held",
    "preparation_impact": f"{_ALL}, k AS (SELECT unnest(codes) AS code FROM j), cg AS (SELECT code FROM k WHERE code IN ('composition-root', 'unsupported-module-reference')), nn AS (SELECT count(*) AS n FROM j WHERE len(codes) > 0 AND len(list_filter(codes, lambda x: x NOT IN ('composition-root', 'unsupported-module-reference'))) = 0) SELECT code, count(*) AS n, 'gone' AS change FROM cg GROUP BY 1 UNION ALL SELECT NULL, n, 'come' FROM nn WHERE n > 0",
    "preparation_plan": f"{_PREP} SELECT DISTINCT key, id FROM r WHERE key NOT IN (SELECT key FROM rf)",
    "preparation_refusals": f"{_PREP} SELECT * FROM rf",
    "declaration_selection": "WITH a AS (SELECT DISTINCT p_brand AS file, p_name AS name FROM part), h AS (SELECT p_brand AS file, p_name AS name, count(*) AS n, bool_or(p_retailprice >= 1000) AS x FROM part WHERE p_size < 20 GROUP BY 1, 2) SELECT file, name, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN NOT x THEN 'not-exported' ELSE 'eligible' END AS verdict FROM a LEFT JOIN h USING (file, name)",
    "replayed_slices": "SELECT doc_id, substr(text, 1, 10) || chr(10) || substr(text, 21, 11) || chr(10) || substr(text, 41, 15) AS text FROM documents WHERE length(text) >= 60",
    "boundary_proofs": f"WITH {_e(45)}, {_M} SELECT e.src, b.owner AS b, CASE WHEN bool_and(type_only) THEN 'resolve' WHEN bool_and(b.zone = 'package') THEN 'existing-package' ELSE 'port' END AS boundary FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.owner <> b.owner GROUP BY 1, 2",
    "value_splits": f"""WITH RECURSIVE {_e(1)}, d AS (SELECT p_brand AS file, p_partkey AS id, 'd' || p_partkey AS name, p_retailprice >= 1000 AND p_size % 5 <> 0 AS ok FROM part), i AS (SELECT e.src, e.dst FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE a.file = b.file),
        r AS (SELECT id AS key, id FROM d WHERE ok AND id % 11 <> 0 UNION SELECT r.key, i.dst FROM r JOIN i ON i.src = r.id),
        x AS (SELECT r.key, d.name FROM r JOIN i ON i.dst = r.id JOIN d ON d.id = i.dst WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.key = r.key AND q.id = i.src)), o AS (SELECT key, string_agg(DISTINCT name, ',' ORDER BY name) AS offenders FROM x GROUP BY 1), n AS (SELECT key, count(*) AS members FROM r GROUP BY 1)
        SELECT d.id AS key, CASE WHEN d.id % 11 = 0 THEN 'unknown' WHEN NOT ok THEN 'not-exported-value' WHEN offenders IS NOT NULL THEN 'retained' ELSE 'splits' END AS verdict, coalesce(members, 0) AS members, coalesce(offenders, '') AS offenders FROM d LEFT JOIN n ON n.key = d.id LEFT JOIN o ON o.key = d.id""",
    "preparation_audit": f"WITH {_M}, j AS (SELECT path, path % 4 = 0 AS d, (path % 4 = 0 AND path % 20 <> 0) OR path % 50 = 1 AS l, path % 24 = 0 AND owner <> 'PROMO' AS o, path % 28 = 0 AS b FROM m) SELECT path, CASE WHEN NOT d THEN 'scope' WHEN NOT l THEN 'lost' WHEN o THEN 'owner' ELSE 'bytes' END AS fault FROM j WHERE (d OR l) AND (NOT d OR NOT l OR o OR b)",
    "ledger_source": "WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations)) SELECT conv_id AS campaign, count(*) AS entries, count(*) FILTER (turn % 5 = 0 OR turn <> b + 1) AS faults FROM c GROUP BY 1",
    "manifest_source": f"WITH {_P} SELECT plan, kind, count(*) AS n, count(target) AS targets FROM op GROUP BY 1, 2",
    "baseline_tree": "WITH l AS (SELECT o_custkey AS path, arg_max(o_orderkey::VARCHAR, (o_orderdate, o_orderkey)) AS content, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1) SELECT path, content FROM l WHERE s <> 'P'",
    "config_digests": """SELECT n_nationkey, sha256('{"app":"' || n_regionkey || '","name":"' || n_name || '"}') AS digest FROM nation""",
    "build_identity": "WITH b AS (SELECT lang, doc_id // 1000 AS k, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS h FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) SELECT lang, sum(n)::BIGINT AS files, sha256(string_agg(h, chr(10) ORDER BY k)) AS digest FROM b GROUP BY 1",
    "scanned_nodes": f"WITH {_M}, s AS (SELECT *, 'apps/' || application || '/' || file || '.ts' AS source FROM m WHERE path % 10 <> 3) SELECT application, 'application' AS zone, count(*) AS nodes, sum(length(source))::BIGINT AS lines FROM s GROUP BY 1",
    "scanned_edges": f"WITH {_e()}, {_M} SELECT 'apps/' || a.application || '/' || a.file || '.ts' AS src, 'apps/' || b.application || '/' || b.file || '.ts' AS dst, CASE WHEN e.dynamic THEN 'dynamic' WHEN e.dst % 10 = 5 THEN 'type-only' ELSE 'static' END AS kind FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE e.src % 10 <> 3 AND e.dst % 10 <> 3 AND e.dst % 17 <> 0",
    "scanned_leftovers": f"WITH {_e()}, {_M} SELECT 'unresolved' AS relation, 0::BIGINT AS n UNION ALL SELECT 'external_by_source', count(*) FROM e WHERE src % 10 <> 3 AND dst % 17 = 0 UNION ALL SELECT 'test_importers', count(*) FROM e WHERE src % 10 = 3 AND dst % 10 <> 3 AND dst % 17 <> 0 UNION ALL SELECT 'test_kinds', count(*) FROM m WHERE path % 10 = 3",
    "scanned_tree": "WITH d AS (SELECT p_type, string_agg(DISTINCT p_name, chr(10) ORDER BY p_name) AS v FROM part GROUP BY 1) SELECT p_type, octet_length(encode(v)) + 1 AS size, true AS same FROM d",
    "workspace_folders": "WITH p AS (SELECT DISTINCT lower(p_type) AS t, replace(p_name, ' ', '-') AS n FROM part) SELECT 'libs/' || t || '/' || n AS path FROM p WHERE (starts_with(n, 'small-') OR t = 'promo') AND NOT suffix(n, '-ring') AND t <> 'large'",
    "workspace_packages": "SELECT coalesce('p' || n_nationkey, 'p' || s_suppkey) AS name, coalesce('own/' || n_name, 'libs/' || s_suppkey) AS owner FROM supplier FULL JOIN nation ON s_suppkey = n_nationkey",
    "provenance_headers": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'specs/' || p_partkey || '.json' WHEN 1 THEN 'tool-' || p_partkey % 9 END AS origin FROM part",
    "style_changes": "SELECT '.c' || p_partkey AS selector, CASE WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 9 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'reordered' ELSE 'changed' END AS change FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 9 = 0) AND (p_partkey % 7 = 0 OR p_partkey % 9 = 0 OR p_partkey % 5 = 0 OR p_partkey % 11 = 0)",
    "type_only_refusals": f"WITH {_M} SELECT path AS id, concat_ws(',', CASE WHEN path % 3 = 0 THEN 'value-reference' END, CASE WHEN path % 5 = 0 THEN 'not-exported' END, CASE WHEN has_exports THEN 'has-surface' END, CASE WHEN line_count > 40 THEN 'too-large' END) AS refusals FROM m",
    "proof_report": f"SELECT proof, coalesce(n, 0) AS failures, n IS NULL AS passed FROM (VALUES ('boundaries'), ('bytes'), ('consumers'), ('postconditions')) v(proof) LEFT JOIN (SELECT 'bytes' AS proof, count(*) AS n FROM ({_ENGINE['byte_fidelity']}) UNION ALL SELECT 'boundaries', count(*) FROM ({_ENGINE['boundary_breaks']}) UNION ALL SELECT 'postconditions', count(*) FROM ({_ENGINE['postconditions']})) f USING (proof)",
    "report_bytes": """WITH j AS (SELECT '[' || string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']' || chr(10) AS t FROM nation), w AS (SELECT max(length(n_name)) AS w FROM nation), x AS (SELECT rpad('n_nationkey', 11, ' ') || '  n_name' || chr(10) || string_agg(rpad(n_nationkey::VARCHAR, 11, ' ') || '  ' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS t FROM nation) SELECT 'json' AS kind, sha256(t) AS sha256, octet_length(encode(t)) AS bytes FROM j UNION ALL SELECT 'table', sha256(t), octet_length(encode(t)) FROM x UNION ALL SELECT 'lost', '', 0""",
    "lockfile_dependencies": f"WITH {_LK} SELECT lock, root, section, name, '^' || q || '.0.0' AS specifier, CASE WHEN n = 1 THEN 'link:../p' || q || ':' ELSE q || '.0.' || n END AS version FROM ld",
    "lockfile_importers": f"WITH {_LK}, k AS (SELECT lock, root, count(*) AS n, count(DISTINCT section) AS s FROM ld GROUP BY 1, 2) SELECT o_custkey AS lock, 'packages/p' || o_orderkey AS root, 2 + coalesce(3 * n + s, 0) AS lines FROM orders LEFT JOIN k ON lock = o_custkey AND root = 'packages/p' || o_orderkey",
    "projected_importers": f"WITH {_LK} SELECT lock, root, section, name, CASE WHEN d % 17 <> 0 AND d % 7 = 0 THEN 'missing' WHEN d % 17 = 0 AND d % 7 <> 0 THEN 'undeclared' WHEN d % 17 <> 0 AND d % 7 <> 0 AND d % 11 = 0 THEN 'differs' END AS fault FROM ld WHERE r % 13 <> 0 AND (d % 17 <> 0 AND (d % 7 = 0 OR d % 11 = 0) OR d % 17 = 0 AND d % 7 <> 0) UNION ALL SELECT o_custkey, 'packages/p' || o_orderkey, NULL, NULL, 'no-importer' FROM orders WHERE o_orderkey % 13 = 0",
    "streamed_ledger": """WITH c AS (SELECT conv_id, turn + 1 AS seq, length(text) AS n FROM conversations), b AS (SELECT *, CASE WHEN seq % 2 = 1 AND seq > 1 AND n % 7 = 0 THEN 'stale baseline' WHEN seq % 2 = 0 AND n % 11 = 0 THEN 'audit of another kind' WHEN seq % 2 = 0 AND n % 5 = 0 THEN 'audit failed' END AS bad FROM c),
        f AS (SELECT *, coalesce(min(seq) FILTER (bad IS NOT NULL) OVER (PARTITION BY conv_id), 99) AS stop, max(seq) OVER () AS top FROM b)
        SELECT conv_id::VARCHAR AS campaign, seq, 'c' || ((seq + 1) // 2) AS id, seq < stop AS accepted, CASE WHEN seq = stop THEN bad WHEN seq > stop THEN 'gap' END AS reason FROM f
        UNION ALL SELECT conv_id::VARCHAR, max(seq), NULL, NULL, 'expired' FROM f WHERE seq < stop GROUP BY conv_id, top HAVING max(seq) + 3.5 < top""",
    "config_doctor": f"""WITH df(setting, dv) AS (VALUES {", ".join("('" + f.name + "', '" + str(getattr(Config(), f.name)).replace("'", "''") + "')" for f in fields(Config))}), gv AS (SELECT c_custkey AS owner, 'scope' AS setting, '@' || lower(c_mktsegment) AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'min_files', (c_custkey % 4)::VARCHAR FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'min_size', c_custkey::VARCHAR FROM customer WHERE c_custkey % 11 = 0)
        SELECT c_custkey AS owner, df.setting, coalesce(value, dv) AS value, coalesce(value <> dv, false) AS given FROM customer CROSS JOIN df LEFT JOIN gv ON gv.owner = c_custkey AND gv.setting = df.setting UNION ALL SELECT owner, setting, 'unknown', true FROM gv WHERE setting = 'min_size'""",
}
