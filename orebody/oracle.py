"""DuckDB SQL for the queries of queries.py, over views of the driver's tables."""

from __future__ import annotations

_L = "l AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, l_linestatus, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) nxt FROM lineitem)"


def _e(least: int = 49) -> str:
    return f"{_L}, e AS (SELECT l_partkey src, nxt dst, bool_and(l_returnflag = 'A') type_only, bool_or(l_linestatus = 'O') dynamic FROM l WHERE l_quantity >= {least} AND nxt IS NOT NULL AND l_partkey <> nxt GROUP BY 1, 2)"


_M = "m AS (SELECT p_partkey path, 'src/' || lower(p_type) || '/' || p_partkey AS file, CASE WHEN p_partkey % 5 = 0 THEN 'package' ELSE 'application' END AS zone, CASE WHEN p_partkey % 2 = 0 THEN 'web' ELSE 'api' END AS application, p_type AS owner, p_brand AS domain, p_size::BIGINT AS line_count, p_retailprice >= 1000 AS has_exports FROM part)"
_C = "n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), c AS (SELECT n.id, least(n.id, coalesce(min(x.dst), n.id)) AS comp FROM n LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) x ON x.src = n.id GROUP BY n.id), ce AS (SELECT DISTINCT x.comp src, y.comp dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst WHERE x.comp <> y.comp)"
_LY = "d AS (SELECT DISTINCT comp, 0 AS depth FROM c UNION SELECT ce.src, d.depth + 1 FROM d JOIN ce ON ce.dst = d.comp), ly AS (SELECT comp, max(depth)::INT AS layer FROM d GROUP BY comp)"
_G = f"WITH RECURSIVE {_e()}, {_C}"
_GM = f"{_G}, {_M}, gm AS (SELECT m.* FROM m WHERE path IN (SELECT id FROM n))"
_CLOSED = "dm AS (SELECT DISTINCT c.comp, gm.domain FROM gm JOIN c ON c.id = gm.path), one AS (SELECT comp, min(domain) AS domain FROM dm GROUP BY comp HAVING count(*) = 1), rc AS (SELECT DISTINCT x.comp src, y.comp dst FROM r JOIN c x ON x.id = r.src JOIN c y ON y.id = r.dst WHERE x.comp <> y.comp), broken AS (SELECT DISTINCT rc.src AS comp FROM rc JOIN one ON one.comp = rc.src JOIN dm ON dm.comp = rc.dst WHERE dm.domain <> one.domain), cf AS (SELECT c.id AS path FROM c WHERE c.comp IN (SELECT comp FROM one) AND c.comp NOT IN (SELECT comp FROM broken))"
_CAND = "gi AS (SELECT dst AS path, count(*) AS fan_in FROM e GROUP BY 1), go AS (SELECT src AS path, count(*) AS fan_out FROM e GROUP BY 1), gd AS (SELECT gm.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM gm LEFT JOIN gi USING (path) LEFT JOIN go USING (path)), f AS (SELECT DISTINCT cand, id AS path FROM (SELECT comp AS cand, id FROM c UNION ALL SELECT x.comp, y.id FROM r JOIN c x ON x.id = r.src JOIN c z ON z.id = r.dst JOIN c y ON y.comp = z.comp)), con AS (SELECT f.cand, count(DISTINCT e.src) AS consumers FROM f JOIN e ON e.dst = f.path WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.cand = f.cand AND g.path = e.src) GROUP BY 1), dy AS (SELECT f.cand, count(*) AS unsupported FROM f JOIN e ON e.src = f.path WHERE e.dynamic GROUP BY 1), fa AS (SELECT f.cand, count(*) AS files, sum(line_count)::BIGINT AS line_count, count(DISTINCT owner) AS owners, count(DISTINCT domain) AS domains, count(*) FILTER (has_exports) AS exporting, count(*) FILTER (f.path % 97 = 0) AS composition, count(*) FILTER (f.path % 89 = 0) AS protected, min(domain) AS first_domain, count(*) FILTER (f.path % 71 = 0) AS escapes, count(*) FILTER (f.path % 83 = 0) AS unresolved, count(*) FILTER (f.path % 59 = 0) AS stale_generated, count(*) FILTER (f.path % 3 = 0) AS declarations, count(*) FILTER (f.path % 67 = 0) AS uninstalled, count(*) FILTER (f.path % 73 = 0) AS unmovable, count(*) FILTER (f.path % 10 = 3) AS tests, count(*) FILTER (f.path % 10 = 7) AS assets, count(*) FILTER (f.path % 43 = 0) AS rewrites, count(*) FILTER (f.path % 79 = 0) AS retained, count(*) FILTER (f.path % 61 = 0) AS warnings, count(*) FILTER (f.path % 41 = 0) AS adjacent, count(*) FILTER (f.path % 37 = 0) AS effectful, count(*) FILTER (f.path % 53 = 0 AND fan_in > 0) AS shims, coalesce(sum(line_count) FILTER (f.path % 53 = 0 AND fan_in > 0), 0)::BIGINT AS shim_lines, count(*) FILTER (fan_in >= 3) AS high_inbound, count(*) FILTER (fan_out >= 3) AS high_fan_out, count(*) - count(DISTINCT f.path % 500) AS collisions FROM f JOIN gd AS gm ON gm.path = f.path GROUP BY 1), acr AS (SELECT e.src, e.dst, a.comp AS sc, b.comp AS dc FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst WHERE a.comp <> b.comp), inb AS (SELECT dc AS cand, count(DISTINCT src) AS inbound FROM acr GROUP BY 1), pk AS (SELECT sc AS cand, count(DISTINCT gm.owner) AS dependencies FROM acr JOIN gm ON gm.path = dst WHERE gm.zone = 'package' GROUP BY 1), te AS (SELECT comp AS cand, count(*) FILTER (id % 10 = 3) AS seed_tests FROM c GROUP BY 1), facts AS (SELECT fa.*, coalesce(consumers, 0) AS consumers, coalesce(unsupported, 0) AS unsupported, coalesce(inbound, 0) AS inbound, coalesce(dependencies, 0) AS dependencies, coalesce(seed_tests, 0) AS seed_tests FROM fa LEFT JOIN con USING (cand) LEFT JOIN dy USING (cand) LEFT JOIN inb USING (cand) LEFT JOIN pk USING (cand) LEFT JOIN te USING (cand))"
_JUDGED = "codes AS (SELECT *, list_filter([CASE WHEN owners <> 1 THEN 'multiple-owners' END, CASE WHEN unresolved > 0 THEN 'unresolved-imports' END, CASE WHEN stale_generated > 0 THEN 'generated-source-missing' END, CASE WHEN composition > 0 THEN 'composition-root' END, CASE WHEN unsupported > 0 THEN 'unsupported-module-reference' END, CASE WHEN declarations = files THEN 'declaration-only' END, CASE WHEN inbound = 0 AND tests = 0 AND exporting = 0 THEN 'no-exports' END, CASE WHEN uninstalled > 0 THEN 'uninstalled-package' END, CASE WHEN unmovable > 0 THEN 'unmovable-asset' END, CASE WHEN escapes > 0 THEN 'closure-escapes-app-code' END, CASE WHEN protected > 0 THEN 'protected-path' END, CASE WHEN files < 2 THEN 'too-small' END, CASE WHEN files > 20 THEN 'too-large' END, CASE WHEN collisions > 0 THEN 'unplannable' END], lambda x: x IS NOT NULL) AS codes, list_filter([CASE WHEN regexp_replace(lower(first_domain), '[^a-z0-9]+', '-', 'g') IN ('brand-7', 'brand-11') THEN 'generic-target' END, CASE WHEN adjacent > 0 THEN 'composition-adjacent' END, CASE WHEN shims > 0 THEN 'compatibility-shim' END, CASE WHEN domains > 1 THEN 'cross-domain' END, CASE WHEN high_inbound > 0 THEN 'high-inbound' END, CASE WHEN high_fan_out > 0 THEN 'high-fan-out' END, CASE WHEN files > 12 OR line_count > 400 THEN 'large-review' END, CASE WHEN effectful > 0 THEN 'evaluation-effects' END], lambda x: x IS NOT NULL) AS advice FROM facts), js AS (SELECT *, CASE WHEN list_has_any(advice, ['generic-target', 'composition-adjacent', 'compatibility-shim', 'large-review']) THEN 'discouraged' WHEN len(advice) > 0 THEN 'review-required' ELSE 'recommended' END AS status FROM codes), j AS (SELECT *, cand AS id, len(codes) = 0 AS eligible, CASE WHEN domains <= 1 THEN 'high' WHEN domains = 2 THEN 'medium' ELSE 'low' END AS cohesion, CASE WHEN len(codes) > 0 OR status = 'discouraged' THEN 'high' WHEN warnings > 0 OR status = 'review-required' THEN 'medium' ELSE 'low' END AS risk, (1 * (line_count - shim_lines))::DOUBLE + (5 * files)::DOUBLE + (10 * (inbound + seed_tests))::DOUBLE + 50::DOUBLE * (CASE WHEN tests = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, tests::DOUBLE / files) END) + (-12 * dependencies)::DOUBLE + (-1000 * len(codes))::DOUBLE + (-100 * rewrites)::DOUBLE + (CASE WHEN domains > 1 THEN -800 ELSE 0 END)::DOUBLE + (-250 * retained)::DOUBLE AS score, CASE WHEN retained > 0 THEN 'preparation' ELSE 'extraction' END AS classification, CASE WHEN cand % 2 = 0 THEN 'web' ELSE 'api' END AS application, greatest(1, files + tests + assets + 3 * (inbound + seed_tests) + 2 * rewrites + dependencies + 2 * warnings + 5 * len(codes) + 2 * len(advice)) AS review_units FROM js)"
_ALL = f"{_GM}, {_CAND}, {_JUDGED}"
#: Groups by a fold over the candidates in order: own[k] is the seed that has taken candidate k (0: free).
_EQ = """ca AS (SELECT j.id, score, concat_ws('|', application, eligible, classification, status) AS kind, row_number() OVER (ORDER BY j.id) AS k FROM j), fs AS (SELECT ca.k, ca.kind, path FROM f JOIN ca ON ca.id = f.cand), sz AS (SELECT k, count(*) AS n FROM fs GROUP BY 1), pa AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM fs a JOIN fs b ON a.path = b.path AND a.kind = b.kind AND a.k < b.k GROUP BY 1, 2), si AS (SELECT a, b, c / (x.n + y.n - c) AS s FROM pa JOIN sz x ON x.k = a JOIN sz y ON y.k = b WHERE c / (x.n + y.n - c) >= 0.8),
        nb AS (SELECT k, coalesce(list(b), []) AS l FROM ca LEFT JOIN si ON si.a = ca.k GROUP BY 1), tot AS (SELECT count(*) AS n FROM ca), sta AS (SELECT 0 AS k, list_transform(range(1, n + 1), lambda x: 0) AS own FROM tot UNION ALL SELECT nb.k, CASE WHEN own[nb.k] <> 0 THEN own ELSE list_transform(own, lambda o, i: CASE WHEN o = 0 AND (i = nb.k OR list_contains(nb.l, i)) THEN nb.k ELSE o END) END FROM sta JOIN nb ON nb.k = sta.k + 1),
        fin AS (SELECT unnest(own) AS seed, unnest(range(1, len(own) + 1)) AS k FROM sta WHERE sta.k = (SELECT n FROM tot)), g AS (SELECT x.id, y.id AS seed, x.score, fin.k, fin.seed AS sk FROM fin JOIN ca x ON x.k = fin.k JOIN ca y ON y.k = fin.seed), eq AS (SELECT id, seed, first_value(id) OVER (PARTITION BY seed ORDER BY score DESC, id) AS representative, coalesce((SELECT s FROM si WHERE si.a = g.sk AND si.b = g.k), 1.0)::DOUBLE AS similarity FROM g)"""
_HOT = """rp AS (SELECT * FROM j WHERE id IN (SELECT representative FROM eq)), hp AS (SELECT f.path, count(*) AS closures, max(rp.line_count) AS largest_lines, count(*) FILTER (rp.domains > 1) AS cross_domain, count(*) FILTER (rp.status = 'discouraged') AS discouraged, string_agg(rp.id, ',' ORDER BY rp.id) AS candidates FROM f JOIN rp ON rp.id = f.cand GROUP BY 1),
        hq AS (SELECT hp.*, gm.application, gm.line_count, (SELECT count(*) FROM e WHERE dst = hp.path) AS inbound, (SELECT count(*) FROM e WHERE src = hp.path) AS fan_out FROM hp JOIN gm ON gm.path = hp.path AND gm.zone = 'application'),
        hot AS (SELECT *, largest_lines + 100 * inbound + 50 * fan_out + 250 * cross_domain + 100 * discouraged AS pressure, CASE WHEN inbound >= 8 THEN 'split-capabilities' WHEN fan_out >= 8 THEN 'extract-registry' WHEN cross_domain > 0 THEN 'declare-boundary' ELSE 'review-closure' END AS action FROM hq)"""
_FM = """fl AS (SELECT l_orderkey AS path, count(*) AS functions, max(l_quantity::BIGINT) AS max_cognitive, avg(l_quantity::BIGINT) AS avg_cognitive, max(l_suppkey % 6) AS max_nest, max(floor(l_extendedprice / 1000)::BIGINT) AS max_loc, avg(l_linenumber) AS avg_cyclo, count(DISTINCT l_suppkey) AS fan_out, count(DISTINCT l_returnflag) AS responsibilities, count(*) FILTER (l_quantity > 20) AS ctor_params, count(DISTINCT l_partkey) + count(DISTINCT l_quantity) AS vocabulary, sum(l_linenumber)::BIGINT + 1 AS cyclomatic, sum(floor(l_extendedprice / 1000))::BIGINT AS lines FROM lineitem GROUP BY 1),
    fc AS (SELECT o_orderkey AS path, CASE o_orderpriority WHEN '1-URGENT' THEN 'react-component' WHEN '2-HIGH' THEN 'react-hook' ELSE 'module' END AS archetype, coalesce(functions, 0) AS functions, coalesce(max_cognitive, 0) AS max_cognitive, coalesce(avg_cognitive, 0) AS avg_cognitive, coalesce(max_nest, 0) AS max_nest, coalesce(max_loc, 0) AS max_loc, coalesce(avg_cyclo, 0) AS avg_cyclo, coalesce(fan_out, 0) AS fan_out, coalesce(responsibilities, 0) AS responsibilities, coalesce(ctor_params, 0) AS ctor_params, coalesce(vocabulary, 0) AS vocabulary, coalesce(cyclomatic, 0) AS cyclomatic, coalesce(lines, 0) AS lines FROM orders LEFT JOIN fl ON fl.path = o_orderkey),
    fx AS (SELECT *, CASE WHEN cyclomatic <= 0 OR ln(cyclomatic::DOUBLE) < 1 THEN 1::DOUBLE ELSE lines / ln(cyclomatic::DOUBLE) END AS factor FROM fc),
    fm AS (SELECT *, round(2::DOUBLE * max_cognitive + 4::DOUBLE * avg_cognitive + 4::DOUBLE * max_nest + 2.5::DOUBLE * fan_out + 9::DOUBLE * greatest(0, responsibilities - 1) + 0.1::DOUBLE * max_loc, 6) AS structural, CASE WHEN factor <= 0 THEN 0::DOUBLE ELSE round(greatest(0::DOUBLE, 100 - (171 - 5.2::DOUBLE * ln(greatest(vocabulary, 1)::DOUBLE) - 0.23::DOUBLE * cyclomatic - 16.2::DOUBLE * ln(factor)) * 100 / 171), 6) END AS volume FROM fx)"""
_OPS = "op AS (SELECT o_custkey AS plan_id, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'consumer-manifest' ELSE 'consumer-source' END WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 49 THEN 'delete-tree' ELSE 'write' END AS kind, m.path AS part, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 49 THEN m.file ELSE m.file || '/' || l_suppkey END AS path, CASE WHEN l_returnflag = 'A' THEN l_linenumber % 3 END AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN m ON m.path = l_partkey)"
_SETS = "cl AS (SELECT *, min(id) OVER (PARTITION BY s) AS same FROM (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1))"
_TREE = """steps(k, step, folder, more, gone) AS (VALUES (1, 0, NULL, '!', false), (1, 1, 'moved/', '', false), (2, 0, NULL, '!', false), (3, 0, NULL, '', true), (4, 0, 'moved/', '', false), (4, 1, NULL, '?', false), (4, 2, 'final/', '', false), (5, 0, 'moved/', '~', false), (6, 0, NULL, '', false), (6, 1, 'moved/', '', false)),
    tr AS (SELECT c_custkey, 'c/' || c_custkey AS path, c_name AS content, c_custkey % 10 AS k FROM customer),
    st AS (SELECT c_custkey, k, 0 AS step, path, content, false AS gone FROM tr UNION ALL SELECT st.c_custkey, st.k, st.step + 1, CASE WHEN steps.folder IS NULL THEN st.path ELSE steps.folder || st.c_custkey END, st.content || steps.more, steps.gone FROM st JOIN steps ON steps.k = st.k AND steps.step = st.step),
    landed AS (SELECT path, content FROM st QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY step DESC) = 1 AND NOT gone UNION ALL SELECT path, 'stub ' || content FROM tr WHERE k = 5),
    want AS (SELECT v.path, sha256(l.content) AS want FROM (SELECT DISTINCT path FROM st WHERE k BETWEEN 1 AND 6) v LEFT JOIN landed l ON l.path = v.path)"""

ORACLE: dict[str, str] = {
    "scc_layers": f"{_G}, {_LY} SELECT c.id, c.comp, ly.layer FROM c JOIN ly USING (comp)",
    "scc_stress": f"WITH RECURSIVE {_e(48)}, {_C} SELECT comp, count(*) AS size FROM c GROUP BY 1",
    "graph_edges": f"WITH {_e()} SELECT *, CASE WHEN dynamic THEN 'dynamic' WHEN type_only THEN 'type-only' ELSE 'static' END AS kind FROM e",
    "module_nodes": f"WITH {_M} SELECT * FROM m",
    "condensation_edges": f"{_G} SELECT src, dst FROM ce",
    "communities": f"""WITH RECURSIVE {_e(48)}, {_M}, en AS (SELECT e.src, e.dst, a.application AS app FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.application = b.application), hub AS (SELECT app, dst FROM en GROUP BY 1, 2 HAVING count(*) >= 12),
        pr AS (SELECT DISTINCT app, least(src, dst) AS a, greatest(src, dst) AS b FROM en WHERE (app, src) NOT IN (SELECT (app, dst) FROM hub) AND (app, dst) NOT IN (SELECT (app, dst) FROM hub)), sz AS (SELECT app, count(*) AS m FROM pr GROUP BY 1),
        bo AS (SELECT app, a AS v, b AS w FROM pr UNION ALL SELECT app, b, a FROM pr), no AS (SELECT app, v, row_number() OVER (PARTITION BY app ORDER BY v) AS k FROM (SELECT DISTINCT app, v FROM bo)),
        nb AS (SELECT x.app, x.k, list(y.k ORDER BY y.k) AS l FROM bo JOIN no x ON x.app = bo.app AND x.v = bo.v JOIN no y ON y.app = bo.app AND y.v = bo.w GROUP BY 1, 2), al AS (SELECT app, list(l ORDER BY k) AS near, count(*) AS n, list(len(l) ORDER BY k) AS deg FROM nb GROUP BY 1),
        st AS (SELECT al.app, 0::BIGINT AS i, range(1, n + 1) AS label, deg AS total, false AS moved, false AS stop FROM al UNION ALL
            SELECT app, i + 1, list_transform(label, lambda x, j: CASE WHEN j = v THEN pick ELSE x END), list_transform(total, lambda x, j: x - (CASE WHEN j = own THEN d ELSE 0 END) + (CASE WHEN j = pick THEN d ELSE 0 END)), CASE WHEN v = 1 THEN pick <> own ELSE moved OR pick <> own END, v = n AND NOT (moved OR pick <> own)
            FROM (SELECT *, CASE WHEN len(gains) > 0 AND list_max(gains) > 0 THEN cand[list_position(gains, list_max(gains))] ELSE own END AS pick FROM
                (SELECT *, list_transform(cand, lambda c: len(list_filter(near[v], lambda w: label[w] = c))::DOUBLE / m - ((total[c] - (CASE WHEN c = own THEN d ELSE 0 END)) * d)::DOUBLE / (2 * m * m)) AS gains FROM
                    (SELECT *, list_sort(list_distinct(list_transform(near[v], lambda w: label[w]))) AS cand FROM
                        (SELECT st.*, al.near, al.n, sz.m, st.i % al.n + 1 AS v, st.label[st.i % al.n + 1] AS own, al.deg[st.i % al.n + 1] AS d FROM st JOIN al USING (app) JOIN sz USING (app) WHERE NOT st.stop AND st.i < 100 * al.n))))),
        fin AS (SELECT app, unnest(label) AS c, unnest(range(1, len(label) + 1)) AS k FROM st QUALIFY i = max(i) OVER (PARTITION BY app))
        SELECT fin.app, no.v AS id, min(no.v) OVER (PARTITION BY fin.app, fin.c) AS community FROM fin JOIN no ON no.app = fin.app AND no.k = fin.k""",
    "component_kinds": f"""{_G}, fw AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 7 AND s_nationkey IN (3, 4)), k AS (SELECT comp, bool_and(id % 7 = 0) AS contract, bool_or(id % 7 = 2) AS policy, bool_or(id % 7 = 1) AS barrel, bool_or(id % 97 = 0) AS composes, bool_or(id IN (SELECT id FROM fw)) AS coupled, bool_or(id % 59 = 0) AS gone FROM c GROUP BY 1),
        q AS (SELECT *, CASE WHEN contract THEN 'contract' WHEN composes THEN 'composition' WHEN coupled THEN 'runtime-adapter-or-ui' WHEN policy THEN 'policy-candidate' ELSE 'module-candidate' END AS archetype FROM k)
        SELECT comp, archetype, concat_ws(',', CASE WHEN composes THEN 'composition-or-route' END, CASE WHEN barrel THEN 'barrel' END, CASE WHEN coupled THEN 'framework-coupled' END, CASE WHEN archetype = 'composition' THEN 'composition-root' END, CASE WHEN gone THEN 'generated-source-missing' END) AS flags FROM q""",
    "component_ids": f"WITH RECURSIVE {_e(48)}, {_C} SELECT comp, count(*) AS size, sha256(string_agg(printf('%09d', id), chr(10) ORDER BY id)) AS stable_id FROM c GROUP BY 1",
    "closure_sizes": f"{_G} SELECT src, count(*) AS reached FROM r WHERE src <> dst GROUP BY 1",
    "component_report": f"""{_GM}, x AS (SELECT a.comp a, b.comp b, e.* FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst)
        SELECT c.comp, count(*) AS files, sum(line_count)::BIGINT AS lines, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, string_agg(DISTINCT owner, ',' ORDER BY owner) AS owners, count(*) FILTER (has_exports) AS exporting, count(*) > 1 AS cyclic,
        (SELECT count(*) FROM x WHERE x.a = c.comp AND x.a <> x.b) AS edges_out, (SELECT count(*) FROM x WHERE x.a = c.comp AND x.a <> x.b AND type_only) AS type_only_out, (SELECT count(*) FROM x WHERE x.b = c.comp AND x.a <> x.b) AS edges_in
        FROM gm JOIN c ON c.id = gm.path GROUP BY c.comp""",
    "graph_summary": f"{_GM} SELECT z.zone, count(gm.path) AS nodes, (SELECT count(*) FROM e) AS edges FROM (VALUES ('application'), ('package'), ('repo'), ('external')) z(zone) LEFT JOIN gm ON gm.zone = z.zone GROUP BY 1",
    "closed_files": f"{_GM}, {_CLOSED} SELECT path FROM cf",
    "domain_report": f"""{_GM}, {_CLOSED}, x AS (SELECT a.domain a, b.domain b FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.domain <> b.domain),
        base AS (SELECT domain, count(*) AS files, sum(line_count)::BIGINT AS lines, count(*) FILTER (path IN (SELECT path FROM cf)) AS closed_files, coalesce(sum(line_count) FILTER (path IN (SELECT path FROM cf)), 0)::BIGINT AS closed_lines FROM gm GROUP BY 1)
        SELECT *, CASE WHEN lines > 0 THEN floor(closed_lines * 1000 / lines + 0.5) / 10 ELSE 0.0 END AS closed_percent, (SELECT count(DISTINCT b) FROM x WHERE a = domain) AS needs, (SELECT count(DISTINCT a) FROM x WHERE b = domain) AS needed_by, (SELECT count(*) FROM x WHERE a = domain) AS cross_edges, files - closed_files AS blocked_files FROM base""",
    "domain_components": f"WITH RECURSIVE {_L}, {_M}, e0 AS (SELECT DISTINCT l_partkey src, nxt dst FROM l WHERE l_quantity >= 49 AND nxt IS NOT NULL), e AS (SELECT DISTINCT a.domain src, b.domain dst FROM e0 JOIN m a ON a.path = e0.src JOIN m b ON b.path = e0.dst WHERE a.domain <> b.domain), {_C}, {_LY} SELECT c.id, c.comp, ly.layer FROM c JOIN ly USING (comp)",
    "key_layers": "SELECT DISTINCT * FROM (SELECT 'line/' || l_orderkey AS comp, 4 AS layer FROM lineitem UNION ALL SELECT 'part/' || l_partkey, 0 FROM lineitem UNION ALL SELECT 'order/' || o_orderkey, 3 FROM orders UNION ALL SELECT 'customer/' || c_custkey, 2 FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 2 FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 1 FROM nation UNION ALL SELECT 'region/' || n_regionkey, 0 FROM nation)",
    "scc_all_edges": f"WITH RECURSIVE {_e(1)}, {_C}, {_LY} SELECT c.id, c.comp, ly.layer FROM c JOIN ly USING (comp)",
    "ownership": f"WITH {_M} SELECT owner, count(*) AS files, sum(line_count)::BIGINT AS lines FROM m GROUP BY 1",
    "external_packages": "SELECT l_suppkey AS package, count(*) AS uses FROM lineitem GROUP BY 1",
    "adjacency": f"WITH {_e()} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS targets FROM e GROUP BY 1",
    "fan_in_out": f"WITH {_e()}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS fan_in, (SELECT count(*) FROM e WHERE src = id) AS fan_out FROM n",
    "hub_nodes": f"WITH {_e(30)} SELECT dst AS id, count(*) AS fan_in FROM e GROUP BY 1 HAVING count(*) >= 12",
    "undirected_pairs": f"WITH {_e()} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e",
    "application_subgraph": f"WITH {_e()} SELECT src, dst FROM e WHERE src % 2 = 0 AND dst % 2 = 0",
    "community_edges": f"WITH {_e()}, {_M} SELECT a.owner AS community, count(*) FILTER (a.owner = b.owner) AS internal, count(*) FILTER (a.owner <> b.owner) AS external FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst GROUP BY 1",
    "condensed_view": f"WITH {_e()}, {_M}, k AS (SELECT src, dst, CASE WHEN dynamic THEN 'dynamic' WHEN type_only THEN 'type-only' ELSE 'static' END AS kind FROM e) SELECT a.domain AS a, b.domain AS b, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM k JOIN m a ON a.path = k.src JOIN m b ON b.path = k.dst WHERE a.domain <> b.domain GROUP BY 1, 2",
    "view_backbone": f"WITH {_e()}, {_M}, v AS (SELECT a.domain AS src, b.domain AS dst, count(*) AS weight FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.domain <> b.domain GROUP BY 1, 2) SELECT src, dst, weight FROM v QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, src, dst) = 1 UNION SELECT src, dst, weight FROM v QUALIFY row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src, dst) = 1",
    "candidate_facts": f"{_GM}, {_CAND} SELECT cand, files, line_count, owners, domains, exporting, composition, protected, consumers, unsupported FROM facts",
    "candidate_scores": f"{_ALL} SELECT id, array_to_string(codes, ',') AS codes, eligible, round(score, 6) AS score, classification, review_units, round(line_count / review_units, 6) AS lines_per_unit, '@engine/' || regexp_replace(lower(first_domain), '[^a-z0-9]+', '-', 'g') AS package, status, cohesion, risk, array_to_string(advice, ',') AS advice FROM j",
    "rejection_counts": f"{_ALL} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM j) GROUP BY 1",
    "closure_escapes": f"WITH {_e()}, {_M} SELECT a.owner AS cand, CASE WHEN a.owner = b.owner THEN 'internal' ELSE 'escape' END AS class, count(*) AS n FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst GROUP BY 1, 2",
    "owner_consumers": f"WITH {_e()}, {_M} SELECT b.owner AS cand, e.src AS importer, string_agg(DISTINCT './' || e.dst, ',' ORDER BY './' || e.dst) AS specifiers FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.owner <> b.owner GROUP BY 1, 2",
    "marginal_blockers": f"WITH {_e()}, {_M}, x AS (SELECT DISTINCT e.src, b.domain AS b, a.line_count FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.domain <> b.domain), k AS (SELECT *, count(*) OVER (PARTITION BY src) AS edges FROM x) SELECT 'crosses-domain' AS code, b AS edge, count(*) AS occurrences, count(*) FILTER (edges = 1) AS freed, coalesce(sum(line_count) FILTER (edges = 1), 0)::BIGINT AS freed_lines FROM k GROUP BY 2",
    "jaccard_pairs": f"WITH {_SETS}, s AS (SELECT DISTINCT same AS id, unnest(s) AS item FROM cl), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), x AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2) SELECT a, b, round(k / (p.n + q.n - k), 9) AS similarity FROM x JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8",
    "jaccard_classes": f"WITH {_SETS} SELECT id, same FROM cl",
    "best_candidate": f"{_ALL} SELECT id, round(score, 6) AS score FROM j WHERE eligible AND status = 'recommended' ORDER BY score DESC, id LIMIT 1",
    "hotspots": f"{_ALL}, {_EQ}, {_HOT} SELECT * FROM hot",
    "lazy_registry": f"WITH {_e()}, {_M} SELECT e.src, e.dst, coalesce(string_agg(DISTINCT m.domain, ',' ORDER BY m.domain), '') AS candidates FROM e LEFT JOIN m ON m.path = e.dst AND m.has_exports WHERE e.dynamic GROUP BY 1, 2",
    "strategy_orders": f"""{_ALL}, o AS (SELECT 'cohesive' AS strategy, id, row_number() OVER (ORDER BY domains, score DESC, id) AS place FROM j UNION ALL SELECT 'campaign', id, row_number() OVER (ORDER BY score DESC, id) FROM j UNION ALL SELECT 'preparation', id, row_number() OVER (ORDER BY escapes, score DESC, id) FROM j UNION ALL SELECT 'low-risk', id, row_number() OVER (ORDER BY review_units, score DESC, id) FROM j UNION ALL SELECT 'max-loc', id, row_number() OVER (ORDER BY line_count DESC, id) FROM j) SELECT * FROM o WHERE place <= 20""",
    "bounded_report": f"WITH {_M} SELECT path, line_count, (SELECT count(*) FROM m) AS total, greatest((SELECT count(*) FROM m) - 25, 0) AS omitted FROM m ORDER BY line_count DESC, path LIMIT 25",
    "percentile_ranks": """WITH p AS (SELECT p_partkey AS id, p_type || '/' || p_brand AS cohort, p_size::BIGINT AS metric FROM part), q AS (SELECT *, count(*) OVER (PARTITION BY cohort) AS cohort_size, count(*) OVER () AS n, rank() OVER (PARTITION BY cohort ORDER BY metric) - 1 AS b1, count(*) OVER (PARTITION BY cohort, metric) AS e1, rank() OVER (ORDER BY metric) - 1 AS b2, count(*) OVER (PARTITION BY metric) AS e2 FROM p)
        SELECT id, cohort, metric, cohort_size, CASE WHEN cohort_size < 8 THEN 'repo' ELSE 'cohort' END AS source, CASE WHEN cohort_size < 8 THEN CASE WHEN n <= 1 THEN 50 ELSE floor((b2 + 0.5 * e2) / n * 100 + 0.5) END ELSE floor((b1 + 0.5 * e1) / cohort_size * 100 + 0.5) END::BIGINT AS percentile FROM q""",
    "dominant_affinity": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type AS dominant, round(n / sum(n) OVER (PARTITION BY user_id), 9) AS concentration FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "capability_partitions": "WITH p AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS labels FROM orders GROUP BY 1) SELECT labels, count(*) AS members, min(o_custkey) AS first FROM p GROUP BY 1",
    "unused_properties": "SELECT c_custkey AS property FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "multiset_delta": "WITH a AS (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') SELECT 'added' AS change, l_linenumber, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY 2 UNION ALL SELECT 'removed', l_linenumber, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 2",
    "last_writer": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "adjacent_checks": "SELECT user_id, event_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type",
    "increasing_faults": "SELECT * FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before",
    "span_overlaps": 'WITH s AS (SELECT DISTINCT l_orderkey, start, start + 25 AS "end" FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS start FROM lineitem GROUP BY 1, 2)), w AS (SELECT *, max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s) SELECT * FROM w WHERE start < reached',
    "hash_chain": "WITH o AS (SELECT o_custkey AS path, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE 'F' END AS pre_hash, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS state FROM orders) SELECT * FROM o WHERE state IS NOT NULL AND state <> pre_hash",
    "inventory_drift": "WITH c AS (SELECT c_custkey AS path, sha256(c_name) AS sha FROM customer), a AS (SELECT * FROM c WHERE path % 11 <> 0), b AS (SELECT path, CASE WHEN path % 17 = 0 THEN 'x' ELSE sha END AS sha FROM c WHERE path % 13 <> 0) SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path) WHERE change IS NOT NULL",
    "metric_ratchet": "WITH a AS (SELECT l_partkey AS path, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS path, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(a.path, b.path) AS path, 'lines' AS metric, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'stale' WHEN b.v > a.v THEN 'worse' WHEN b.v < a.v THEN 'improved' ELSE 'accepted' END AS verdict FROM a FULL JOIN b ON a.path = b.path",
    "preparation_delta": "SELECT *, rows_after - rows_before AS rows_delta, good_after - good_before AS good_delta FROM (SELECT count(*) AS rows_before, sum(quality)::BIGINT AS good_before, count(*) FILTER (toxic = 0) AS rows_after, sum(quality) FILTER (toxic = 0)::BIGINT AS good_after FROM labels)",
    "url_paths": r"WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages) SELECT page_id, u AS normal, CASE WHEN contains(u, '/') THEN '@' || split_part(u, '/', 1) || '/' || split_part(u, '/', 2) ELSE '@' || u END AS package, '@types/' || replace(u, '/', '__') AS types, regexp_replace(u, '(\.d)?\.[A-Za-z0-9]+$', '') AS stem, len(string_split(u, '/')) AS segments, regexp_matches(u, '^[^/]*\.example\.com/.*$') AS globbed FROM p",
    "token_index": r"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html || ' ' || url, '[A-Za-z0-9_@.\-\\/]+')) AS token FROM pages), k AS (SELECT page_id, regexp_replace(replace(token, '\', '/'), '^(\./|/+)', '') AS path FROM t) SELECT path, count(*) AS n, count(DISTINCT page_id) AS pages FROM k WHERE contains(path, '/') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) GROUP BY 1",
    "suffix_keys": "WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages), i AS (SELECT page_id, s, unnest(range(1, len(s))) AS i FROM p) SELECT page_id, array_to_string(s[i:], '/') AS key FROM i",
    "line_counts": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END AS lines, sha256(text) AS sha256 FROM documents",
    "closest_names": "WITH p AS (SELECT DISTINCT p_name FROM part), d AS (SELECT p_name, o, levenshtein(p_name, o) AS d FROM p, (VALUES ('small ring'), ('red widget'), ('large bolt'), ('blue gear')) v(o)), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY d, o) = 1) SELECT p_name, levenshtein(p_name, 'small ring') AS distance, CASE WHEN d <= greatest(2, length(p_name) // 3) THEN o END AS closest FROM b",
    "numbers_and_dates": "SELECT o_orderkey, floor((o_totalprice - 250000) / 1000 + 0.5)::BIGINT AS rounded, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age, true AS is_hash FROM orders",
    "rendered_names": "SELECT p_partkey, lower(p_brand) || '/' || lower(p_type) || '-' || p_partkey AS name FROM part",
    "line_positions": "WITH d AS (SELECT doc_id, substr(text, 1, instr(text, 'the') - 1) AS head FROM documents WHERE contains(text, 'the')) SELECT doc_id, length(head) - length(replace(head, chr(10), '')) + 1 AS line, length(string_split(head, chr(10))[-1]) AS \"column\" FROM d",
    "event_keys": "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "plan_conflicts": f"""WITH {_M}, {_OPS}, a AS (SELECT DISTINCT plan_id, kind, path, part, key FROM op),
        x AS (SELECT l.plan_id AS l, r.plan_id AS r, CASE WHEN length(l.path) >= length(r.path) THEN l.path ELSE r.path END AS path, l.kind = r.kind AND l.kind LIKE 'consumer-%' AND l.key <> r.key AS ok
            FROM a l JOIN a r ON l.part = r.part AND l.plan_id < r.plan_id AND (l.path = r.path OR l.kind = 'delete-tree' OR r.kind = 'delete-tree'))
        SELECT l, r, path, bool_and(ok) AS mergeable FROM x GROUP BY 1, 2, 3""",
    "operation_counts": f"WITH {_M}, {_OPS} SELECT v.kind, count(op.kind) AS n FROM (VALUES ('move'), ('write'), ('rewrite'), ('delete'), ('delete-tree'), ('consumer-source'), ('consumer-manifest'), ('generate')) v(kind) LEFT JOIN op ON op.kind = v.kind GROUP BY 1",
    "duplicate_operations": f"WITH {_M}, {_OPS} SELECT kind, path, count(*) AS n FROM op GROUP BY 1, 2 HAVING count(*) > 1",
    "journal_tree": f"WITH RECURSIVE {_TREE} SELECT path, content FROM landed",
    "byte_fidelity": f"""WITH RECURSIVE {_TREE}, la AS (SELECT path, sha256(CASE WHEN suffix(path, '7') THEN content || '?' WHEN suffix(path, '42') THEN 'other' ELSE content END) AS sha FROM landed WHERE NOT suffix(path, '51') UNION ALL SELECT path, sha256(content) FROM tr WHERE suffix(path, '93'))
        SELECT * FROM (SELECT want.path, CASE WHEN want IS NULL AND sha IS NOT NULL THEN 'survives' WHEN want IS NOT NULL AND sha IS NULL THEN 'missing' WHEN want <> sha THEN 'differs' END AS fault FROM want LEFT JOIN la ON la.path = want.path) WHERE fault IS NOT NULL""",
    "projected_state": f"WITH RECURSIVE {_TREE} SELECT path, want AS result_hash FROM want",
    "journal_faults": f"WITH RECURSIVE {_TREE} SELECT 4 * c_custkey + st.step AS idx, CASE WHEN c_custkey % 70 = 4 THEN 'precondition' ELSE 'result-hash' END AS fault FROM st WHERE (c_custkey % 70 = 4 AND step = 0) OR (c_custkey % 70 = 12 AND step = 0)",
    "ledger_issues": """WITH l AS (SELECT DISTINCT ON (conv_id, turn, sha256(text)) conv_id AS campaign, turn AS seq, sha256(text) AS id, role, CASE WHEN turn < 6 THEN 'a' ELSE 'b' END AS baseline, length(text) % 2 = 0 AS ok FROM conversations),
        x AS (SELECT *, lag(seq) OVER (PARTITION BY campaign ORDER BY seq) AS bf, first(baseline) OVER (PARTITION BY campaign ORDER BY seq) AS base, row_number() OVER (PARTITION BY campaign, id ORDER BY seq) AS nth FROM l),
        i AS (SELECT campaign, 'sequence' AS issue FROM x WHERE seq <> bf + 1 UNION ALL SELECT campaign, 'repeated-id' FROM x WHERE nth > 1 UNION ALL SELECT campaign, 'stale-baseline' FROM x WHERE baseline <> base UNION ALL SELECT campaign, 'unaudited' FROM x WHERE role = 'assistant' AND NOT ok)
        SELECT campaign, issue, count(*) AS n FROM i GROUP BY 1, 2""",
    "qualification": "WITH g AS (SELECT user_id, bool_or(event_type = 'error' AND value > 60) AS f, bool_or(event_type = 'error' AND value <= 60) AS d, bool_or(value < 1) AS e FROM events GROUP BY 1) SELECT user_id, CASE WHEN f THEN 'fatal' WHEN d THEN 'degraded' WHEN e THEN 'allowed-empty' ELSE 'qualified' END AS status, (CASE WHEN f THEN 1 WHEN d THEN 2 ELSE 0 END)::INT AS exit_code FROM g",
    "lifecycle_states": "WITH o AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderkey % 4 = 0 THEN 'reconciled' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'verified' WHEN o_orderstatus = 'F' THEN 'applied' WHEN o_orderkey % 9 = 0 THEN 'stale' WHEN o_orderstatus = 'P' THEN 'dirty' ELSE 'planned' END AS state FROM orders) SELECT state, count(*) AS n FROM o GROUP BY 1",
    "symbol_edges": f"WITH {_L} SELECT l_partkey AS src, nxt AS dst, CASE WHEN bool_and(l_returnflag = 'A') THEN 'type' WHEN bool_or(l_returnflag = 'A') THEN 'both' ELSE 'value' END AS space, count(*) AS n FROM l WHERE l_quantity >= 40 AND nxt IS NOT NULL AND l_partkey <> nxt GROUP BY 1, 2",
    "keyed_symbol_edges": f"WITH {_L}, {_M} SELECT l_partkey AS src, nxt AS dst, CASE WHEN l_returnflag = 'A' THEN 'type' ELSE 'value' END AS space, count(*) AS n FROM l JOIN m a ON a.path = l_partkey JOIN m b ON b.path = nxt WHERE l_quantity >= 40 AND l_partkey <> nxt AND a.domain <> b.domain GROUP BY 1, 2, 3",
    "declaration_groups": "SELECT p_brand AS file, p_name AS name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_size, p_partkey) AS ids FROM part GROUP BY 1, 2",
    "external_consumers": 'SELECT l_partkey AS "group", l_suppkey AS path, l_returnflag AS affinity, count(*) AS n FROM lineitem GROUP BY 1, 2, 3',
    "most_references": 'SELECT "group", path, max(n) AS n FROM (SELECT l_partkey AS "group", l_suppkey AS path, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2',
    "split_candidates": f"""WITH {_e()}, a AS (SELECT l_partkey AS g, l_returnflag AS affinity, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY g) AS total FROM a QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, affinity) = 1), k AS (SELECT l_partkey AS g, count(DISTINCT l_suppkey) AS consumers FROM lineitem GROUP BY 1), x AS (SELECT t.*, consumers, (SELECT count(*) FROM e WHERE dst = t.g) AS inside, (SELECT count(*) FROM e WHERE src = t.g) AS outside FROM t JOIN k USING (g))
        SELECT g AS "group", consumers, affinity AS dominant, round(n / total, 9) AS concentration, inside, outside, (floor(n / total * 1000 + 0.5) + 10 * consumers - inside - outside)::BIGINT AS score FROM x""",
    "seam_crossings": f"WITH {_e()}, {_M} SELECT src, dst, CASE WHEN a.owner = 'PROMO' THEN 'moved-to-retained' ELSE 'retained-to-moved' END AS direction FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE (a.owner = 'PROMO') <> (b.owner = 'PROMO')",
    "compatibility_shims": f"WITH {_e(45)}, o AS (SELECT l_partkey AS path, min(l_suppkey) AS package FROM lineitem WHERE l_quantity >= 45 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) SELECT path, package, count(*) AS inbound FROM o JOIN e ON e.dst = path GROUP BY 1, 2",
    "evaluation_reach": f"WITH RECURSIVE {_e()}, {_M}, s AS (SELECT path AS id FROM m WHERE domain = 'Brand#1' UNION SELECT e.dst FROM s JOIN e ON e.src = s.id AND NOT e.type_only) SELECT id FROM s",
    "bounded_union": f"""WITH RECURSIVE {_e(48)}, {_C}, {_M}, sel AS (SELECT c.* FROM c JOIN m ON m.path = c.id WHERE m.line_count > 47), w AS (SELECT c.*, c.id IN (SELECT id FROM sel) AS s, c.comp IN (SELECT comp FROM c WHERE id % 97 = 0) AS held FROM c WHERE comp IN (SELECT comp FROM sel))
        SELECT id, CASE WHEN held THEN 'retained' WHEN s THEN 'selected' ELSE 'absorbed' END AS role FROM w UNION ALL SELECT DISTINCT e.dst, 'dependency' FROM e JOIN w ON w.id = e.src AND NOT w.held WHERE e.dst NOT IN (SELECT id FROM w)""",
    "boundary_cuts": f"WITH {_e()} SELECT src, dst, CASE WHEN dst % 97 = 0 THEN 'composition' WHEN dst % 5 = 0 THEN 'retained' ELSE 'outside' END AS reason FROM e WHERE src % 2 = 0 AND dst % 2 = 1",
    "retained_blockers": f"WITH {_e()}, {_M} SELECT a.owner AS cand, e.dst AS target, min(e.src) AS source FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.owner <> 'PROMO' AND b.owner = 'PROMO' GROUP BY 1, 2",
    "travelling_tests": f"WITH RECURSIVE {_e()}, {_M}, s AS (SELECT dst AS id FROM e WHERE src % 3 = 2 AND dst % 3 = 0 UNION SELECT e.dst FROM s JOIN e ON e.src = s.id AND e.dst % 3 = 0) SELECT path AS id FROM m WHERE path % 3 = 0 AND path NOT IN (SELECT id FROM s)",
    "promotion_cut": f"WITH RECURSIVE {_e(48)}, {_C}, top AS (SELECT comp FROM c GROUP BY 1 ORDER BY count(*) DESC, comp LIMIT 1), k AS (SELECT id FROM c WHERE comp IN (SELECT comp FROM top) AND id <> comp), e2 AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)), r2 AS (SELECT src, dst FROM e2 UNION SELECT r2.src, e2.dst FROM r2 JOIN e2 ON r2.dst = e2.src) SELECT k.id, least(k.id, coalesce(min(x.dst), k.id)) AS comp FROM k LEFT JOIN (SELECT a.src, a.dst FROM r2 a JOIN r2 b ON a.src = b.dst AND a.dst = b.src) x ON x.src = k.id GROUP BY k.id",
    "weak_clusters": f"WITH RECURSIVE {_e()}, u AS (SELECT src, dst FROM e WHERE NOT dynamic UNION SELECT dst, src FROM e WHERE NOT dynamic), s AS (SELECT src AS id, src AS r FROM u UNION SELECT s.id, u.dst FROM s JOIN u ON u.src = s.r) SELECT id, min(r) AS cluster FROM s GROUP BY 1",
    "dependency_evidence": "SELECT l_partkey AS owner, l_suppkey AS package, CASE WHEN bool_or(l_linestatus = 'O') THEN 'runtime' ELSE 'dev' END AS section FROM lineitem GROUP BY 1, 2",
    "version_resolution": "WITH d AS (SELECT p_name AS package, count(DISTINCT p_type) AS k, min(p_type) AS one, min(p_type) FILTER (p_brand = 'Brand#1') AS root FROM part GROUP BY 1) SELECT package, CASE WHEN k = 1 THEN one ELSE root END AS version, CASE WHEN k = 1 THEN 'declared' WHEN root IS NOT NULL THEN 'root' ELSE 'ambiguous' END AS source FROM d",
    "donor_pruning": "SELECT l_partkey AS owner, l_suppkey AS package FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'R') AND NOT bool_or(l_linestatus = 'O' AND l_quantity > 25) AND l_suppkey <> 7",
    "missing_resolutions": "SELECT DISTINCT l_orderkey AS importer, l_partkey AS package, l_suppkey AS version FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey % 2 = 1 AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)",
    "target_collisions": "SELECT 'libs/' || lower(p_brand) || '/' || p_name AS target, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS sources FROM part GROUP BY 1 HAVING count(*) > 1",
    "missing_rewrites": f"WITH {_e()} SELECT DISTINCT src AS path, './' || dst AS specifier FROM e WHERE dst % 3 = 0 AND src % 3 <> 0 AND src % 2 = 1",
    "boundary_breaks": f"WITH {_e()} SELECT src, dst FROM e WHERE src % 5 = 0 AND dst % 5 <> 0 AND NOT dynamic",
    "source_conservation": "SELECT lang AS category, count(*) FILTER (doc_id % 5 = 0) AS lost, count(*) FILTER (doc_id % 7 = 0) AS gained, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0) AS changed FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0 GROUP BY 1",
    "postconditions": """WITH p AS (SELECT (c_custkey % 400)::VARCHAR AS name, c_custkey AS owner FROM customer WHERE c_custkey % 3 <> 0), d AS (SELECT o_custkey % 50 AS owner, (o_custkey % 900)::VARCHAR AS name, o_orderstatus = 'P' AS ws, CASE WHEN o_totalprice > 400000 THEN 'dev' ELSE 'runtime' END AS section FROM orders)
        SELECT 'duplicate-name' AS rule, name FROM p GROUP BY 2 HAVING count(DISTINCT owner) > 1 UNION SELECT 'unresolved-workspace', name FROM d WHERE ws AND name NOT IN (SELECT name FROM p) UNION SELECT 'conflicting-sections', name FROM (SELECT owner, name FROM d GROUP BY 1, 2 HAVING count(DISTINCT section) > 1)""",
    "accepted_overlay": "SELECT o_custkey AS path, o_orderkey AS idx, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AND c_acctbal < 0 THEN 'accepted' ELSE o_orderstatus END AS result_hash FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "declarative_edits": "WITH d AS (SELECT doc_id AS path, text, (length(text) - length(replace(text, ' with ', ''))) // 6 AS n FROM documents) SELECT path, CASE WHEN n = 1 THEN 'applied' WHEN n = 0 AND contains(text, ' WITH ') THEN 'already' ELSE 'refused' END AS status, sha256(CASE WHEN n = 1 THEN replace(text, ' with ', ' WITH ') ELSE text END) AS sha256 FROM d",
    "input_inventory": "WITH b AS (SELECT source, doc_id // 1000 AS k, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, sha256(string_agg(concat_ws(':', doc_id, sha256(text)), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS members, sum(bytes)::BIGINT AS bytes, sha256(string_agg(h, chr(10) ORDER BY k)) AS digest FROM b GROUP BY 1",
    "unbound_reports": "SELECT * FROM (SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unbound' WHEN c_acctbal < 0 AND o_orderstatus = 'O' THEN 'drifted' END AS fault FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 20 <> 0) ON c_custkey = o_custkey) WHERE fault IS NOT NULL",
    "graph_digests": f"WITH {_e()}, {_M}, p AS (SELECT owner, src, string_agg(dst::VARCHAR, ';' ORDER BY dst) AS o FROM e JOIN m ON m.path = e.src GROUP BY 1, 2), b AS (SELECT owner, src // 1000 AS k, sha256(string_agg(src || ':' || o, chr(10) ORDER BY src)) AS h FROM p GROUP BY 1, 2) SELECT owner, sha256(string_agg(h, chr(10) ORDER BY k)) AS digest FROM b GROUP BY 1",
    "canonical_props": "SELECT event_id, '{\"a\":{\"k\":' || json_extract(props, '$.k')::VARCHAR || '},\"z\":[1,2]}' AS json FROM events",
    "spliced_texts": "SELECT doc_id, sha256('<a>' || substr(text, 2, 1) || '<b>' || substr(text, 4, 1) || substr(text, 6)) AS sha256 FROM documents WHERE length(text) >= 6",
    "file_metrics": f"WITH {_FM} SELECT path, functions, max_cognitive, max_nest, max_loc, fan_out, responsibilities, round(avg_cyclo, 6) AS avg_cyclo, structural, volume FROM fm",
    "levers": f"""WITH {_FM}, lo AS (SELECT path, archetype, unnest([structural, responsibilities, max_cognitive, max_nest, fan_out]) AS v, unnest(range(0, 5)) AS k FROM fm),
        pc AS (SELECT path, k, floor(CASE WHEN count(*) OVER own < 8 THEN (rank() OVER (PARTITION BY k ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY k, v)) / count(*) OVER (PARTITION BY k) ELSE (rank() OVER (PARTITION BY k, archetype ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY k, archetype, v)) / count(*) OVER own END * 100 + 0.5)::BIGINT AS p FROM lo WINDOW own AS (PARTITION BY k, archetype)),
        w AS (SELECT path, max(p) FILTER (k = 0) AS p_structural, max(p) FILTER (k = 1) AS p_responsibilities, max(p) FILTER (k = 2) AS p_max_cognitive, max(p) FILTER (k = 3) AS p_max_nest, max(p) FILTER (k = 4) AS p_fan_out FROM pc GROUP BY 1), x AS (SELECT *, greatest(p_responsibilities, p_max_cognitive, p_max_nest, p_fan_out) AS hi FROM w JOIN fm USING (path)),
        y AS (SELECT *, CASE hi WHEN p_responsibilities THEN 'responsibilities' WHEN p_max_cognitive THEN 'max_cognitive' WHEN p_max_nest THEN 'max_nest' ELSE 'fan_out' END AS driver FROM x)
        SELECT path, CASE WHEN responsibilities >= 2 AND p_responsibilities > 60 THEN 'split-service' WHEN driver = 'max_cognitive' AND p_max_cognitive > 75 THEN 'extract-method' WHEN driver = 'max_nest' AND p_max_nest > 60 THEN 'flatten-nesting' WHEN driver = 'fan_out' AND p_fan_out > 60 THEN 'reduce-coupling' WHEN ctor_params > 5 THEN 'deps-bag' WHEN archetype = 'react-component' AND p_structural > 60 THEN 'decompose-component' WHEN archetype = 'react-hook' AND p_structural > 60 THEN 'extract-hook' ELSE 'none' END AS lever, driver, p_structural, p_responsibilities, p_max_cognitive, p_max_nest, p_fan_out FROM y""",
    "recipe_steps": f"WITH {_M} SELECT file AS path, CASE WHEN path % 7 = 0 THEN 'boundary' WHEN owner IN ('PROMO', 'SMALL') THEN 'promotion' ELSE 'unconfigured' END AS step, CASE WHEN path % 7 = 0 THEN path WHEN owner = 'PROMO' THEN 1 WHEN owner = 'SMALL' THEN 3 END AS id FROM m",
    "hotspot_actions": f"{_ALL}, {_EQ}, {_HOT} SELECT path, concat_ws(',', CASE WHEN inbound >= 2 THEN 'stabilise-inbound' END, CASE WHEN fan_out >= 2 THEN 'reduce-fan-out' END, CASE WHEN cross_domain > 0 THEN 'cut-cross-domain' END) AS actions FROM hot",
    "target_options": "WITH l AS (SELECT * FROM lineitem), h AS (SELECT s_suppkey AS package FROM supplier WHERE s_acctbal > 0), c AS (SELECT l_orderkey AS id, min(l_suppkey) + max(l_linenumber) AS suggested FROM l GROUP BY 1) SELECT id, suggested AS package, CASE WHEN suggested IN (SELECT package FROM h) THEN 'extend' ELSE 'create' END AS option, 'high' AS fit FROM c UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 'extend', 'medium' FROM l JOIN c ON c.id = l_orderkey WHERE l_suppkey IN (SELECT package FROM h) AND l_suppkey <> c.suggested",
    "rewritable_escapes": "WITH n AS (SELECT l_orderkey AS source, l_partkey AS target, l_suppkey AS package, list(DISTINCT CASE WHEN l_tax = 0 THEN 'default' ELSE l_returnflag END) AS b FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2, 3), s AS (SELECT l_suppkey AS package, l_partkey AS target, list(DISTINCT CASE WHEN l_discount = 0 THEN '*' ELSE l_returnflag END) AS names FROM lineitem WHERE l_quantity <= 45 GROUP BY 1, 2) SELECT source, target, package, coalesce(len(list_filter(b, lambda x: NOT list_contains(names, x) AND NOT (list_contains(names, '*') AND x <> 'default'))) = 0, false) AS rewritable FROM n LEFT JOIN s USING (package, target)",
    "campaign_targets": f"{_ALL}, g AS (SELECT *, min(id) OVER (PARTITION BY first_domain, line_count) AS rep FROM j) SELECT id, line_count, round(line_count / review_units, 6) AS rate FROM g WHERE id = rep ORDER BY line_count / review_units DESC, line_count DESC, id LIMIT 15",
    "gate_commands": f"WITH {_M} SELECT DISTINCT 'project' AS tier, t || ' ' || owner AS command FROM m, (VALUES ('test'), ('lint')) v(t) UNION ALL VALUES ('package', 'build'), ('workspace', 'check')",
    "stop_conditions": "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'budget' WHEN o_totalprice < 20000 THEN 'no-progress' WHEN o_orderkey % 100 = 0 THEN 'milestone' END AS stop FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) WHERE stop IS NOT NULL",
    "workspace_coverage": "WITH p AS (SELECT p_partkey AS k, lower(p_brand) || '/' || CASE WHEN p_size = 50 THEN '..' ELSE lower(p_type) END || '/' || replace(p_name, ' ', '-') AS path FROM part), c AS (SELECT path FROM p WHERE k % 3 = 0) SELECT DISTINCT path, 'not-configured' AS fault FROM p WHERE k % 2 = 0 AND path NOT IN (SELECT path FROM c) UNION ALL SELECT DISTINCT path, 'not-scanned' FROM p WHERE k % 2 = 0 AND path NOT IN (SELECT path FROM p WHERE k % 5 <> 0) UNION ALL SELECT path, 'configured-twice' FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT path, 'unsafe' FROM c WHERE contains(path, '/../')",
    "portfolio_totals": f"{_ALL} SELECT count(*) AS candidates, count(*) FILTER (eligible) AS eligible, count(*) FILTER (NOT eligible) AS blocked, count(*) FILTER (status = 'recommended') AS recommended, count(*) FILTER (status = 'discouraged') AS discouraged, sum(CASE WHEN eligible THEN line_count ELSE 0 END)::BIGINT AS eligible_lines FROM j",
    "ratchet_summary": "WITH a AS (SELECT l_partkey AS path, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS path, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT 'lines' AS metric, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'stale' WHEN b.v > a.v THEN 'worse' WHEN b.v < a.v THEN 'improved' ELSE 'accepted' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.path = b.path GROUP BY 2",
    "relative_resolution": f"WITH {_e()}, {_M} SELECT a.file || '.ts' AS source, '../' || lower(b.owner) || '/./' || b.path AS specifier, CASE b.path % 4 WHEN 0 THEN b.file || '.ts' WHEN 1 THEN b.file || '/index.ts' WHEN 2 THEN b.file || '.js' END AS resolved FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst",
    "triggered_artifacts": "SELECT * FROM (VALUES ('docs'), ('promo'), ('tens')) v(name)",
    "ambiguous_rewrites": "WITH p AS (SELECT url, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages), i AS (SELECT url, s, unnest(range(1, len(s))) AS i FROM p) SELECT array_to_string(s[i:], '/') AS key, count(DISTINCT url) AS choices FROM i GROUP BY 1 HAVING count(DISTINCT url) > 1",
    "rewrite_collisions": 'SELECT l_partkey AS file, l_linenumber AS "to", count(DISTINCT l_suppkey) AS donors FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1',
    "rewrite_replay": 'SELECT l_orderkey AS path, l_linenumber AS start, l_partkey AS "from", l_suppkey AS "to" FROM lineitem GROUP BY 1, 2, 3, 4 HAVING max(l_quantity) <= 5',
    "chain_breaks": "WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS bf FROM (SELECT DISTINCT conv_id, turn FROM conversations)) SELECT conv_id AS chain, turn AS seq, conv_id || ':' || turn AS id FROM c WHERE bf IS NOT NULL AND bf <> turn - CASE WHEN (conv_id + turn) % 7 = 0 THEN 2 ELSE 1 END",
    "unclosed_selection": f"WITH {_e()}, {_M} SELECT src, dst FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.owner IN ('PROMO', 'SMALL') AND b.owner NOT IN ('PROMO', 'SMALL')",
    "seam_blockers": f"WITH {_e()}, {_M} SELECT 'exact' AS certainty, 'no-exports' AS code, path AS id FROM m WHERE owner = 'PROMO' AND NOT has_exports UNION SELECT 'exact', 'cycle', src FROM e WHERE EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src) UNION SELECT 'heuristic', 'large', path FROM m WHERE owner = 'PROMO' AND line_count > 45",
    "batch_targets": f"{_ALL}, {_EQ}, {_HOT} SELECT path, pressure FROM hot ORDER BY pressure DESC, path LIMIT 10",
    "canonical_paths": f"WITH {_M} SELECT path, file FROM m",
    "connectivity_backbone": f"""WITH RECURSIVE {_e()}, {_M}, d AS (SELECT a.domain AS a, b.domain AS b, count(*) AS n FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.domain <> b.domain GROUP BY 1, 2), w AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n)::BIGINT AS weight FROM d GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS k FROM w), u AS (SELECT a AS x, b AS y, k FROM v UNION ALL SELECT b, a, k FROM v),
        r AS (SELECT k, a AS x FROM v UNION SELECT r.k, u.y FROM r JOIN u ON u.x = r.x AND u.k < r.k) SELECT a, b, weight FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = v.k AND r.x = v.b)""",
    "cohesion_clusters": """WITH RECURSIVE u AS (SELECT DISTINCT l_suppkey || '/' || l_linenumber AS owner, l_orderkey AS id, l_partkey AS field FROM lineitem), n AS (SELECT owner, count(DISTINCT id) AS n FROM u GROUP BY 1), k AS (SELECT owner, field, count(*) AS k, min(id) AS first FROM u GROUP BY 1, 2), ra AS (SELECT u.owner, u.id, k.first FROM u JOIN k USING (owner, field) JOIN n USING (owner) WHERE k.k < greatest(3, ceil(n.n * 0.4)) AND u.id <> k.first),
        g AS (SELECT owner, id AS a, first AS b FROM ra UNION SELECT owner, first, id FROM ra), r AS (SELECT owner, a AS id, b AS x FROM g UNION SELECT r.owner, r.id, g.b FROM r JOIN g ON g.owner = r.owner AND g.a = r.x), c AS (SELECT owner, id, min(x::VARCHAR) AS low FROM r GROUP BY 1, 2)
        SELECT DISTINCT u.owner::VARCHAR AS owner, u.id::VARCHAR AS id, least(u.id::VARCHAR, coalesce(low, u.id::VARCHAR)) AS cluster FROM u LEFT JOIN c USING (owner, id)""",
    "greedy_selection": f"""{_ALL}, cp AS (SELECT cand, path::VARCHAR AS path FROM f UNION SELECT cand, 'test/' || path // 20 FROM f WHERE path % 10 = 3 UNION SELECT cand, 'asset/' || path // 20 FROM f WHERE path % 10 = 7), ca AS (SELECT j.id, row_number() OVER (ORDER BY score DESC, j.id) AS k, (SELECT list(path) FROM cp WHERE cp.cand = j.id) AS files FROM j WHERE eligible), st AS (SELECT 0 AS k, []::VARCHAR[] AS taken, 0 AS n, NULL::BIGINT AS id, false AS pick UNION ALL SELECT ca.k, CASE WHEN list_has_any(taken, files) THEN taken ELSE list_concat(taken, files) END, CASE WHEN list_has_any(taken, files) THEN n ELSE n + 1 END, ca.id, NOT list_has_any(taken, files) FROM st JOIN ca ON ca.k = st.k + 1) SELECT id, n::INT AS rank FROM st WHERE pick""",
    "equivalence_groups": f"{_ALL}, {_EQ} SELECT * FROM eq",
    "equivalence_summary": f"""{_ALL}, {_EQ}, gs AS (SELECT seed, any_value(representative) AS representative, 'eg-' || substr(sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)), 1, 12) AS "group", count(*) AS candidates, min(similarity) AS similarity FROM eq GROUP BY seed), sh AS (SELECT seed, count(*) AS shared FROM (SELECT eq.seed, f.path, count(*) AS n FROM eq JOIN f ON f.cand = eq.id GROUP BY 1, 2) JOIN gs USING (seed) WHERE n = candidates GROUP BY seed)
        SELECT "group", representative, candidates, coalesce(shared, 0) AS shared, similarity FROM gs LEFT JOIN sh USING (seed)""",
    "plan_waves": f"""WITH RECURSIVE {_M}, {_OPS}, ad AS (SELECT DISTINCT plan_id, kind, path, key FROM op WHERE kind <> 'delete-tree'), hx AS (SELECT l.plan_id AS l, r.plan_id AS r, l.path, bool_and(l.kind = r.kind AND l.kind LIKE 'consumer-%' AND l.key <> r.key) AS ok FROM ad l JOIN ad r ON l.plan_id < r.plan_id AND l.path = r.path GROUP BY 1, 2, 3), hd AS (SELECT DISTINCT l, r FROM hx WHERE NOT ok), pl AS (SELECT plan_id, row_number() OVER (ORDER BY plan_id % 7 DESC, plan_id) AS k FROM (SELECT DISTINCT plan_id FROM op)),
        ed AS (SELECT x.k AS a, y.k AS b FROM hd JOIN pl x ON x.plan_id = hd.l JOIN pl y ON y.plan_id = hd.r UNION SELECT y.k, x.k FROM hd JOIN pl x ON x.plan_id = hd.l JOIN pl y ON y.plan_id = hd.r), nb AS (SELECT pl.k, plan_id, coalesce(list(b) FILTER (b IS NOT NULL), []) AS l FROM pl LEFT JOIN ed ON ed.a = pl.k AND ed.b < pl.k GROUP BY 1, 2),
        st AS (SELECT 0 AS k, []::BIGINT[] AS w UNION ALL SELECT nb.k, list_append(w, list_min(list_filter(range(0, len(nb.l) + 1), lambda x: NOT list_contains(list_transform(nb.l, lambda i: w[i]), x)))) FROM st JOIN nb ON nb.k = st.k + 1), fin AS (SELECT w FROM st WHERE k = (SELECT max(k) FROM pl)) SELECT plan_id, (SELECT w[pl.k] FROM fin)::INT AS wave FROM pl""",
}
