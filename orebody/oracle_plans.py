"""DuckDB SQL for the queries of queries_plans.py."""

from __future__ import annotations

from .oracle import _L, _M, _e

_SHA = "'^[0-9a-f]{64}$'"
_P = f"""{_M}, o0 AS (SELECT owner AS plan, path AS idx, CASE WHEN path % 8 < 2 THEN 'move' WHEN path % 8 = 2 THEN 'move-with-rewrite' WHEN path % 8 = 3 THEN 'rewrite-import' WHEN path % 8 = 4 THEN 'write-file' WHEN path % 8 = 5 THEN 'delete-file' WHEN path % 8 = 6 THEN 'rewrite-fs-reference' WHEN path % 16 = 7 THEN 'rewrite-path-reference' ELSE 'copy' END AS kind,
    file AS source, CASE WHEN path % 40 = 0 THEN file WHEN path % 48 = 1 THEN 'other/' || path ELSE 'libs/' || lower(domain) || '/src/' || path % 500 END AS target, 'src/' || lower(owner) || '/' || path % 150 AS file,
    CASE WHEN path % 9 = 0 THEN 'missing' WHEN path % 11 = 0 THEN 'bad' ELSE sha256(file) END AS pre, CASE WHEN path % 7 <> 0 THEN sha256(file) END AS blob, CASE path % 10 WHEN 3 THEN 'test' WHEN 7 THEN 'asset' ELSE 'file' END AS role, sha256(file) AS own, sha256(file || '!') AS other, sha256(file || 'x') AS done FROM m),
    op AS (SELECT *, kind IN ('move', 'move-with-rewrite') AS mv, kind IN ('rewrite-import', 'rewrite-fs-reference', 'rewrite-path-reference') AS ed, CASE WHEN kind = 'delete-file' THEN CASE WHEN idx % 10 = 5 THEN own ELSE 'missing' END WHEN kind = 'move' THEN CASE WHEN idx % 13 = 0 THEN other ELSE own END WHEN idx % 17 = 0 THEN pre ELSE done END AS post FROM o0),
    dc AS (SELECT DISTINCT owner AS plan, 'src/' || lower(owner) || '/' || path % 150 AS file FROM m WHERE path % 6 <> 0),
    mvd AS (SELECT DISTINCT plan, unnest([source, target]) AS file FROM op WHERE mv)"""
_OI = f"""oi AS (SELECT *, row_number() OVER (PARTITION BY plan, kind || ':' || CASE WHEN mv THEN source || ':' || target ELSE file END ORDER BY idx) AS nth, row_number() OVER (PARTITION BY plan, file ORDER BY idx) AS touched, count(*) OVER (PARTITION BY plan, mv, target) AS landed, (plan, file) IN (SELECT plan, file FROM mvd) AS hit, (plan, file) IN (SELECT plan, file FROM dc) AS con, kind = 'rewrite-import' AND idx % 3 = 0 AND (plan, file) IN (SELECT plan, file FROM mvd) AND file <> (SELECT min(q.source) FROM op q WHERE q.mv AND q.plan = op.plan) AS crs, (pre = 'missing' OR regexp_matches(pre, {_SHA})) AS pre_ok, regexp_matches(post, {_SHA}) AS post_ok FROM op),
    oz AS (SELECT plan, idx::VARCHAR AS subject, unnest(list_filter([CASE WHEN kind = 'copy' THEN 'unknown-operation' END, CASE WHEN nth > 1 THEN 'duplicate-operation' END, CASE WHEN mv AND source = target THEN 'duplicate-move' END, CASE WHEN mv AND (NOT pre_ok OR NOT post_ok) THEN 'move-hash' END, CASE WHEN mv AND pre IS DISTINCT FROM blob THEN 'move-precondition' END, CASE WHEN kind = 'move' AND post IS DISTINCT FROM blob THEN 'move-not-byte-identical' END,
    CASE WHEN mv AND landed > 1 THEN 'move-targets' END, CASE WHEN mv AND NOT starts_with(target, 'libs/') THEN 'target-containment' END, CASE WHEN kind = 'move-with-rewrite' AND role = 'asset' THEN 'asset-move' END, CASE WHEN (kind = 'move-with-rewrite' OR ed) AND pre = post THEN 'rewrite-identity' END, CASE WHEN ed AND (NOT pre_ok OR NOT post_ok) THEN 'rewrite-hash' END, CASE WHEN kind = 'rewrite-import' AND NOT con THEN 'rewrite-consumer' END,
    CASE WHEN NOT mv AND (hit AND NOT coalesce(crs, false) OR ed AND touched > 1) THEN 'multiple-mutations' END, CASE WHEN kind = 'delete-file' AND pre = 'missing' THEN 'invalid-precondition' END, CASE WHEN kind = 'delete-file' AND (NOT pre_ok OR post <> 'missing') THEN 'delete-hash' END], lambda x: x IS NOT NULL)) AS rule FROM oi)"""
_RW = "rw AS (SELECT b.owner AS plan, e.src AS file, CASE WHEN e.dst % 6 <> 0 THEN e.dst END AS donor, e.dst, '@engine/' || lower(b.owner) || CASE WHEN e.dst % 4 = 0 THEN '/' || e.dst ELSE '' END AS \"to\", '@engine/' || lower(b.owner) AS package FROM e JOIN m a ON a.path = e.src JOIN m b ON b.path = e.dst WHERE a.owner <> b.owner)"
_DS = """ds AS (SELECT plan, file::VARCHAR AS subject, unnest(list_filter([CASE WHEN donor IS NULL AND "to" <> package THEN 'donor-unnamed' END, CASE WHEN donor % 5 <> 0 AND donor % 9 = 0 THEN 'donor-unselected' END, CASE WHEN donor % 5 <> 0 AND donor % 9 <> 0 AND "to" <> package THEN 'donor-root' END, CASE WHEN donor % 5 = 0 AND "to" <> package || '/' || donor THEN 'donor-surface' END], lambda x: x IS NOT NULL)) AS rule FROM rw)"""
_CI = """cs AS (SELECT plan, file, count(*) FILTER (dst % 7 <> 0) AS k, bool_or(dst % 7 <> 0 AND dst % 31 = 0) AS noop FROM rw GROUP BY 1, 2),
    ci AS (SELECT plan, file::VARCHAR AS subject, unnest(list_filter([CASE WHEN file % 29 = 0 THEN 'duplicate-consumer' END, CASE WHEN file % 19 = 0 THEN 'no-importer' END, CASE WHEN file % 7 = 0 THEN 'bad-section' END, CASE WHEN k = 0 THEN 'no-rewrite' END, CASE WHEN noop THEN 'no-op' END], lambda x: x IS NOT NULL)) AS rule FROM cs
    UNION ALL SELECT DISTINCT plan, file::VARCHAR, 'undeclared-target' FROM rw r WHERE dst % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM rw x WHERE x.plan = r.plan AND x."to" = r."to" AND x.dst % 23 <> 0))"""

ORACLE: dict[str, str] = {
    "operation_issues": f"WITH {_P}, {_OI} SELECT * FROM oz",
    "coverage_issues": f"""WITH {_P}, src AS (SELECT owner AS plan, file AS path FROM m WHERE path % 8 < 4), ch AS (SELECT owner AS plan, file AS path FROM m WHERE path % 5 <> 0), mk AS (SELECT DISTINCT owner AS plan, 'src/' || lower(owner) || '/' || path % 150 AS path FROM m WHERE path % 20 = 0),
        mo AS (SELECT DISTINCT plan, source AS path FROM op WHERE mv), ed AS (SELECT DISTINCT plan, file AS path FROM op WHERE kind = 'rewrite-import'), tc AS (SELECT DISTINCT plan, unnest(CASE WHEN mv THEN [source, target] ELSE [file] END) AS path FROM op), due AS (SELECT * FROM tc UNION SELECT * FROM mk),
        i AS (SELECT *, 'move-coverage' AS rule FROM (SELECT * FROM src EXCEPT SELECT * FROM mo) UNION ALL SELECT *, 'move-coverage' FROM (SELECT * FROM mo EXCEPT SELECT * FROM src) UNION ALL SELECT *, 'consumer-coverage' FROM (SELECT plan, file FROM dc EXCEPT SELECT * FROM ed) UNION ALL SELECT *, 'changed-files' FROM (SELECT * FROM due EXCEPT SELECT * FROM ch) UNION ALL SELECT *, 'changed-files' FROM (SELECT * FROM ch EXCEPT SELECT * FROM due) UNION ALL SELECT *, 'generated-file' FROM (SELECT * FROM tc INTERSECT SELECT * FROM mk))
        SELECT plan, rule, count(*) AS n FROM i GROUP BY 1, 2""",
    "donor_surface_issues": f"WITH {_e(40)}, {_M}, {_RW}, {_DS} SELECT * FROM ds",
    "consumer_issues": f"WITH {_e(40)}, {_M}, {_RW}, {_CI} SELECT * FROM ci",
    "plan_issues": f"WITH {_e(40)}, {_P}, {_OI}, {_RW}, {_DS}, {_CI}, u AS (SELECT * FROM oz UNION ALL SELECT * FROM ds UNION ALL SELECT * FROM ci) SELECT plan, rule, count(*) AS n FROM u GROUP BY 1, 2",
    "target_issues": r"""WITH t AS (SELECT s_suppkey AS plan, CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE '@engine/s' || s_suppkey END AS package, CASE WHEN s_suppkey % 11 = 0 THEN 'libs/../' || s_suppkey WHEN s_suppkey % 13 = 0 THEN 'apps/' || s_suppkey ELSE 'libs/' || s_suppkey END AS root, s_suppkey % 5 = 0 AS bare FROM supplier),
        l AS (SELECT l_suppkey AS plan, l_partkey AS source, l_linenumber AS line, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
        m AS (SELECT plan, source, CASE WHEN line = 1 THEN '.' WHEN line = 7 THEN source::VARCHAR ELSE './' || (source + line) % 40 END AS key, CASE WHEN q > 49 THEN 'src/x.ts' ELSE './src/x.ts' END AS target, CASE WHEN line = 6 THEN '@other/' || source ELSE '@engine/s' || plan || CASE WHEN line = 1 THEN '' ELSE '/' || source END END AS specifier FROM l),
        k AS (SELECT m.*, package, row_number() OVER (PARTITION BY plan, key ORDER BY source, key) AS a, row_number() OVER (PARTITION BY plan, source ORDER BY source, key) AS b FROM m JOIN t USING (plan)),
        i AS (SELECT plan, unnest(list_filter([CASE WHEN NOT regexp_matches(package, '^@engine/[a-z0-9][a-z0-9-]*$') THEN 'target-name' END, CASE WHEN NOT starts_with(root, 'libs/') OR contains(root, '..') THEN 'target-root' END, CASE WHEN bare THEN 'target-entrypoint' END], lambda x: x IS NOT NULL)) AS rule FROM t
            UNION ALL SELECT plan, unnest(list_filter([CASE WHEN NOT (starts_with(specifier, package || '/') OR (key = '.' AND specifier = package)) THEN 'module-specifier' END, CASE WHEN (key <> '.' AND NOT starts_with(key, './')) OR NOT starts_with(target, './') THEN 'module-paths' END, CASE WHEN a > 1 OR b > 1 THEN 'module-duplicate' END], lambda x: x IS NOT NULL)) FROM k)
        SELECT plan, rule, count(*) AS n FROM i GROUP BY 1, 2""",
    "artifact_issues": "WITH d AS (SELECT o_custkey AS path, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS h FROM orders GROUP BY 1), s AS (SELECT c_custkey AS path, CASE WHEN c_acctbal < 2000 THEN 'O' ELSE 'F' END AS h FROM customer WHERE c_custkey % 8 <> 0) SELECT 'plan' AS plan, coalesce(d.path, s.path)::VARCHAR AS subject, 'projected-artifacts' AS rule FROM d FULL JOIN s ON d.path = s.path WHERE d.h IS DISTINCT FROM s.h",
    "decision_issues": """WITH l AS (SELECT l_suppkey AS plan, l_partkey AS name, CASE WHEN l_linestatus = 'O' THEN 'target-runtime' ELSE 'target-dev' END AS decision, l_linenumber AS line, l_quantity AS q FROM lineitem), s AS (SELECT plan, name, decision, count(*) AS k, min(CASE WHEN q > 48 THEN 0 ELSE 1 END) AS reasons FROM l WHERE q > 10 AND line < 6 GROUP BY 1, 2, 3), w AS (SELECT DISTINCT plan, name, decision FROM l WHERE line < 5),
        i AS (SELECT plan, 'repeated-decision' AS rule FROM s WHERE k > 1 UNION ALL SELECT plan, 'no-reason' FROM s WHERE reasons = 0 UNION ALL SELECT plan, 'missing-decision' FROM w ANTI JOIN s USING (plan, name, decision) UNION ALL SELECT plan, 'undeclared-decision' FROM s ANTI JOIN w USING (plan, name, decision)) SELECT plan, rule, count(*) AS n FROM i GROUP BY 1, 2""",
    "record_issues": """WITH i AS (SELECT c_nationkey AS plan, unnest(list_filter([CASE WHEN c_custkey % 9 = 0 THEN 'no-command' END, CASE WHEN c_custkey % 4 = 1 THEN 'bad-hash' END, CASE WHEN c_custkey % 4 > 1 AND c_custkey % 3 <> 0 THEN 'unproven' END], lambda x: x IS NOT NULL)) AS rule FROM customer
        UNION ALL SELECT o_custkey, 'commit-subject' FROM orders WHERE o_orderkey % 5 > 1 UNION ALL SELECT o_custkey, 'empty-gate' FROM orders WHERE o_orderkey % 6 = 0) SELECT plan, rule, count(*) AS n FROM i GROUP BY 1, 2""",
    "promotion_issues": f"""WITH {_e(45)}, g AS (SELECT dst AS k, list_sort(list(src)) AS a, list_sort(list(src) FILTER (src % 10 <> 3)) AS c, list_sort(list(src) FILTER (src % 10 = 3)) AS t FROM e GROUP BY 1),
        p AS (SELECT *, CASE WHEN k % 5 = 0 THEN list_reverse(a) WHEN k % 7 = 0 THEN a[1:1] ELSE a END AS proof, k % 3 <> 0 AS cycle, CASE WHEN k % 8 = 0 THEN a ELSE list_prepend(k, a) END AS before, CASE WHEN k % 10 = 1 THEN a[1:1] ELSE a END AS after, CASE WHEN k % 11 = 0 THEN 0 ELSE len(a) END AS removed, (k % 3 = 0 AND k % 9 <> 0) OR k % 19 = 0 AS cont FROM g)
        SELECT 'p' AS plan, k::VARCHAR AS subject, unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'single-source' END, CASE WHEN proof <> list_sort(list_distinct(proof)) THEN 'sorted-proof' END, CASE WHEN list_sort(list_distinct(proof)) <> a THEN 'proof-is-importers' END, CASE WHEN cycle = cont THEN 'one-cut' END, CASE WHEN cycle AND (len(before) < 2 OR NOT list_contains(before, k)) THEN 'cycle-source' END, CASE WHEN cycle AND list_sort(after) <> a THEN 'cycle-partition' END, CASE WHEN cycle AND len(after) >= len(before) THEN 'cycle-smaller' END, CASE WHEN removed = 0 OR (k % 13 = 0 AND k % 11 <> 0 AND len(list_filter(a, lambda s: s <> k)) > 0) THEN 'cut-edges' END, CASE WHEN cont AND (k % 4 = 0 OR 10 - removed + (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) >= 10) THEN 'containment-metric' END], lambda x: x IS NOT NULL)) AS rule FROM p""",
    "dependency_issues": """WITH d AS (SELECT p_brand AS plan, CASE WHEN p_partkey % 6 = 0 THEN p_name WHEN p_partkey % 6 = 1 THEN 'libs/' || p_partkey % 50 ELSE replace(p_name, ' ', '-') END AS name, p_partkey % 8 = 0 AS blank FROM part), w AS (SELECT DISTINCT 'libs/' || p_partkey % 50 AS owner FROM part), r AS (SELECT p_brand AS plan, 'libs/' || p_partkey % 60 AS owner, count(*) AS k FROM part GROUP BY 1, 2),
        i AS (SELECT plan, unnest(list_filter([CASE WHEN NOT regexp_matches(name, '^[a-zA-Z0-9_.@/-]+$') THEN 'dependency-name' END, CASE WHEN blank THEN 'dependency-version' END, CASE WHEN name IN (SELECT owner FROM w) THEN 'dependency-folder' END], lambda x: x IS NOT NULL)) AS rule FROM d UNION ALL SELECT plan, 'repeated-reference' FROM r WHERE k > 1 UNION ALL SELECT plan, 'unknown-reference' FROM r WHERE owner NOT IN (SELECT owner FROM w)) SELECT plan, rule, count(*) AS n FROM i GROUP BY 1, 2""",
    "migration_issues": """WITH t AS (SELECT DISTINCT o_custkey AS plan, o_orderpriority AS mi FROM orders WHERE o_totalprice > 150000), r AS (SELECT o_custkey AS plan, o_orderpriority AS mi, count(*) AS k, bool_or(o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS moved, bool_or(o_orderkey % 3 > 0 AND o_orderkey % 4 = 0) AS still FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
        j AS (SELECT coalesce(t.plan, r.plan) AS plan, coalesce(t.mi, r.mi) AS subject, t.plan IS NOT NULL AS due, k, moved, still FROM t FULL JOIN r ON t.plan = r.plan AND t.mi = r.mi)
        SELECT plan, subject, unnest(list_filter([CASE WHEN k IS NULL THEN 'missing-migration' END, CASE WHEN k > 1 THEN 'repeated-migration' END, CASE WHEN NOT due THEN 'untriggered-migration' END, CASE WHEN moved THEN 'noop-differs' END, CASE WHEN still THEN 'change-is-noop' END], lambda x: x IS NOT NULL)) AS rule FROM j""",
    "path_reference_issues": """WITH r AS (SELECT l_orderkey AS file, l_suppkey AS a, CASE WHEN l_linenumber = 1 THEN l_suppkey ELSE l_partkey % 100 END AS b, l_partkey AS donor FROM lineitem JOIN part ON p_partkey = l_partkey), i AS (SELECT file, unnest(list_filter([CASE WHEN donor % 3 = 0 THEN 'reference-donor' END, CASE WHEN a = b THEN 'reference-noop' END, CASE WHEN donor % 3 <> 0 AND b <> donor % 100 THEN 'reference-target' END], lambda x: x IS NOT NULL)) AS rule FROM r) SELECT rule, count(*) AS n, count(DISTINCT file) AS files FROM i GROUP BY 1""",
    "settings_issues": """WITH k AS (SELECT p_type AS plan, p_brand AS kind FROM part WHERE p_size > 48), s AS (SELECT p_type AS plan, p_name AS suite, p_brand AS kind FROM part WHERE p_size < 4), r AS (SELECT c_mktsegment AS plan, CASE WHEN c_custkey % 3 = 0 THEN 'libs/' || c_custkey % 40 ELSE 'libs/' || c_custkey % 60 || '/' || c_custkey END AS root FROM customer)
        SELECT plan, kind AS subject, 'repeated-kind' AS rule FROM k GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT plan, suite, 'repeated-suite' FROM s GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT plan, suite, 'unknown-kind' FROM s WHERE (plan, kind) NOT IN (SELECT plan, kind FROM k) UNION ALL SELECT DISTINCT a.plan, a.root, 'root-overlap' FROM r a JOIN r b ON a.plan = b.plan AND starts_with(a.root, b.root || '/')""",
    "unauditable_manifests": "WITH c AS (SELECT conv_id AS plan, min(turn) AS a, max(turn) AS b, count(*) AS n, count(*) FILTER (text IS NULL OR length(text) % 7 = 0) AS blank FROM conversations GROUP BY 1) SELECT plan, plan::VARCHAR AS subject, unnest(list_filter([CASE WHEN a > 1 THEN 'no-first-record' END, CASE WHEN b - a + 1 <> n THEN 'gaps' END, CASE WHEN blank > 0 THEN 'no-hash' END], lambda x: x IS NOT NULL)) AS rule FROM c",
    "occurrence_rules": f"WITH {_L} SELECT l_partkey AS path, count(*) AS n FROM l WHERE l_quantity >= 40 AND nxt IS NOT NULL AND l_partkey <> nxt AND nxt % 9 = 0 GROUP BY 1",
}
