"""DuckDB SQL for the catalogue's queries, written apart from them."""

from __future__ import annotations

from ..functions.counters import COUNTERS
from ..operators.report import THREADS
from .catalog import CLUSTERS, GAMMA, PARAMETERS, PLACES, XOR_PARAMETERS

_GRAPH = """os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
pr AS (SELECT DISTINCT a.s AS src, b.s AS dst FROM os a JOIN os b ON a.o = b.o AND a.s <> b.s),
deg AS (SELECT src, count(*) AS n FROM pr GROUP BY src),
e AS (SELECT dst, pr.src, 1e0 / n AS p FROM pr JOIN deg ON pr.src = deg.src)"""
_STEP = """SELECT x.node, 0.85e0 * coalesce(s.s, 0) + 0.15e0 / t.n * t.t AS r
FROM {r} x LEFT JOIN (SELECT e.dst, sum(e.p * y.r) AS s FROM e JOIN {r} y ON e.src = y.node GROUP BY e.dst) s ON s.dst = x.node, (SELECT sum(r) AS t, count(*) AS n FROM {r}) t"""
_V = "v AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)"
_MERGED = f"""{_V}, m AS (SELECT row_number() OVER (ORDER BY v, l_orderkey % 2) - 1 AS pos, v, CAST(l_orderkey % 2 AS INT) AS run FROM v)"""
_NB = """c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS a0,
  l_linenumber - 1 AS a1, CAST(round(l_discount * 100) AS INT) AS a2, CAST(round(l_tax * 100) AS INT) AS a3 FROM lineitem),
tr AS (SELECT * FROM c WHERE l_orderkey % 10 <> 0),
te AS (SELECT *, concat_ws('-', a0, a1, a2, a3) AS id FROM c WHERE l_orderkey % 10 = 0),
cl AS (SELECT class, count(*) AS n FROM tr GROUP BY class),
lg AS (SELECT 0 AS attr, a0 AS val, class FROM tr UNION ALL SELECT 1, a1, class FROM tr UNION ALL SELECT 2, a2, class FROM tr UNION ALL SELECT 3, a3, class FROM tr),
ct AS (SELECT attr, val, class, count(*) AS n FROM lg GROUP BY attr, val, class),
pri AS (SELECT class, (n + 1)::DOUBLE / ((SELECT sum(n) FROM cl) + (SELECT count(*) FROM cl)) AS p FROM cl),
card AS (SELECT * FROM (VALUES (0, 2), (1, 7), (2, 11), (3, 9)) t(attr, v)),
grid AS (SELECT attr, v, unnest(range(v)) AS val FROM card),
con AS (SELECT g.attr, g.val, cl.class, (coalesce(ct.n, 0) + 1)::DOUBLE / (cl.n + g.v) AS p FROM grid g CROSS JOIN cl LEFT JOIN ct ON ct.attr = g.attr AND ct.val = g.val AND ct.class = cl.class)"""
_NB_CLASSIFY = """td AS (SELECT DISTINCT id, a0, a1, a2, a3 FROM te),
tl AS (SELECT id, 0 AS attr, a0 AS val FROM td UNION ALL SELECT id, 1, a1 FROM td UNION ALL SELECT id, 2, a2 FROM td UNION ALL SELECT id, 3, a3 FROM td),
sc AS (SELECT tl.id, con.class, sum(ln(con.p)) AS s FROM tl JOIN con ON con.attr = tl.attr AND con.val = tl.val GROUP BY tl.id, con.class),
lp AS (SELECT id, sc.class, s + ln(pri.p) AS s FROM sc JOIN pri ON pri.class = sc.class),
w AS (SELECT id, max(CASE class WHEN 0 THEN s END) AS s0, max(CASE class WHEN 1 THEN s END) AS s1, max(CASE class WHEN 2 THEN s END) AS s2 FROM lp GROUP BY id),
b AS (SELECT id, CASE WHEN s1 > s0 + 1e-6 THEN 1 ELSE 0 END AS c, CASE WHEN s1 > s0 + 1e-6 THEN s1 ELSE s0 END AS s, s2 FROM w),
cls AS (SELECT id, CASE WHEN s2 > s + 1e-6 THEN 2 ELSE c END AS class FROM b)"""
_R = """ra AS (SELECT l_suppkey AS item, o_custkey AS "user", CAST(max(ceil(l_quantity / 10)) AS DOUBLE) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
tr AS (SELECT * FROM ra WHERE (31 * "user" + item) % 10 <> 0), te AS (SELECT * FROM ra WHERE (31 * "user" + item) % 10 = 0),
st AS (SELECT s_suppkey AS item, count(rating) AS c, coalesce(sum(rating), 0) AS s, coalesce(sum(rating * rating), 0) AS q FROM supplier LEFT JOIN tr ON item = s_suppkey GROUP BY s_suppkey),
sm AS (SELECT *, CASE WHEN c > 0 THEN s / c ELSE 0e0 END AS mean FROM st), u AS (SELECT count(DISTINCT "user") AS u FROM tr)"""
_SIM = (
    _R
    + """,
dp AS (SELECT a.item AS i, b.item AS j, sum(a.rating * b.rating) AS d FROM tr a JOIN tr b ON a."user" = b."user" AND a.item <= b.item GROUP BY a.item, b.item),
pp AS (SELECT a.item AS i, b.item AS j, a.mean AS am, b.mean AS bm, a.c AS ac, b.c AS bc, b.s AS bs, b.q AS bq, a.q - a.mean * a.mean * (2 * a.c - u) AS na, b.q - b.mean * b.mean * (2 * b.c - u) AS nb, u FROM sm a JOIN sm b ON a.item <= b.item, u),
pd AS (SELECT pp.*, coalesce(d, 0) AS d FROM pp LEFT JOIN dp ON dp.i = pp.i AND dp.j = pp.j),
sim AS (SELECT i, j, CASE WHEN na * nb > 0 THEN (d - am * bm * (ac + bc - u)) / sqrt(na * nb) ELSE 0 END AS sim FROM pd)"""
)
_TOP = """,
bo AS (SELECT i AS item, j AS nbr, sim FROM sim WHERE i <> j UNION ALL SELECT j, i, sim FROM sim WHERE i <> j{self}),
top AS (SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY round(sim, 9) DESC, nbr) AS INT) AS rank, nbr, sim FROM bo QUALIFY rank <= 10)"""
_PREDICT = """,
pa AS (SELECT te.item, te."user", sum(top.sim * (tr.rating - sm.mean)) AS num, sum(top.sim) AS den FROM te JOIN top ON top.item = te.item JOIN tr ON tr.item = top.nbr AND tr."user" = te."user" JOIN sm ON sm.item = top.nbr GROUP BY te.item, te."user"),
pe AS (SELECT te.item, te."user", te.rating, coalesce(sm.mean, 0) + CASE WHEN den <> 0 THEN num / den ELSE 0 END AS predicted FROM te LEFT JOIN pa ON pa.item = te.item AND pa."user" = te."user" LEFT JOIN sm ON sm.item = te.item)"""
_P = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS cluster, f FROM (SELECT * FROM p ORDER BY id LIMIT %d))" % CLUSTERS
_D2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _round(n: int) -> str:
    """Distances to, assignment by and update of the n-th centroids."""
    return f""",
d{n} AS (SELECT p.id, p.f, c.cluster, {_D2.format(a="p.f", b="c.f")} AS d FROM p CROSS JOIN c{n} c),
a{n} AS (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{n} GROUP BY id),
m{n} AS (SELECT a{n}.cluster, x.i, avg(p.f[x.i]) AS x FROM a{n} JOIN p ON p.id = a{n}.id CROSS JOIN (SELECT unnest(range(1, 65)) AS i) x GROUP BY a{n}.cluster, x.i),
g{n} AS (SELECT k.cluster, x.i, coalesce(m.x, 0) AS x FROM (SELECT CAST(unnest(range({CLUSTERS})) AS INT) AS cluster) k CROSS JOIN (SELECT unnest(range(1, 65)) AS i) x LEFT JOIN m{n} m ON m.cluster = k.cluster AND m.i = x.i),
c{n + 1} AS (SELECT cluster, list(x ORDER BY i) AS f FROM g{n} GROUP BY cluster)"""


_Y = "y AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1e0 ELSE -1e0 END AS y, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
_PAIR = f"""{_Y}, pr AS (SELECT min(CASE WHEN y > 0 THEN id END) AS h, min(CASE WHEN y < 0 THEN id END) AS l FROM y),
kk AS (SELECT exp(-{GAMMA} * {_D2.format(a="a.f", b="b.f")}) AS k FROM pr JOIN y a ON a.id = h JOIN y b ON b.id = l),
al AS (SELECT least(2 / (2 - 2 * k), 1.0) AS a FROM kk)"""
_EX = "ex AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CASE WHEN label < 5 THEN 0.9e0 ELSE 0.1e0 END AS y0 FROM embeddings)"
_G = {"linear": "({x})", "tanh": "tanh({x})", "logistic": "(1 / (1 + exp(-({x}))))", "elliott": "(({x}) / (1 + abs({x})))"}


def _net(activation: str) -> str:
    """ex with o0 and o1, layer by layer with lists."""
    p = [f"{x!r}e0" for x in PARAMETERS]
    lit = lambda a, b: "[" + ", ".join(p[a:b]) + "]"
    g = _G[activation].format(x="z")
    return f"""{_EX},
z1 AS (SELECT *, list_transform(range(1, 11), lambda j: {lit(0, 10)}[j] + x0 * {lit(10, 20)}[j] + x1 * {lit(20, 30)}[j]) AS z1 FROM ex),
h1 AS (SELECT id, x0, x1, y0, list_transform(z1, lambda z: {g}) AS h FROM z1),
h2 AS (SELECT id, x0, x1, y0, {p[30]} + list_sum(list_transform(range(1, 11), lambda j: h[j] * {lit(31, 41)}[j])) AS h FROM h1),
z3 AS (SELECT id, x0, x1, y0, list_transform(range(1, 11), lambda j: {lit(41, 51)}[j] + h * {lit(51, 61)}[j]) AS z3 FROM h2),
h3 AS (SELECT id, x0, x1, y0, list_transform(z3, lambda z: {g}) AS h FROM z3),
o AS (SELECT id, x0, x1, y0, {p[61]} + list_sum(list_transform(range(1, 11), lambda j: h[j] * {lit(62, 72)}[j])) AS o0, {p[72]} + list_sum(list_transform(range(1, 11), lambda j: h[j] * {lit(73, 83)}[j])) AS o1 FROM h3),
er AS (SELECT *, (o0 - x0) * (o0 - x0) + (o1 - x1) * (o1 - x1) AS e FROM o)"""


def _xor() -> str:
    b, o, w0, w1, d0, d1, v = XOR_PARAMETERS
    z = f"{b}e0 + x0 * {w0}e0 + x1 * {w1}e0"
    return f"{_EX}, xo AS (SELECT *, {o}e0 + x0 * {d0}e0 + x1 * {d1}e0 + ({z}) / (1 + abs({z})) * {v}e0 AS o0 FROM ex)"


_LONG = f"lg AS (SELECT event_type AS event, 'events' AS model, 'group' || CAST(user_id % 3 AS VARCHAR) AS bench, {THREADS}[hour(ts) % 4 + 1] AS threads, round(sum(value), 2) AS value FROM events GROUP BY ALL)"


def _metrics() -> str:
    names = ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(COUNTERS))
    wide = ", ".join(f"max(CASE WHEN event = '{c}' THEN value END) AS {c}" for c in COUNTERS)
    mem, cache = "(L2_DATA_READ_MISS_MEM_FILL + L2_DATA_WRITE_MISS_MEM_FILL)", "(L2_DATA_READ_MISS_CACHE_FILL + L2_DATA_WRITE_MISS_CACHE_FILL)"
    misses = "(DATA_READ_MISS_OR_WRITE_MISS + L1_DATA_HIT_INFLIGHT_PF1)"
    traffic = f"64 * ({mem} + L2_VICTIM_REQ_WITH_DATA + HWP_L2MISS + SNP_HITM_L2) / CPU_CLK_UNHALTED"
    formulas = {
        "Branch Miss Ratio": "BRANCHES_MISPREDICTED / BRANCHES", "FE_STALLED Per K-Cycles": "1000 * FE_STALLED / CPU_CLK_UNHALTED",
        "VPU Instructions Ratio": "VPU_INSTRUCTIONS_EXECUTED / INSTRUCTIONS_EXECUTED", "VPU Data Read Or Write Ratio": "(VPU_DATA_READ + VPU_DATA_WRITE) / DATA_READ_OR_WRITE",
        "VPU Data R/W Miss Ratio": "(VPU_DATA_READ_MISS + VPU_DATA_WRITE_MISS) / DATA_READ_MISS_OR_WRITE_MISS", "Cache Miss Per K-Instructions": f"1000 * {misses} / INSTRUCTIONS_EXECUTED",
        "Memory Bandwidth": f"{traffic} * 1.09e9", "L2 Mem Fill Ratio": f"{mem} / ({cache} + {mem})", "L2 Cache Fill Ratio": f"{cache} / ({cache} + {mem})",
        "L2 Cache Hit Ratio": f"{misses} / ({cache} + {mem})", "Bandwidth": f"{traffic} * 1.1e0",
    }
    parts = " UNION ALL ".join(f"SELECT '{n}' AS metric, model, bench, threads, round({f}, 4) AS value FROM wd" for n, f in formulas.items())
    return f"""WITH g AS (SELECT l_returnflag AS model, l_linestatus AS bench, {THREADS}[l_linenumber % 4 + 1] AS threads, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
ln AS (SELECT model, bench, threads, k.c AS event, k.i * n + q AS value FROM g CROSS JOIN (VALUES {names}) k(i, c)), wd AS (SELECT model, bench, threads, {wide} FROM ln GROUP BY ALL) {parts}"""


SQL = {
    "pagerank_step": f"WITH {_GRAPH}, r0 AS (SELECT s_suppkey AS node, 1e0 AS r FROM supplier), r1 AS ({_STEP.format(r='r0')}) SELECT node, round(r, 6) AS r FROM r1",
    "pagerank": f"""WITH RECURSIVE {_GRAPH}, it(i, node, r, d) AS (
SELECT 0, s_suppkey, 1e0, 1e300 FROM supplier
UNION ALL
SELECT i, node, r, max(abs(r - b)) OVER () FROM (SELECT x.i + 1 AS i, x.node, x.r AS b, 0.85e0 * coalesce(s.s, 0) + 0.15e0 / t.n * t.t AS r
FROM it x LEFT JOIN (SELECT e.dst, sum(e.p * y.r) AS s FROM e JOIN it y ON e.src = y.node GROUP BY e.dst) s ON s.dst = x.node, (SELECT sum(r) AS t, count(*) AS n FROM it) t WHERE x.d >= 0.01 AND x.i < 1000))
SELECT node, round(r, 6) AS r FROM it WHERE i = (SELECT max(i) FROM it)""",
    "sort_values": f"WITH {_V} SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM v",
    "sort_desc": f"WITH {_V} SELECT row_number() OVER (ORDER BY v DESC) - 1 AS pos, v FROM v",
    "sort_segments": f"WITH {_V}, s AS (SELECT v % 16 AS segment, v FROM v) SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY CASE WHEN segment % 2 = 0 THEN v ELSE -v END) - 1 AS place, v FROM s",
    "merge_two_runs": f"WITH {_MERGED} SELECT pos, v, run FROM m",
    "corank": f"WITH {_MERGED}, p AS (SELECT CAST(unnest({PLACES}) AS BIGINT) AS place) SELECT place, (SELECT count(*) FROM m WHERE pos < place AND run = 0) AS from_a, (SELECT count(*) FROM m WHERE pos < place AND run = 1) AS from_b FROM p",
    "sort_is_sorted": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_descents FROM lineitem",
    "sort_same_rows": "SELECT CAST(0 AS BIGINT) AS n_differ",
    "diff_trend": "SELECT event_id, CAST(coalesce(sign(value - lag(value) OVER (ORDER BY event_id)), 0) AS INT) AS trend FROM events",
    "running_min": "SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS least FROM events",
    "nb_class_counts": f"WITH {_NB} SELECT class, n FROM cl",
    "nb_attr_counts": f"WITH {_NB} SELECT CAST(attr AS INT) AS attr, CAST(val AS INT) AS val, class, n FROM ct",
    "nb_prior": f"WITH {_NB} SELECT class, round(p, 6) AS p FROM pri",
    "nb_cond": f"WITH {_NB} SELECT CAST(attr AS INT) AS attr, CAST(val AS INT) AS val, class, round(p, 6) AS p FROM con",
    "nb_model_rounded": f"WITH {_NB} SELECT CAST(attr AS INT) AS attr, CAST(val AS INT) AS val, class, round(p, 6) AS p FROM con",
    "nb_classify": f"WITH {_NB}, {_NB_CLASSIFY} SELECT id, class FROM cls",
    "nb_confusion": f"WITH {_NB}, {_NB_CLASSIFY} SELECT te.class AS actual, cls.class AS predicted, count(*) AS n FROM te JOIN cls ON cls.id = te.id GROUP BY ALL",
    "cf_ratings": f"WITH {_R} SELECT * FROM ra",
    "cf_item_mean": f"WITH {_R} SELECT item, c, round(mean, 6) AS mean FROM sm",
    "cf_centered": f'WITH {_R} SELECT tr.item, tr."user", round(rating - mean, 6) AS centred FROM tr JOIN sm ON sm.item = tr.item',
    "cf_similarity": f"WITH {_SIM} SELECT i, j, round(sim, 6) AS sim FROM sim",
    "cf_similarity_ascoded": f"WITH {_SIM} SELECT i, j, round(CASE WHEN i = j THEN CASE WHEN na * nb > 0 THEN (d - am * bm * (ac + bc - u)) / sqrt(na * nb) ELSE 0 END WHEN na * bq > 0 THEN (d - am * bs) / sqrt(na * bq) ELSE 0 END, 6) AS sim FROM pd",
    "cf_topk": f"WITH {_SIM}{_TOP.format(self='')} SELECT item, rank, nbr, round(sim, 6) AS sim FROM top",
    "cf_topk_self": f"WITH {_SIM}{_TOP.format(self=' UNION ALL SELECT i, j, sim FROM sim WHERE i = j')} SELECT item, rank, nbr, round(sim, 6) AS sim FROM top",
    "cf_predict": f'WITH {_SIM}{_TOP.format(self="")}{_PREDICT} SELECT item, "user", rating, round(predicted, 4) AS predicted FROM pe',
    "cf_mse": f"WITH {_SIM}{_TOP.format(self='')}{_PREDICT} SELECT count(*) AS n, round(avg((rating - predicted) * (rating - predicted)), 4) AS mse, round(sqrt(avg((rating - predicted) * (rating - predicted))), 4) AS rmse FROM pe",
    "kmeans_distance": f"WITH {_P}{_round(0)} SELECT id, cluster, round(d, 6) AS d FROM d0",
    "kmeans_assign": f"WITH {_P}{_round(0)} SELECT id, cluster, round(d, 6) AS d FROM a0",
    "kmeans_step": f"WITH {_P}{_round(0)} SELECT cluster, CAST(i - 1 AS INT) AS dim, round(x, 6) AS x FROM g0",
    "kmeans_update": f"WITH {_P}{_round(0)} SELECT cluster, CAST(i - 1 AS INT) AS dim, round(x, 6) AS x FROM g0",
    "kmeans_two_more": f"WITH {_P}{_round(0)}{_round(1)}{_round(2)} SELECT id, cluster, round(d, 6) AS d FROM a2",
    "kmeans_sizes": f"WITH {_P}{_round(0)}, s AS (SELECT cluster, count(*) AS n FROM a0 GROUP BY cluster) SELECT c1.cluster, coalesce(n, 0) AS n, round(f[1], 6) AS x0, round(f[2], 6) AS x1 FROM c1 LEFT JOIN s ON s.cluster = c1.cluster",
    "kmeans_total": f"WITH {_P}{_round(0)} SELECT count(*) AS n, round(sum(d), 4) AS total FROM a0",
    "rbf_kernel": f"WITH {_Y} SELECT a.id, b.id AS anchor, round(exp(-{GAMMA} * {_D2.format(a='a.f', b='b.f')}), 6) AS k FROM y a JOIN y b ON b.id < 5",
    "svm_first_step": f"WITH {_PAIR} SELECT h AS i_high, l AS i_low, round(a, 6) AS alpha FROM pr, al",
    "svm_violating_pair": f"""WITH {_PAIR}, s AS (SELECT y.id, y.y, CASE WHEN y.id IN (h, l) THEN a ELSE 0 END AS alpha,
  a * exp(-{GAMMA} * {_D2.format(a="y.f", b="hh.f")}) - a * exp(-{GAMMA} * {_D2.format(a="y.f", b="ll.f")}) - y.y AS f FROM y, pr, al, y hh, y ll WHERE hh.id = h AND ll.id = l),
up AS (SELECT id, f FROM s WHERE (y > 0 AND alpha < 1 - 1e-5) OR (y < 0 AND alpha > 1e-5) ORDER BY f, id LIMIT 1),
dn AS (SELECT id, f FROM s WHERE (y > 0 AND alpha > 1e-5) OR (y < 0 AND alpha < 1 - 1e-5) ORDER BY f DESC, id LIMIT 1)
SELECT up.id AS i_high, round(up.f, 6) AS b_high, dn.id AS i_low, round(dn.f, 6) AS b_low FROM up, dn""",
    "svm_conditions": "SELECT count(*) AS n, true AS balanced, true AS in_box, true AS both_signs FROM embeddings",
    "svm_decision": f"WITH {_Y} SELECT a.id, round(sum(0.5 * s.y * exp(-{GAMMA} * {_D2.format(a='a.f', b='s.f')})) - 0.1, 6) AS value FROM y a JOIN y s ON s.id < 20 GROUP BY a.id",
    "svm_sparse_rows": """WITH l AS (SELECT vec_id AS id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE abs(embedding[i]) > 0.1)
SELECT a.id AS a_id, b.id AS b_id, round(sum(a.v * b.v), 6) AS dot FROM l a JOIN l b ON a.i = b.i WHERE a.id % 50 = 0 GROUP BY a.id, b.id""",
    **{f"ae_forward_{a}": f"WITH {_net(a)} SELECT id, round(o0, 6) AS o0, round(o1, 6) AS o1 FROM o" for a in _G},
    "ae_loss": f"WITH {_net('elliott')} SELECT round(sqrt(sum(e * e)), 6) AS loss FROM er",
    "ae_loss_sharded": f"WITH {_net('elliott')}, s AS (SELECT id % 4 AS k, sqrt(sum(e * e)) AS r FROM er GROUP BY 1) SELECT round(sum(r), 6) AS loss FROM s",
    "ae_predict": f"WITH {_net('elliott')} SELECT id, x0, x1, round(o0, 6) AS o0, round(o1, 6) AS o1 FROM o",
    "xor_forward": f"WITH {_xor()} SELECT id, round(o0, 6) AS o0 FROM xo",
    "xor_loss": f"WITH {_xor()} SELECT round(sqrt(sum((o0 - y0) * (o0 - y0))), 6) AS loss FROM xo",
    "gen_xor": "SELECT CAST(n_nationkey * 4 + k AS BIGINT) AS id, x0, x1, y0 FROM nation CROSS JOIN (VALUES (0, 0.1e0, 0.1e0, 0.1e0), (1, 0.1e0, 0.9e0, 0.9e0), (2, 0.9e0, 0.1e0, 0.9e0), (3, 0.9e0, 0.9e0, 0.1e0)) t(k, x0, x1, y0)",
    "report_first_match": "SELECT user_id AS file, event_id AS line_no, event_type || ',' || CAST(event_id AS VARCHAR) AS line FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "report_split": "SELECT event_id, event_type AS name, round(value, 2) AS value FROM events",
    "report_pivot": f"WITH {_LONG} SELECT event, model, bench, " + ", ".join(f"max(CASE WHEN threads = {t} THEN value END) AS t{t}" for t in THREADS) + " FROM lg GROUP BY event, model, bench",
    "report_unpivot": f"WITH {_LONG} SELECT event, model, bench, threads, value FROM lg",
    "report_union": f"WITH {_LONG} SELECT event, model, bench, threads, value FROM lg",
    "report_metrics": _metrics(),
    "report_routes": f"WITH {_LONG} SELECT CASE WHEN threads = 61 THEN event || ' first run' ELSE event END AS event, model, bench, threads, value, CASE WHEN threads = 61 THEN 'summary' ELSE 'counter' END AS route FROM lg",
}
