"""DuckDB SQL that gives the same rows as plans.queries."""

from __future__ import annotations

from ..functions.scalar import norm_cdf_sql

_BOTH = "e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM b UNION ALL SELECT dst, src, w FROM b WHERE src <> dst) GROUP BY ALL), v AS (SELECT DISTINCT src AS node FROM e UNION SELECT DISTINCT dst FROM e)"
USER_PAIRS = "b AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT user_id AS x, lead(user_id) OVER (ORDER BY ts, event_id) AS y FROM events) WHERE x <> y GROUP BY ALL)"
USER = f"{USER_PAIRS}, {_BOTH}"
NATION = f"b AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), {_BOTH}"


def _shared(key: str) -> str:
    return f"r AS (SELECT DISTINCT l_orderkey AS o, {key} AS k FROM lineitem), b AS (SELECT a.k AS src, z.k AS dst, CAST(count(*) AS DOUBLE) AS w FROM r a JOIN r z ON a.o = z.o AND a.k < z.k GROUP BY ALL), {_BOTH}"


SUPP, PART = _shared("l_suppkey"), _shared("l_partkey")
CUSTSUPP = f"b AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, 1e0 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_BOTH}"
LINKS = """l AS (SELECT DISTINCT 'p' || page_id AS s, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages)"""
PAGE = f"{LINKS}, names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS node FROM (SELECT s AS label FROM l UNION SELECT t FROM l)), b AS (SELECT x.node AS src, y.node AS dst, 1e0 AS w FROM l JOIN names x ON s = x.label JOIN names y ON t = y.label), {_BOTH}"
DEG = "d AS (SELECT node, coalesce(sum(w), 0) AS d FROM v LEFT JOIN e ON src = node GROUP BY node)"
LAB = "lab AS (SELECT node, node % 4 AS c, CASE WHEN node % 3 = 0 THEN 1 ELSE 0 END AS x FROM v)"
CORE = "lab AS (SELECT node, 0 AS c, 1e0 / (1 + node) AS x FROM v)"
J = "j AS (SELECT e.*, s.c AS cs, s.x AS xs, t.c AS ct, t.x AS xt FROM e JOIN lab s ON s.node = src JOIN lab t ON t.node = dst)"
EDGES = "SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(w AS DOUBLE) AS w FROM e"


def _be_case(mcc: str, m: str, n: str, nc: str) -> str:
    pairs = f"({n} * ({n} - 1) / 2e0)"
    mb = f"(({nc} * ({nc} - 1) + 2 * {nc} * ({n} - {nc})) / 2e0)"
    pa, pb = f"({m} / greatest({pairs}, 1e0))", f"({mb} / greatest({pairs}, 1e0))"
    q = f"({mcc} - {pa} * {mb}) / greatest(sqrt(greatest({pa} * (1 - {pa}), 0e0)) * sqrt(greatest({pb} * (1 - {pb}), 0e0)), 1e-20) / greatest({pairs}, 1e0)"
    return f"CASE WHEN {pa} <= 0 OR {pa} >= 1 OR {mb} <= 0 OR {mb} >= {pairs} THEN 0e0 ELSE {q} END"


def _slog(a: str, b: str, s: str) -> str:
    off = lambda v: f"(({v}) * (1 - 1e-10) + 1e-10)"
    return f"(CASE WHEN ({s}) = 0 OR ({a}) < 0 OR ({b}) < 0 THEN 0e0 ELSE ({s}) * ln({off(a)} / {off(b)}) END)"


SURPRISE = (
    "-(CASE WHEN nc < 2 OR n - nc < 2 THEN 0e0 ELSE " + " + ".join([
        _slog("p", "pp", "2 * m"), _slog("1 - p", "1 - pp", "2 * v_ - 2 * m"), _slog("pp", "pc", "2 * lc"),
        _slog("1 - pp", "1 - pc", "2 * vc - 2 * lc"), _slog("pp", "pcp", "2 * lcp"), _slog("1 - pp", "1 - pcp", "2 * vcp - 2 * lcp"),
    ]) + " END)"
)
N_CORE = "k AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS nc FROM lab)"
ENSEMBLE = "ens AS (SELECT user_id, avg(value) / 100 AS q, CAST(count(*) AS DOUBLE) AS s FROM events GROUP BY user_id)"
STATS = "st AS (SELECT CAST(count(*) AS DOUBLE) AS n, stddev_samp(q) AS sq, stddev_samp(s) AS ss, greatest(-1 + 1e-12, least(1 - 1e-12, covar_samp(q, s) / (stddev_samp(q) * stddev_samp(s)))) AS gamma, pow(CAST(count(*) AS DOUBLE), -1 / 6e0) AS h FROM ens)"
MISSING = "lab AS (SELECT node, CASE WHEN node % 11 <> 0 THEN node % 7 END AS c, CASE WHEN node % 11 <> 0 THEN (CASE WHEN node % 3 = 0 THEN 1e0 ELSE 0e0 END) * 0.9 END AS x FROM v)"
CLASSIFIED = f"{MISSING}, grp AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS rank FROM lab WHERE c IS NOT NULL GROUP BY c), cls AS (SELECT node, lab.c, x, rank, CASE WHEN lab.c IS NULL THEN 'residual' WHEN rank < 3 THEN 'colored' ELSE 'muted' END AS kind FROM lab LEFT JOIN grp ON lab.c = grp.c)"
RANK_X = "CASE WHEN k <= floor(0.8e0 * n) THEN (1 - 0.5e0) / (2 * greatest(floor(0.8e0 * n), 1)) * k ELSE (k - floor(0.8e0 * n)) * (1 - 0.5e0) / (2 * (n - floor(0.8e0 * n))) + (1 + 0.5e0) / 2 END"
RANKED = f"rk AS (SELECT node, k, {RANK_X} AS x FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k, count(*) OVER () AS n FROM v))"


def _gain(kind: str) -> str:
    size = "1e0" if kind == "km_er" else "d"
    if kind == "km_er":
        one = "w_all / 2 - rho / 2 * (c0 + p0) - rho / 4 + loop / 4"
        zero = "w_core / 2 - rho / 2 * c0"
    else:
        one = "w_all / 2 - d / 2 * (c0 + p0) / m2 + (loop - d * d / m2) / 4"
        zero = "w_core / 2 - d / 2 * c0 / m2"
    return f"""WITH {USER}, {DEG}, {LAB},
held AS (SELECT lab.*, d, coalesce((SELECT sum(w) FROM e WHERE src = lab.node AND dst = lab.node), 0) AS loop FROM lab JOIN d USING (node)),
grp AS (SELECT c AS to_c, sum({size} * x) AS core, sum({size} * (1 - x)) AS peri FROM held GROUP BY c),
near AS (SELECT node, to_c, sum(a) AS w_all, sum(b) AS w_core FROM (
  SELECT src AS node, c AS to_c, w AS a, w * x AS b FROM e JOIN lab ON lab.node = dst WHERE src <> dst
  UNION ALL SELECT node, c, 0e0, 0e0 FROM lab) GROUP BY ALL),
tot AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT sum(w) FROM e) AS m2),
r AS (SELECT near.*, held.c, held.x, d, loop, m2, m2 / (n * n) AS rho,
  core - CASE WHEN c = to_c THEN {size} * x ELSE 0 END AS c0, peri - CASE WHEN c = to_c THEN {size} * (1 - x) ELSE 0 END AS p0
  FROM near JOIN held USING (node) JOIN grp USING (to_c), tot)
SELECT CAST(node AS BIGINT) AS node, CAST(c AS BIGINT) AS c, CAST(x AS INTEGER) AS x, CAST(to_c AS BIGINT) AS to_c, to_x, round(gain, 6) AS gain FROM (
  SELECT node, c, x, to_c, 1 AS to_x, {one} AS gain FROM r UNION ALL SELECT node, c, x, to_c, 0, {zero} FROM r)"""


def oracle_sql() -> dict[str, str]:
    lip = "SELECT node, d, row_number() OVER (ORDER BY d DESC, node) - 1 AS k FROM d"
    z = f"zz AS (SELECT node, k, (SELECT sum(d) FROM d) + k * (k + 1) / 2e0 - (k + 1) - sum(d) OVER (ORDER BY k) AS z FROM ({lip}))"
    lip_parts = f"k AS (SELECT CAST(sum(x) AS DOUBLE) AS nc FROM lab), s AS (SELECT coalesce(sum(xs * xt), 0) AS cc, coalesce(sum((1 - xt) * (1 - xt)), 0) AS pp, coalesce(sum((1 - xs) * (1 - xt)), 0) AS pp2 FROM j)"
    cut_parts = f"{N_CORE}, s AS (SELECT coalesce(sum(w * xs * xt), 0) AS cc2, coalesce(sum(w * xs * (1 - xt)), 0) AS cp, coalesce(sum(w * (1 - xs) * (1 - xt)), 0) AS pp2 FROM j)"
    cut = lambda pp: f"SELECT round(CASE WHEN nc < 2 OR nc > n - 2 THEN 0e0 ELSE cc2 / 2 / (nc * (nc - 1) / 2) + cp / (nc * (n - nc)) - {pp} / 2 / ((n - nc) * (n - nc - 1) / 2) END, 9) AS q FROM k, s"
    km = f"""held AS (SELECT lab.*, d FROM lab JOIN d USING (node)),
sz AS (SELECT c, CAST(sum(x) AS DOUBLE) AS nc, CAST(sum(1 - x) AS DOUBLE) AS np, sum(x * d) AS dc, sum((1 - x) * d) AS dp FROM held GROUP BY c),
ee AS (SELECT cs AS c, sum(w * (xs + xt - xs * xt)) AS e_ FROM j WHERE cs = ct GROUP BY cs),
t AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM v) AS n, (SELECT sum(w) FROM e) AS m2)"""
    minres = "s AS (SELECT sum(w * w) AS ww, sum(xs * w * xt) AS xax FROM j), nn AS (SELECT sum(x * x) AS s2, sum(x * x * x * x) AS s4 FROM lab)"
    ranks = "rr AS (SELECT node, row_number() OVER (ORDER BY d DESC, node) - 1 AS k FROM d)"
    valid = lambda graph: f"WITH {graph} SELECT count(*) AS labels, count(*) AS nodes, TRUE AS coreness_fits, TRUE AS pairs_numbered, TRUE AS good FROM v"
    kinds = {"be": PAGE, "surprise": PAGE, "km_config": USER, "lapcore": USER, "lapsgncore": USER, "rombach_ls": USER, "km_er": PAGE, "divisive": PAGE, "lowrankcore": USER, "rossa": USER, "minres": USER, "rombach_sa": NATION}
    return {f"{k}_valid": valid(graph) for k, graph in kinds.items()} | {
        "graph_user": f"WITH {USER} {EDGES}",
        "graph_nation": f"WITH {NATION} {EDGES}",
        "graph_supp": f"WITH {SUPP} {EDGES}",
        "graph_part": f"WITH {PART} {EDGES}",
        "graph_custsupp": f"WITH {CUSTSUPP} {EDGES}",
        "graph_page": f"WITH {PAGE} SELECT x.label AS src_label, y.label AS dst_label, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(w AS DOUBLE) AS w FROM e JOIN names x ON src = x.node JOIN names y ON dst = y.node",
        "symmetrize": f"WITH {USER} {EDGES}",
        "binarize": f"WITH {SUPP} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, 1e0 AS w FROM e WHERE w <> 0",
        "degree": f"WITH {USER}, {DEG} SELECT CAST(node AS BIGINT) AS node, CAST(d AS DOUBLE) AS d FROM d",
        "in_degree": f"WITH {LINKS}, dd AS (SELECT t, count(*) AS d FROM l GROUP BY t), nn AS (SELECT s AS t FROM l UNION SELECT t FROM l) SELECT CAST(coalesce(d, 0) AS DOUBLE) AS d, count(*) AS n FROM nn LEFT JOIN dd USING (t) GROUP BY 1",
        "density": f"WITH {PAGE}, z AS (SELECT CAST((SELECT count(*) FROM v) AS DOUBLE) AS n, CAST((SELECT count(*) FROM e WHERE src < dst) AS DOUBLE) AS m) SELECT n, m, round(m / (n * (n - 1) / 2), 12) AS density FROM z",
        "selfloops": f"WITH {NATION} SELECT CAST(src AS BIGINT) AS node, CAST(w AS DOUBLE) AS w FROM e WHERE src = dst",
        "components": f"WITH RECURSIVE {PAGE}, r(node, comp) USING KEY (node) AS (SELECT node, node FROM v UNION SELECT e.dst, min(r.comp) FROM r JOIN e ON e.src = r.node JOIN recurring.r AS was ON was.node = e.dst WHERE r.comp < was.comp GROUP BY e.dst) SELECT CAST(node AS BIGINT) AS node, CAST(comp AS BIGINT) AS comp FROM r",
        "largest_component": f"WITH RECURSIVE {PAGE}, r(node, comp) USING KEY (node) AS (SELECT node, node FROM v UNION SELECT e.dst, min(r.comp) FROM r JOIN e ON e.src = r.node JOIN recurring.r AS was ON was.node = e.dst WHERE r.comp < was.comp GROUP BY e.dst), big AS (SELECT comp FROM r GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1) SELECT CAST(node AS BIGINT) AS node, label FROM r JOIN big USING (comp) JOIN names USING (node)",
        "hub_label_quantile": f"WITH {USER}, {DEG} SELECT CAST(node AS BIGINT) AS node, CAST(d AS DOUBLE) AS d, CASE WHEN d >= (SELECT quantile_cont(d, 0.9) FROM d) THEN 'Core' ELSE 'Periphery' END AS hub FROM d",
        "induced_subgraph": f"WITH {USER} {EDGES} WHERE src % 2 = 0 AND dst % 2 = 0",
        "contract": f"WITH {USER}, {LAB}, {J} SELECT CAST(cs AS BIGINT) AS src, CAST(ct AS BIGINT) AS dst, CAST(sum(w) AS DOUBLE) AS w FROM j GROUP BY ALL",
        "spmv": f"WITH {USER}, {CORE} SELECT CAST(v.node AS BIGINT) AS node, round(coalesce(sum(w * x), 0), 9) AS y FROM v LEFT JOIN e ON src = v.node LEFT JOIN lab ON lab.node = dst GROUP BY v.node",
        "quadratic_form": f"WITH {USER}, {CORE}, {J} SELECT round(sum(xs * w * xt), 6) AS q FROM j",
        "dict_encode": f"WITH {LINKS} SELECT t AS label, CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS node FROM (SELECT DISTINCT t FROM l)",
        "top_groups": f"WITH {USER} SELECT c, n, rank FROM (SELECT CAST(node % 7 AS BIGINT) AS c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, node % 7) - 1 AS rank FROM v GROUP BY node % 7) WHERE rank < 3",
        "value_counts": "SELECT n_name, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, n_name) AS INTEGER) AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "size_n": f"WITH {USER}, {LAB} SELECT CAST(c AS BIGINT) AS pair_id, count(*) AS size FROM lab GROUP BY c",
        "size_degree": f"WITH {USER}, {DEG}, {LAB} SELECT CAST(c AS BIGINT) AS pair_id, CAST(sum(d) AS DOUBLE) AS size FROM lab JOIN d USING (node) GROUP BY c",
        "nmi": "WITH p AS (SELECT c_custkey % 5 AS a, c_custkey % 15 + c_nationkey % 2 AS b FROM customer), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), na AS (SELECT a, sum(n) AS na FROM c GROUP BY a), nb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), i AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS i FROM c JOIN na USING (a) JOIN nb USING (b), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS h FROM na, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS h FROM nb, t) SELECT round(i / ((ha.h + hb.h) / 2), 9) AS nmi FROM i, ha, hb",
        "modularity": f"WITH {USER}, {DEG}, {LAB}, {J}, dd AS (SELECT c, sum(d) AS dd FROM lab JOIN d USING (node) GROUP BY c), ii AS (SELECT cs AS c, sum(w) AS inner_w FROM j WHERE cs = ct GROUP BY cs), t AS (SELECT sum(w) AS m2 FROM e) SELECT round(sum(coalesce(inner_w, 0) / m2 - pow(dd / m2, 2)), 9) AS q FROM dd LEFT JOIN ii USING (c), t",
        "be_score": f"WITH {PAGE}, {LAB}, {J}, {N_CORE}, s AS (SELECT sum(xs + xt - xs * xt) / 2e0 AS mcc, count(*) / 2e0 AS m FROM j) SELECT round({_be_case('mcc', 'm', 'n', 'nc')}, 12) AS q FROM k, s",
        "divisive_score": f"WITH {PAGE}, {LAB}, {J}, k AS (SELECT c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS nc FROM lab GROUP BY c), s AS (SELECT cs AS c, sum(xs + xt - xs * xt) / 2e0 AS mcc, count(*) / 2e0 AS m FROM j WHERE cs = ct GROUP BY cs) SELECT CAST(c AS BIGINT) AS pair_id, round({_be_case('coalesce(mcc, 0)', 'coalesce(m, 0)', 'n', 'nc')}, 12) AS q FROM k LEFT JOIN s USING (c)",
        "lip_score": f"WITH {USER}, {LAB}, {J}, {lip_parts} SELECT round(-((nc * nc - cc) + pp), 9) AS q FROM k, s",
        "lip_score_periphery": f"WITH {USER}, {LAB}, {J}, {lip_parts} SELECT round(-((nc * (nc - 1) / 2 - cc / 2e0) + pp2 / 2e0), 9) AS q FROM k, s",
        "cut_score": f"WITH {USER}, {LAB}, {J}, {cut_parts} {cut('cc2')}",
        "cut_score_periphery": f"WITH {USER}, {LAB}, {J}, {cut_parts} {cut('pp2')}",
        "minres_score": f"WITH {USER}, {CORE}, {J}, {minres} SELECT round(ww - 2 * xax + s2 * (s2 - 1), 6) AS q FROM s, nn",
        "minres_score_exact": f"WITH {USER}, {CORE}, {J}, {minres} SELECT round(ww - 2 * xax + s2 * s2 - s4, 6) AS q FROM s, nn",
        "rombach_score": f"WITH {NATION}, {CORE}, {J} SELECT round(sum(xs * w * xt), 6) AS q FROM j",
        "rossa_score": f"WITH {USER}, {CORE} SELECT round(1 - avg(x), 9) AS q FROM lab",
        "km_er_score": f"WITH {USER}, {DEG}, {LAB}, {J}, {km} SELECT CAST(c AS BIGINT) AS pair_id, round((coalesce(e_, 0) / 2 - m2 / (n * n) / 2 * (nc * nc + 2 * nc * np)) / m2, 9) AS q FROM sz LEFT JOIN ee USING (c), t",
        "km_config_score": f"WITH {USER}, {DEG}, {LAB}, {J}, {km} SELECT CAST(c AS BIGINT) AS pair_id, round((coalesce(e_, 0) / 2 - (dc * dc + 2 * dc * dp) / m2 / 2) / (m2 / 2), 9) AS q FROM sz LEFT JOIN ee USING (c), t",
        "surprise_score": f"WITH {PAGE}, {LAB}, {J}, {N_CORE}, s AS (SELECT count(*) / 2e0 AS m, sum(xs * xt) / 2e0 AS lc, CAST(sum(xs * (1 - xt)) AS DOUBLE) AS lcp FROM j), u AS (SELECT *, n * (n - 1) / 2 AS v_, nc * (nc - 1) / 2 AS vc, nc * (n - nc) AS vcp, (n - nc) * (n - nc - 1) / 2 AS vp FROM k, s), y AS (SELECT *, m / greatest(v_, 1) AS p, lc / greatest(vc, 1) AS pc, lcp / greatest(vcp, 1) AS pcp, (m - lc - lcp) / greatest(vp, 1) AS pp FROM u) SELECT round({SURPRISE}, 6) AS q FROM y",
        "rombach_coreness": f"WITH {USER}, {RANKED} SELECT CAST(node AS BIGINT) AS node, k, round(x, 9) AS x FROM rk",
        "lip_detect": f"WITH {USER}, {DEG}, {z} SELECT CAST(node AS BIGINT) AS node, k, round(z, 6) AS z, CASE WHEN k <= (SELECT k FROM zz ORDER BY z, k LIMIT 1) THEN 1 ELSE 0 END AS x FROM zz",
        "cut_sweep_degree": f"WITH {USER}, {DEG}, {ranks}, en AS (SELECT greatest(a.k, z.k) AS hi, least(a.k, z.k) AS lo, CASE WHEN src = dst THEN w / 2 ELSE w END AS w FROM e JOIN rr a ON a.node = src JOIN rr z ON z.node = dst WHERE src <= dst), hh AS (SELECT hi AS k, sum(w) AS w1 FROM en GROUP BY hi), ll AS (SELECT lo AS k, sum(w) AS w2 FROM en GROUP BY lo), t AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT sum(w) FROM en) AS m), p AS (SELECT node, k, CAST(k + 1 AS DOUBLE) AS i, sum(coalesce(w1, 0)) OVER (ORDER BY k) AS cc, sum(coalesce(w2, 0)) OVER (ORDER BY k) AS touch FROM rr LEFT JOIN hh USING (k) LEFT JOIN ll USING (k)), y AS (SELECT *, i >= greatest(2, round(n * 0.1)) AND i < n - greatest(2, round(n * 0.1)) AND i <= n - 2 AS ok FROM p, t) SELECT k, CAST(node AS BIGINT) AS node, CAST(cc AS DOUBLE) AS cc, CAST(touch AS DOUBLE) AS touch, CASE WHEN ok THEN round(cc / (i * (i - 1) / 2) + (touch - cc) / (i * (n - i)) - (m - touch) / ((n - i) * (n - i - 1) / 2), 9) END AS qc, CASE WHEN ok THEN round((touch - cc) / (i * (n - i)) + (m - touch) / ((n - i) * (n - i - 1) / 2) - cc / (i * (i - 1) / 2), 9) END AS qp FROM y",
        "surprise_edge_order": f"WITH {PAGE}, {DEG}, x AS (SELECT src, dst, a.d * z.d AS product FROM e JOIN d a ON a.node = src JOIN d z ON z.node = dst WHERE src < dst) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(product AS DOUBLE) AS product, row_number() OVER (ORDER BY product DESC, src, dst) - 1 AS place FROM x",
        "minres_gradient": f"WITH {USER}, {CORE}, s AS (SELECT sum(x * x) AS s2 FROM lab), y AS (SELECT src AS node, sum(w * x) AS y FROM e JOIN lab ON node = dst GROUP BY src) SELECT CAST(lab.node AS BIGINT) AS node, round(coalesce(y, 0) - (s2 - x * x) * x, 9) AS grad FROM lab LEFT JOIN y USING (node), s",
        "adam_step": f"WITH {USER}, {CORE}, s AS (SELECT sum(x * x) AS s2 FROM lab), y AS (SELECT src AS node, sum(w * x) AS y FROM e JOIN lab ON node = dst GROUP BY src), g AS (SELECT lab.node, x, coalesce(y, 0) - (s2 - x * x) * x AS g FROM lab LEFT JOIN y USING (node), s) SELECT CAST(node AS BIGINT) AS node, round(x + 0.01e0 * ((1 - 0.9e0) * g / (1 - 0.9e0)) / (sqrt((1 - 0.999e0) * g * g / (1 - 0.999e0)) + 1e-8), 9) AS x, round((1 - 0.9e0) * g, 9) AS m, round((1 - 0.999e0) * g * g, 6) AS v FROM g",
        "km_er_move_gain": _gain("km_er"),
        "km_config_move_gain": _gain("km_config"),
        "rombach_swap_gain": f"WITH {NATION}, {RANKED}, y AS (SELECT rk.node, rk.x, coalesce((SELECT sum(w * o.x) FROM e JOIN rk o ON o.node = dst WHERE src = rk.node AND dst <> src), 0) AS r FROM rk), p AS (SELECT a.node AS a, z.node AS b, a.x AS xa, z.x AS xb, a.r AS ra, z.r AS rb, coalesce(w, 0) AS w FROM y a JOIN y z ON a.node < z.node LEFT JOIN e ON src = a.node AND dst = z.node) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round((xb - xa) * ((ra - w * xb) - (rb - w * xa)), 9) AS gain FROM p",
        "chung_lu_prob": f"WITH {USER}, c AS (SELECT src AS node, CAST(count(*) AS DOUBLE) AS d FROM e GROUP BY src), t AS (SELECT sum(d) AS t FROM c) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(least(1e0, a.d * z.d / t), 12) AS p FROM e JOIN c a ON a.node = src JOIN c z ON z.node = dst, t WHERE src <= dst",
        "er_density": f"WITH {USER}, z AS (SELECT CAST((SELECT count(*) FROM v) AS DOUBLE) AS n, CAST((SELECT count(*) FROM e WHERE src < dst) AS DOUBLE) AS m) SELECT n, m, round(m / (n * (n - 1) / 2), 12) AS density FROM z",
        "sidak": "SELECT DISTINCT n AS tests, round(1 - pow(1 - 0.05e0, 1e0 / n), 12) AS level FROM (SELECT count(*) AS n FROM events GROUP BY user_id)",
        "qs_ensemble_stats": f"WITH {ENSEMBLE}, {STATS} SELECT n, round(sq, 9) AS sq, round(ss, 9) AS ss, round(gamma, 9) AS gamma, round(h, 9) AS h FROM st",
        "qs_pvalues": f"WITH {ENSEMBLE}, {STATS}, obs AS (SELECT user_id AS pair_id, avg(value) FILTER (event_type IN ('click', 'purchase')) / 100 AS q, CAST(count(*) AS DOUBLE) AS s FROM events GROUP BY user_id HAVING q IS NOT NULL), a AS (SELECT pair_id, obs.q, obs.s, -pow((obs.s - ens.s) / (h * ss), 2) / 2 AS logw, ((obs.q - ens.q) / (h * sq) - gamma * (obs.s - ens.s) / (h * ss)) / sqrt(1 - gamma * gamma) AS z FROM obs, ens, st), c AS (SELECT *, {norm_cdf_sql('z')} AS cd, max(logw) OVER (PARTITION BY pair_id) AS top FROM a), p AS (SELECT pair_id, q, s, 1 - sum(exp(logw - top) * cd) / sum(exp(logw - top)) AS p FROM c GROUP BY ALL) SELECT pair_id, round(q, 9) AS q, s, round(p, 6) AS p_value, p <= 1 - pow(0.95e0, 1e0 / (SELECT count(*) FROM obs)) AS significant FROM p",
        "relabel_significant": f"WITH {USER}, {DEG}, {LAB}, sz AS (SELECT c, sum(d) AS size FROM lab JOIN d USING (node) GROUP BY c), kept AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS new_c FROM sz WHERE size > (SELECT avg(size) FROM sz)) SELECT CAST(node AS BIGINT) AS node, CAST(new_c AS BIGINT) AS c, CASE WHEN new_c IS NOT NULL THEN CAST(x AS DOUBLE) END AS x FROM lab LEFT JOIN kept USING (c)",
        "classify_nodes": f"WITH {USER}, {CLASSIFIED} SELECT CAST(node AS BIGINT) AS node, CAST(c AS BIGINT) AS c, x, rank, kind FROM cls",
        "draw_table": f"WITH {USER}, {CLASSIFIED} SELECT CAST(node AS BIGINT) AS node, kind, CAST(c AS BIGINT) AS pair_id, x AS coreness, CASE WHEN kind = 'colored' THEN CAST(greatest(0, least(11, floor(x * 10) + 1)) AS INTEGER) END AS bin, CASE WHEN kind = 'colored' THEN 'circle' ELSE 'square' END AS marker, CASE WHEN kind = 'colored' THEN 10e0 ELSE 1e0 END AS node_size, row_number() OVER (ORDER BY coalesce(x, -1e0), node) - 1 AS layer, 'node: ' || node || ', pair: ' || coalesce(CAST(c AS VARCHAR), 'residual') || ', coreness: ' || coalesce(printf('%.3f', x), 'none') AS hovertext FROM cls WHERE kind <> 'muted'",
        "draw_edges": f"WITH {USER}, {CLASSIFIED}, n AS (SELECT node FROM cls WHERE kind <> 'muted') {EDGES} WHERE src < dst AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)",
        "matrix_order": f"WITH {USER}, {LAB} SELECT CAST(node AS BIGINT) AS node, CAST(c AS BIGINT) AS c, CAST(x AS INTEGER) AS x, row_number() OVER (ORDER BY c, x DESC, node) - 1 AS place FROM lab",
    }
