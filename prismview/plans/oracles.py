"""DuckDB SQL for the registered queries, written apart from the Spark code: each text recomputes everything from the tables."""

from __future__ import annotations

VIEWS = ("v1", "v2", "v3")
#: 24 bits of an MD5 digest.
H = "('0x' || substr(md5({}), 1, 6))::BIGINT"


def h(*parts: str) -> str:
    return H.format(" || '|' || ".join(parts))


# points: signs of dimensions as bits, and the continuous part
PTS = """pts AS (SELECT CAST(vec_id AS VARCHAR) id, CAST(vec_id AS BIGINT) pos, CAST(label % 2 AS INTEGER) y,
  list_sum([CASE WHEN embedding[k] > 0 THEN 1 << (k - 1) ELSE 0 END for k in range(1, 9)])::BIGINT s1,
  list_sum([CASE WHEN embedding[k] > 0 THEN 1 << (k - 9) ELSE 0 END for k in range(9, 33)])::BIGINT s2,
  CAST(embedding[33:64] AS DOUBLE[]) e3 FROM embeddings)"""
WIDE = (
    PTS
    + """, w AS (SELECT a.id i, b.id j, a.pos pi, b.pos pj, a.y yi, b.y yj,
  bit_count(xor(a.s1, b.s1)) / 8.0::DOUBLE d1,
  CASE WHEN a.s2 | b.s2 = 0 THEN 0.0 ELSE 1 - bit_count(a.s2 & b.s2)::DOUBLE / bit_count(a.s2 | b.s2) END::DOUBLE d2,
  floor(list_distance(a.e3, b.e3) * 1e6 + 0.5) / 1e6 d3 FROM pts a, pts b WHERE a.pos <> b.pos)"""
)
PAIRS = WIDE + ", pairs AS (" + " UNION ALL ".join(f"SELECT '{v}' AS view, i, j, pi, pj, yi, yj, d{k} d FROM w" for k, v in enumerate(VIEWS, 1)) + ")"
UP = PAIRS + ", up AS (SELECT * FROM pairs WHERE pi < pj)"
BOUNDS = UP + ", bounds AS (SELECT view, quantile_cont(d, 0.05) lo, quantile_cont(d, 0.95) hi FROM up GROUP BY view)"
NORM = BOUNDS + ", norm AS (SELECT p.* REPLACE (CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 0.0 ELSE least(greatest((d - lo) / (hi - lo), 0.0), 1.0) END AS d) FROM pairs p JOIN bounds USING (view))"
NEAR = PAIRS + ", near AS (SELECT *, row_number() OVER (PARTITION BY view, i ORDER BY d, pj) rank FROM pairs QUALIFY rank <= 10)"
GROUPS = """g0 AS (SELECT view, i, d, count(*) c, sum(CASE WHEN yi = yj THEN 1 ELSE 0 END) same FROM pairs GROUP BY view, i, d),
 g AS (SELECT *, least(1.0, greatest(0.0, (10 - coalesce(sum(c) OVER (PARTITION BY view, i ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / c))::DOUBLE wt FROM g0),
 purity AS (SELECT view, i, sum(same * wt) / 10 knn_purity FROM g GROUP BY view, i)"""
MARGIN = "(d_plus - d_minus) / (d_plus + d_minus + 1e-12)"
MARGINS = f"m0 AS (SELECT view, i, yi y, min(CASE WHEN yi = yj THEN d END) d_plus, min(CASE WHEN yi <> yj THEN d END) d_minus FROM pairs GROUP BY view, i, yi), m AS (SELECT *, {MARGIN} mu FROM m0)"
POINTS = f"{NEAR}, {GROUPS}, {MARGINS}, kn AS (SELECT view, i, avg(d) knn_mean FROM near GROUP BY view, i), pt AS (SELECT m.view, m.i id, y, mu, d_plus, d_minus, knn_purity, knn_mean FROM m JOIN purity USING (view, i) JOIN kn USING (view, i))"


def described(col: str, prefix: str) -> str:
    q = ", ".join(f"round(quantile_cont({col}, {x}), 9) {prefix}_{n}" for x, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return f"count({col}) {prefix}_count, round(avg({col}), 9) {prefix}_mean, round(stddev_samp({col}), 9) {prefix}_std, round(min({col}), 9) {prefix}_min, {q}, round(max({col}), 9) {prefix}_max"


# folds and runs
FOLDS = PTS + ", f AS (SELECT id, pos, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(id || '|42'), id) - 1) % 5 + 1 AS INTEGER) fold FROM pts)"
CFG = "cfg AS (SELECT m || '|' || a || '|' || b || '|' || e config_key, m model, a k0, b k1, CAST(e AS DOUBLE) eta FROM (VALUES ('global'), ('label')) t1(m), (VALUES (2), (3)) t2(a), (VALUES (2), (3)) t3(b), (VALUES ('0.01'), ('0.02'), ('0.05')) t4(e))"
STORED = f"""{CFG}, st AS (SELECT cfg.*, CAST(fold AS INTEGER) fold, version, CASE WHEN {h("config_key", "'status'", "fold")} % 40 = 0 THEN 'degenerate' ELSE 'ok' END status
 FROM cfg, range(1, 6) t5(fold), (VALUES (1), (2)) t6(version)
 WHERE NOT (fold = 5 AND {h("config_key", "'drop'")} % 7 = 0) AND (version = 1 OR (fold = 1 AND {h("config_key", "'dup'")} % 3 = 0))),
 fr AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY config_key, fold ORDER BY version DESC) = 1)"""
RUNS = f"{FOLDS}, {STORED}, fp AS (SELECT fr.*, id, pos, y y_true, CASE WHEN {h('config_key', 'id', 'version')} % 100 < 60 + 3 * k0 + k1 THEN y ELSE 1 - y END y_pred FROM fr JOIN f USING (fold)), ok AS (SELECT * FROM fp WHERE status = 'ok')"
COUNTS = "sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END)::BIGINT tp, sum(CASE WHEN y_true <> 1 AND y_pred = 1 THEN 1 ELSE 0 END)::BIGINT fp, sum(CASE WHEN y_true <> 1 AND y_pred <> 1 THEN 1 ELSE 0 END)::BIGINT tn, sum(CASE WHEN y_true = 1 AND y_pred <> 1 THEN 1 ELSE 0 END)::BIGINT fn"


def r0(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b}), 0), 0.0)"


REC, SPEC = r0("tp", "tp + fn"), r0("tn", "tn + fp")
METRICS = {
    "acc": r0("tp + tn", "tp + tn + fp + fn"),
    "recall": REC,
    "specificity": SPEC,
    "precision": r0("tp", "tp + fp"),
    "f1": r0("2 * tp", "2 * tp + fp + fn"),
    "balanced_accuracy": f"({REC} + {SPEC}) / 2",
    "bal_acc": f"({REC} + {SPEC}) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT)",
    "f1_macro": f"({r0('2 * tp', '2 * tp + fp + fn')} + {r0('2 * tn', '2 * tn + fp + fn')}) / ((tp + fn + fp > 0)::INT + (tn + fp + fn > 0)::INT)",
    "mcc": r0("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"),
}
ALL_METRICS = ", ".join(f"round({e}, 9) AS \"{n}\"" for n, e in METRICS.items())
POOLED = f"{RUNS}, pc AS (SELECT config_key, model, k0, k1, eta, {COUNTS} FROM ok GROUP BY ALL), pm AS (SELECT *, {', '.join(f'{e} AS "{n}"' for n, e in METRICS.items())} FROM pc)"
SINGLE = f"sv AS (SELECT view, id, y y_true, CASE WHEN {h(chr(39) + 'sv' + chr(39), 'view', 'id')} % 100 < 65 THEN y ELSE 1 - y END y_pred FROM pts, (VALUES ('v1'), ('v2'), ('v3')) t(view)), sc AS (SELECT *, CAST(y_true = y_pred AS INTEGER) correct FROM sv)"
FIXED = f"fx AS (SELECT profile, id, CAST({h(chr(39) + 'fx' + chr(39), 'profile', 'id')} % 100 < 70 AS INTEGER) correct FROM pts, (VALUES ('corner'), ('uniform')) t(profile))"
JOINED = f"{POINTS}, {SINGLE}, jn AS (SELECT pt.*, y_pred, correct, (1 - knn_purity) + greatest(0.0, -mu) difficulty FROM pt JOIN sc USING (view, id))"
WIDEPT = JOINED + ", wp AS (SELECT id, coalesce(" + ", ".join(f"max(CASE WHEN view = '{v}' THEN y END)" for v in VIEWS) + ") y, " + ", ".join(f"max(CASE WHEN view = '{v}' THEN {m} END) {m}_{v}" for m in ("correct", "knn_purity", "mu", "knn_mean") for v in VIEWS) + " FROM jn GROUP BY id)"


def raw_weight(v: int) -> str:
    return f"({h('config_key', 'fold', 'lab', chr(39) + str(v) + chr(39))} % 100 + 1)::DOUBLE"


TOTAL = " + ".join(raw_weight(v) for v in range(3))
WEIGHTS = f"""{STORED}, lw AS (SELECT fr.*, lab FROM fr JOIN (VALUES ('global', -1), ('label', 0), ('label', 1)) t(model, lab) USING (model) WHERE status = 'ok'),
 ww AS (SELECT config_key, model, eta, fold, CAST(nullif(lab, -1) AS INTEGER) AS label, {", ".join(f"{raw_weight(v)} / ({TOTAL}) w_v{v + 1}" for v in range(3))} FROM lw),
 wx AS (SELECT *, -(w_v1 * ln(w_v1) + w_v2 * ln(w_v2) + w_v3 * ln(w_v3)) / ln(3) entropy, greatest(w_v1, w_v2, w_v3) max_weight,
  CASE WHEN w_v1 >= w_v2 AND w_v1 >= w_v3 THEN 'v1' WHEN w_v2 >= w_v3 THEN 'v2' ELSE 'v3' END dominant,
  w_v1 + w_v2 + w_v3 - least(w_v1, w_v2, w_v3) top2 FROM ww),
 wc AS (SELECT *, CASE WHEN max_weight <= 0.45 THEN 'near_uniform' WHEN max_weight >= 0.80 THEN 'single' WHEN top2 >= 0.85 THEN 'mix' ELSE 'mixed' END weight_class FROM wx)"""
LABELS = WEIGHTS + ", ld AS (SELECT config_key, eta, fold, sqrt((max(CASE WHEN label = 0 THEN w_v1 END) - max(CASE WHEN label = 1 THEN w_v1 END)) ** 2 + (max(CASE WHEN label = 0 THEN w_v2 END) - max(CASE WHEN label = 1 THEN w_v2 END)) ** 2 + (max(CASE WHEN label = 0 THEN w_v3 END) - max(CASE WHEN label = 1 THEN w_v3 END)) ** 2) label_distance FROM wx WHERE label IS NOT NULL GROUP BY config_key, eta, fold)"
FOLDACC = f"{RUNS}, fa AS (SELECT config_key, model, eta, fold, {METRICS['bal_acc']} ba FROM (SELECT config_key, model, eta, fold, {COUNTS} FROM ok GROUP BY ALL))"

# prototypes: squared weights .5 .3 .2
DC = "0.0 + 0.5::DOUBLE * d1 + 0.3::DOUBLE * d2 + 0.2::DOUBLE * d3"
OWN = f"{WIDE}, own AS (SELECT i, j, pi, yi y, ({DC}) * ({DC}) sq FROM w WHERE yi = yj), p0 AS (SELECT y, i, pi FROM (SELECT y, i, pi, sum(sq) s FROM own GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY y ORDER BY s, pi) = 1)"


def further(n: int) -> str:
    chosen = " UNION ALL ".join(f"SELECT y, i FROM p{k}" for k in range(n))
    return f", p{n} AS (SELECT y, i, pi FROM (SELECT o.y, o.i, o.pi, min(sq) s FROM own o JOIN ({chosen}) c ON o.j = c.i WHERE o.i NOT IN (SELECT i FROM ({chosen})) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY y ORDER BY s DESC, pi) = 1)"


def protos(n: int) -> str:
    return OWN + "".join(further(k) for k in range(1, n)) + ", pr AS (SELECT CAST(row_number() OVER (ORDER BY y, n) - 1 AS INTEGER) k, i id, y FROM (" + " UNION ALL ".join(f"SELECT y, i, {k} n FROM p{k}" for k in range(n)) + "))"


STARTS = protos(2)


def assign(dc: str) -> str:
    return f"""{STARTS}, cells AS (SELECT * FROM w UNION ALL SELECT id, id, pos, pos, y, y, 0.0, 0.0, 0.0 FROM pts),
 dp AS (SELECT c.i, c.pi, c.yi, pr.k, pr.y yk, d1, d2, d3, {dc} dc FROM cells c JOIN pr ON c.j = pr.id),
 a AS (SELECT p.i, p.pi, p.yi y, p.k k_plus, p.dc d_plus, p.d1 p1, p.d2 p2, p.d3 p3, q.k k_minus, q.dc d_minus, q.d1 q1, q.d2 q2, q.d3 q3
  FROM (SELECT * FROM dp WHERE yi = yk QUALIFY row_number() OVER (PARTITION BY i ORDER BY dc, k) = 1) p
  JOIN (SELECT * FROM dp WHERE yi <> yk QUALIFY row_number() OVER (PARTITION BY i ORDER BY dc, k) = 1) q USING (i))"""


ASSIGN = assign(DC)
MU5 = "(d_plus - d_minus) / (d_plus + d_minus + 1e-5)"
AV = (0.6, 0.64, 0.48)


def swap(dc: str) -> str:
    return f"""WITH {assign(dc)}, k0 AS (SELECT id, y FROM pr WHERE k = 0), ca AS (SELECT a.i j FROM a, k0 WHERE k_plus = 0 AND a.i <> k0.id),
 wo AS (SELECT i, yi, min(dc) FILTER (yi = yk) p, min(dc) FILTER (yi <> yk) m FROM dp WHERE k <> 0 GROUP BY i, yi),
 cd AS (SELECT i, j, pj, {dc} dc FROM cells),
 mv AS (SELECT c.j, c.pj, CASE WHEN wo.yi = k0.y THEN least(p, c.dc) ELSE p END d_plus, CASE WHEN wo.yi = k0.y THEN m ELSE least(m, c.dc) END d_minus FROM cd c JOIN ca USING (j) JOIN wo ON c.i = wo.i, k0)
 SELECT j candidate, pj pc, round(sum({MU5}) - (SELECT sum({MU5}) FROM a), 9) + 0.0 delta FROM mv GROUP BY j, pj"""



def grads(by: str) -> str:
    key = f"{by}, " if by else ""
    g = ", ".join(f"sum(4 * {AV[v]}::DOUBLE * (p{v + 1} * d_minus - q{v + 1} * d_plus) / (d_plus + d_minus + 1e-5) ** 2) g{v}" for v in range(3))
    step = ", ".join(f"{AV[v]}::DOUBLE - 0.1::DOUBLE * g{v} / (sqrt(g0 * g0 + g1 * g1 + g2 * g2) + 1e-12) s{v}" for v in range(3))
    rows = " UNION ALL ".join(f"SELECT {key}CAST({v} AS INTEGER) v, round(s{v} / sqrt(s0 * s0 + s1 * s1 + s2 * s2), 9) a FROM s" for v in range(3))
    return f"WITH {ASSIGN}, g AS (SELECT {key}{g} FROM a {f'GROUP BY {by}' if by else ''}), s AS (SELECT {key}{step} FROM g) {rows}"


SIMPLEX = """u AS (SELECT id, k, x, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) r, sum(x) OVER (PARTITION BY id ORDER BY x DESC, k ROWS UNBOUNDED PRECEDING) c FROM x),
 t AS (SELECT id, arg_max((c - 1) / r, r) theta FROM u WHERE x - (c - 1) / r > 0 GROUP BY id)"""

def fit_rounds(by_label: bool, rounds: int = 2, eta: float = 0.02) -> str:
    """A fit with two prototypes for each label, unrolled: the state at the start, and after each swap and each step of the weights."""
    group = "{}" if by_label else "0 * {}"

    def state(n: int) -> str:
        g = group.format("yi")
        return f"""dk{n} AS MATERIALIZED (SELECT pi, yi, {g} g, k, y yk, d1, d2, d3, a1 * a1 * d1 + a2 * a2 * d2 + a3 * a3 * d3 dc FROM ww JOIN pr{n} ON pj = p JOIN aw{n} ON g = {g}),
 ow{n} AS (SELECT * FROM dk{n} WHERE yi = yk QUALIFY row_number() OVER (PARTITION BY pi ORDER BY dc, k) = 1), ot{n} AS (SELECT * FROM dk{n} WHERE yi <> yk QUALIFY row_number() OVER (PARTITION BY pi ORDER BY dc, k) = 1),
 as{n} AS MATERIALIZED (SELECT o.pi, o.yi, o.g, o.k kp, t.k km, o.dc dp, t.dc dm, o.d1 p1, o.d2 p2, o.d3 p3, t.d1 m1, t.d2 m2, t.d3 m3 FROM ow{n} o JOIN ot{n} t USING (pi)),
 va{n} AS MATERIALIZED (SELECT sum((dp - dm) / (dp + dm + 1e-5)) v FROM as{n})"""

    def swap(n: int) -> str:
        g = group.format("w.yi")
        return f"""rk{n} AS (SELECT k, row_number() OVER (ORDER BY (SELECT coalesce(sum(dp), 0) FROM as{n} WHERE kp = k) - (SELECT coalesce(sum(dm), 0) FROM as{n} WHERE km = k) DESC, k) r FROM pr{n}),
 wo{n} AS MATERIALIZED (SELECT d.pi, x.k, min(CASE WHEN yi = yk THEN dc END) p, min(CASE WHEN yi <> yk THEN dc END) m FROM dk{n} d JOIN pr{n} x ON d.k <> x.k GROUP BY ALL),
 fd{n} AS (SELECT a.pi c, a.kp k, x.y yk FROM as{n} a JOIN pr{n} x ON a.kp = x.k WHERE a.pi <> x.p),
 cd{n} AS (SELECT c, f.k, CASE WHEN w.yi = yk THEN least(p, a1 * a1 * d1 + a2 * a2 * d2 + a3 * a3 * d3) ELSE p END p, CASE WHEN w.yi = yk THEN m ELSE least(m, a1 * a1 * d1 + a2 * a2 * d2 + a3 * a3 * d3) END m
  FROM fd{n} f JOIN ww w ON w.pj = f.c JOIN wo{n} o ON o.pi = w.pi AND o.k = f.k JOIN aw{n} ON g = {g}),
 mv{n} AS (SELECT c, k FROM (SELECT c, k, sum((p - m) / (p + m + 1e-5)) - (SELECT v FROM va{n}) delta FROM cd{n} GROUP BY ALL) JOIN rk{n} USING (k) WHERE delta < 0 ORDER BY r, delta, c LIMIT 1),
 pr{n + 1} AS MATERIALIZED (SELECT x.k, coalesce(c, p) p, y FROM pr{n} x LEFT JOIN mv{n} USING (k)), aw{n + 1} AS (FROM aw{n})"""

    def step(n: int) -> str:
        grads = ", ".join(f"4 * any_value(a{v}) * sum((p{v} * dm - m{v} * dp) / ((dp + dm + 1e-5) * (dp + dm + 1e-5))) g{v}" for v in (1, 2, 3))
        moved = ", ".join(f"a{v} - {eta} * g{v} / (sqrt(g1 * g1 + g2 * g2 + g3 * g3) + 1e-12) a{v}" for v in (1, 2, 3))
        return f"""gr{n} AS (SELECT g, {grads}, any_value(a1) a1, any_value(a2) a2, any_value(a3) a3 FROM as{n} JOIN aw{n} USING (g) GROUP BY g), st{n} AS (SELECT g, {moved} FROM gr{n}),
 aw{n + 1} AS MATERIALIZED (SELECT g, {", ".join(f"a{v} / sqrt(a1 * a1 + a2 * a2 + a3 * a3) a{v}" for v in (1, 2, 3))} FROM st{n}), pr{n + 1} AS (FROM pr{n})"""

    parts = [
        f"WITH {WIDE}",
        "ww AS MATERIALIZED (SELECT pi, pj, yi, yj, d1, d2, d3 FROM w UNION ALL SELECT pos, pos, y, y, 0, 0, 0 FROM pts)",
        f"aw0 AS (SELECT DISTINCT {group.format('y')} g, 1 / sqrt(3.0::DOUBLE) a1, a1 a2, a1 a3 FROM pts)",
        f"sq AS MATERIALIZED (SELECT pi, pj, yi y, (a1 * a1 * d1 + a2 * a2 * d2 + a3 * a3 * d3) ** 2 s FROM ww JOIN aw0 ON g = {group.format('yi')} WHERE yi = yj)",
        "md AS (SELECT y, pi p FROM (SELECT y, pi, sum(s) t FROM sq GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY y ORDER BY t, pi) = 1)",
        "fr AS (SELECT sq.y, pi p FROM sq JOIN md ON pj = p WHERE pi <> p QUALIFY row_number() OVER (PARTITION BY sq.y ORDER BY s DESC, pi) = 1)",
        "pr0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY y, n) - 1 k, p, y FROM (SELECT *, 0 n FROM md UNION ALL SELECT y, p, 1 FROM fr))",
    ]
    for n in range(2 * rounds + 1):
        parts.append(state(n))
        if n < 2 * rounds:
            parts.append(step(n) if n % 2 else swap(n))
    parts.append("ix AS (SELECT pos p, row_number() OVER (ORDER BY pos) - 1 i FROM pts)")
    steps = ["start", *["swap", "weights"] * rounds]
    rows = [
        f"SELECT {(n + 1) // 2}::INT epoch, '{x}' step, (row_number() OVER (ORDER BY g) - 1)::INT part, round(v, 9) loss, (SELECT string_agg(i, ',' ORDER BY k) FROM pr{n} JOIN ix USING (p)) protos, round(a1 * a1, 9) w1, round(a2 * a2, 9) w2, round(a3 * a3, 9) w3 FROM aw{n}, va{n}"
        for n, x in enumerate(steps)
    ]
    return ", ".join(parts) + " " + " UNION ALL ".join(rows)


ORACLES = {
    "fit_two_rounds_global": fit_rounds(False),
    "fit_two_rounds_label": fit_rounds(True),
    "fit_two_rounds_three": fit_rounds(True).replace("label % 2", "label % 3"),
    "label_metrics": f"""WITH {PTS.replace("label % 2", "label % 3")}, h AS (SELECT view, id, y, {h("'three'", "view", "id")} % 6 lot FROM pts, (VALUES ('v1'), ('v2'), ('v3')) t(view)),
 p AS (SELECT view, y yt, CASE WHEN lot < 4 THEN y ELSE (y + lot - 3) % 3 END yp FROM h), l AS (SELECT DISTINCT view, unnest([yt, yp]) lab FROM p),
 c AS (SELECT l.view, lab, count(*) FILTER (yt = lab) own, count(*) FILTER (yp = lab) said, count(*) FILTER (yt = lab AND yp = lab) hit FROM l JOIN p USING (view) GROUP BY ALL)
 SELECT view, round(sum(hit)::DOUBLE / sum(own), 9) acc, round(avg(hit / own) FILTER (own > 0), 9) bal_acc, round(avg(2 * hit / (own + said)), 9) f1_macro FROM c GROUP BY view""",
    "dist_distribution": f"WITH {NORM} SELECT view, round(avg(d), 9) mean, round(stddev_pop(d), 9) std, round(quantile_cont(d, 0.1), 9) q10, round(quantile_cont(d, 0.5), 9) median, round(quantile_cont(d, 0.9), 9) q90, round(avg(CASE WHEN abs(d - 1) <= 1e-12 + 1e-5 THEN 1.0 ELSE 0.0 END), 9) share_one FROM norm WHERE pi < pj GROUP BY view",
    "pair_distance": f"WITH {PAIRS} SELECT view, pi, round(sum(d), 9) total, round(min(d), 9) least FROM pairs GROUP BY view, pi",
    "customer_views": """WITH s AS (SELECT o_custkey, sum(o_totalprice) spend FROM orders GROUP BY 1), k AS (SELECT o_custkey, list(DISTINCT p_brand || '|' || p_type) products FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
 p AS (SELECT c_custkey pos, c_nationkey nation, n_regionkey region, coalesce(spend, 0) spend, coalesce(products, []) products FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON c_custkey = s.o_custkey LEFT JOIN k ON c_custkey = k.o_custkey),
 e AS (SELECT pos, unnest(products) kind FROM p), x AS (SELECT a.pos pi, b.pos pj, count(*) n FROM e a JOIN e b USING (kind) GROUP BY ALL),
 q AS (SELECT CASE WHEN a.nation = b.nation THEN 0.0 WHEN a.region = b.region THEN 0.5 ELSE 1.0 END::DOUBLE d1, CASE WHEN len(a.products) + len(b.products) = 0 THEN 0.0 ELSE 1 - coalesce(n, 0)::DOUBLE / (len(a.products) + len(b.products) - coalesce(n, 0)) END d2, floor(abs(ln(1 + a.spend) - ln(1 + b.spend)) * 1e6 + 0.5) / 1e6 d3 FROM p a JOIN p b ON a.pos <> b.pos LEFT JOIN x ON a.pos = x.pi AND b.pos = x.pj)
 SELECT 'place' AS view, count(*) n, round(sum(d1), 4) total, round(max(d1), 9) greatest FROM q UNION ALL SELECT 'products', count(*), round(sum(d2), 4), round(max(d2), 9) FROM q UNION ALL SELECT 'spend', count(*), round(sum(d3), 4), round(max(d3), 9) FROM q""",
    "align_inner": f"WITH {PAIRS}, k AS (SELECT id FROM pts WHERE pos % 7 <> 0 AND pos % 11 <> 0) SELECT view, count(*) n, round(sum(d), 4) total, round(max(d), 9) greatest, (SELECT count(*) FROM k) points FROM pairs WHERE i IN (FROM k) AND j IN (FROM k) GROUP BY view",
    "missing_ids": f"WITH {PTS} SELECT id FROM pts WHERE pos % 7 = 0",
    "matrix_problems": "SELECT 0::BIGINT missing_cells, 0::BIGINT duplicate_cells, 0::BIGINT bad_cells",
    "norm_robust": f"WITH {NORM} SELECT view, pi, round(sum(d), 9) total, count(*) FILTER (d = 1) at_one, count(*) FILTER (d = 0) at_zero FROM norm GROUP BY view, pi",
    "quantile_dist": f"WITH {UP} SELECT view, " + ", ".join(f"round(quantile_cont(d, {q}), 9) q{round(q * 1000):03d}" for q in (0.0, 0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0)) + ", round(avg(d), 9) mean, round(stddev_pop(d), 9) std, round(stddev_pop(d) / avg(d), 9) cv FROM up GROUP BY view",
    "basic_checks": f"WITH {PAIRS}, al AS (SELECT view, d FROM pairs UNION ALL SELECT view, 0.0 FROM pts, (VALUES ('v1'), ('v2'), ('v3')) t(view)), sy AS (SELECT a.view, max(abs(a.d - b.d)) g FROM pairs a JOIN pairs b ON a.view = b.view AND a.i = b.j AND a.j = b.i GROUP BY a.view) SELECT view, (SELECT count(*) FROM pts) n, round(any_value(g), 9) sym_max_abs_diff, round(min(d), 9) d_min, round(max(d), 9) d_max, round(avg(d), 9) d_mean, round(stddev_pop(d), 9) d_std FROM al JOIN sy USING (view) GROUP BY view",
    "row_mean_describe": f"WITH {PAIRS}, rm AS (SELECT view, i, sum(d) / (count(*) + 1) x FROM pairs GROUP BY view, i) SELECT view, {described('x', 'row_mean')} FROM rm GROUP BY view",
    "knn_mean": f"WITH {NEAR}, kn AS (SELECT view, i, avg(d) x FROM near GROUP BY view, i) SELECT view, round(avg(x), 9) knn_mean, round(stddev_pop(x), 9) knn_std FROM kn GROUP BY view",
    "intrinsic_dim_2nn": f"WITH {NEAR}, t AS (SELECT view, i, max(CASE WHEN rank = 1 THEN d END) r1, max(CASE WHEN rank = 2 THEN d END) r2 FROM near GROUP BY view, i) SELECT view, count(*) n_used, round(1 / avg(ln(r2 / r1)), 9) intrinsic_dim FROM t WHERE r1 > 1e-12 AND r2 > r1 GROUP BY view",
    "class_counts": f"WITH {PTS} SELECT y, count(*) n FROM pts GROUP BY y",
    "intra_inter": f"WITH {UP}, z AS (SELECT view, avg(d) FILTER (yi = yj) a, stddev_pop(d) FILTER (yi = yj) b, avg(d) FILTER (yi <> yj) c, stddev_pop(d) FILTER (yi <> yj) e FROM up GROUP BY view) SELECT view, round(a, 9) intra_mean, round(b, 9) intra_std, round(c, 9) inter_mean, round(e, 9) inter_std, round(c / a, 9) separation FROM z",
    "margins": f"WITH {PAIRS}, {MARGINS} SELECT view, i, y, round(d_plus, 9) d_plus, round(d_minus, 9) d_minus, round(mu, 9) + 0.0 mu FROM m",
    "margin_summary": f"WITH {PAIRS}, {MARGINS} SELECT view, {described('mu', 'mu')}, round(avg((mu < 0)::INT), 9) frac_negative, round(avg((mu = 0)::INT), 9) frac_zero FROM m GROUP BY view",
    "robust_margin": f"WITH {PAIRS}, m0 AS (SELECT view, i, coalesce(min(d) FILTER (yi = yj AND d > 0), min(d) FILTER (yi = yj)) d_plus, coalesce(min(d) FILTER (yi <> yj AND d > 0), min(d) FILTER (yi <> yj)) d_minus FROM pairs GROUP BY view, i), m AS (SELECT *, {MARGIN} mu FROM m0) SELECT view, {described('mu', 'mu')}, round(avg((mu < 0)::INT), 9) frac_negative, round(avg((mu = 0)::INT), 9) frac_zero FROM m GROUP BY view",
    "knn_purity_tiesafe": f"WITH {PAIRS}, {GROUPS} SELECT view, i, round(knn_purity, 9) knn_purity FROM purity",
    "knn_weights_rowsum": f"WITH {PAIRS}, {GROUPS} SELECT view, i, round(sum(c * wt), 9) total, sum(c)::BIGINT n FROM g WHERE wt > 0 GROUP BY view, i",
    "purity_permutation": f"""WITH {PAIRS}, {GROUPS}, nw AS (SELECT p.view, p.i, p.j, wt FROM pairs p JOIN g USING (view, i, d) WHERE wt > 0),
 tk AS (SELECT perm, id, row_number() OVER (PARTITION BY perm ORDER BY md5(id || '|' || perm || '|0'), pos) r FROM pts, range(50) t(perm)), gv AS (SELECT y, row_number() OVER (ORDER BY pos) r FROM pts), lb AS (SELECT perm, id, y FROM tk JOIN gv USING (r)),
 ru AS (SELECT view, a.perm, sum(CASE WHEN a.y = b.y THEN wt ELSE 0 END) / (10.0 * (SELECT count(*) FROM pts)) p FROM nw JOIN lb a ON nw.i = a.id JOIN lb b ON nw.j = b.id AND a.perm = b.perm GROUP BY ALL),
 bs AS (SELECT view, avg(p) bm, stddev_pop(p) sd FROM ru GROUP BY view), pm AS (SELECT view, avg(knn_purity) x FROM purity GROUP BY view)
 SELECT view, round(x, 9) purity_mean, round(bm, 9) baseline_mean, round(sd, 9) baseline_std, round((x - bm) / (sd + 1e-12), 9) z FROM pm JOIN bs USING (view)""",
    "zero_stats": f"WITH {UP}, r AS (SELECT view, avg((d = 0)::INT) zero_rate FROM up GROUP BY view), z AS (SELECT view, i, sum((d = 0)::INT)::BIGINT zeros FROM pairs GROUP BY view, i) SELECT view, round(any_value(zero_rate), 9) zero_rate, round(avg(zeros), 9) zeros_mean, round(stddev_samp(zeros), 9) zeros_std, max(zeros) zeros_max, round(avg((zeros >= 1)::INT), 9) frac_any, round(avg((zeros >= 10)::INT), 9) frac_ten FROM z JOIN r USING (view) GROUP BY view",
    "unique_values": f"WITH {UP}, v AS (SELECT DISTINCT view, d FROM up), n AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY d) a, row_number() OVER (PARTITION BY view ORDER BY d DESC) b, count(*) OVER (PARTITION BY view) n_unique FROM v) SELECT view, n_unique, 'head' side, a place, round(d, 9) d FROM n WHERE a <= 30 UNION ALL SELECT view, n_unique, 'tail', b, round(d, 9) FROM n WHERE b <= 30",
    "point_table": f"WITH {POINTS} SELECT view, id, y, round(mu, 9) + 0.0 mu, round(d_plus, 9) d_plus, round(d_minus, 9) d_minus, round(knn_purity, 9) knn_purity, round(knn_mean, 9) knn_mean FROM pt",
    "corr_pearson": f"WITH {WIDE}, c AS (SELECT corr(d1, d2) a, corr(d1, d3) b, corr(d2, d3) c FROM w WHERE pi < pj) SELECT x.column1 a, x.column2 b, round(x.column3, 9) r FROM c, LATERAL (VALUES ('v1', 'v1', 1.0::DOUBLE), ('v2', 'v2', 1.0), ('v3', 'v3', 1.0), ('v1', 'v2', c.a), ('v2', 'v1', c.a), ('v1', 'v3', c.b), ('v3', 'v1', c.b), ('v2', 'v3', c.c), ('v3', 'v2', c.c)) x(column1, column2, column3)",
    "corr_spearman": f"WITH {WIDE}, rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY d{k}) + (count(*) OVER (PARTITION BY d{k}) - 1) / 2.0::DOUBLE r{k}" for k in (1, 2, 3)) + " FROM w WHERE pi < pj), c AS (SELECT corr(r1, r2) a, corr(r1, r3) b, corr(r2, r3) c FROM rk) SELECT x.column1 a, x.column2 b, round(x.column3, 9) r FROM c, LATERAL (VALUES ('v1', 'v1', 1.0::DOUBLE), ('v2', 'v2', 1.0), ('v3', 'v3', 1.0), ('v1', 'v2', c.a), ('v2', 'v1', c.a), ('v1', 'v3', c.b), ('v3', 'v1', c.b), ('v2', 'v3', c.c), ('v3', 'v2', c.c)) x(column1, column2, column3)",
    "corr_summary": f"WITH {WIDE}, c AS (SELECT abs(corr(d1, d2)) a, abs(corr(d1, d3)) b, abs(corr(d2, d3)) c FROM w WHERE pi < pj) SELECT 'v1' AS view, round((a + b) / 2, 9) mean_abs, round(greatest(a, b), 9) max_abs FROM c UNION ALL SELECT 'v2', round((a + c) / 2, 9), round(greatest(a, c), 9) FROM c UNION ALL SELECT 'v3', round((b + c) / 2, 9), round(greatest(b, c), 9) FROM c",
    "stratified_folds": f"WITH {FOLDS} SELECT id, y, fold FROM f",
    "fold_blocks": f"WITH {PAIRS}, {FOLDS.split(', f AS', 1)[1].join(['f AS', ''])}, k AS (SELECT DISTINCT fold FROM f), z AS (SELECT k.fold, CASE WHEN a.fold = k.fold THEN 'valid' ELSE 'train' END part, d FROM pairs p JOIN f a ON p.i = a.id JOIN f b ON p.j = b.id JOIN k ON b.fold <> k.fold WHERE view = 'v3') SELECT fold, part, count(*) n, round(avg(d), 9) mean FROM z GROUP BY ALL",
    "confusion_metrics": f"WITH {PTS}, {SINGLE}, c AS (SELECT view, {COUNTS} FROM sc GROUP BY view) SELECT view, tp, fp, tn, fn, {ALL_METRICS} FROM c",
    "pooled_metrics": f"WITH {RUNS}, c AS (SELECT config_key, model, {COUNTS} FROM ok GROUP BY ALL) SELECT config_key, model, tp, fp, tn, fn, {ALL_METRICS} FROM c",
    "config_status": f"WITH {STORED} SELECT config_key, count(DISTINCT fold) n_folds, count(*) FILTER (status = 'ok') n_ok, count(*) FILTER (status <> 'ok') n_bad, CASE WHEN n_bad > 0 THEN 'failed' WHEN n_folds < 5 THEN 'incomplete' ELSE 'ok' END status FROM fr GROUP BY config_key",
    "status_counts": f"WITH {STORED} SELECT model, status, count(*) n FROM fr GROUP BY ALL",
    "upsert_latest": f"WITH {FOLDS}, {STORED} SELECT config_key, fold, version, status, count(*)::INT n FROM fr JOIN f USING (fold) GROUP BY ALL",
    "pending_jobs": f"WITH {FOLDS}, {STORED} SELECT config_key, k fold FROM cfg, (SELECT DISTINCT fold k FROM f) WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.config_key = cfg.config_key AND st.fold = k)",
    "combined_distance": f"WITH {WIDE} SELECT pi, round(sum({DC}), 9) total, round(min({DC}), 9) least FROM w GROUP BY pi",
    "medoid_init": f"WITH {protos(3)} SELECT k, id, y FROM pr",
    "assign_prototypes": f"WITH {ASSIGN} SELECT i, y, k_plus, round(d_plus, 9) d_plus, k_minus, round(d_minus, 9) d_minus FROM a",
    "predict_global": f"WITH {ASSIGN} SELECT i, yi y, yk y_pred FROM dp QUALIFY row_number() OVER (PARTITION BY i ORDER BY dc, k) = 1",
    "predict_label": f"WITH {ASSIGN}, dl AS (SELECT i, yi, yk, CASE WHEN yk = 1 THEN dc ELSE 0.0 + 0.2::DOUBLE * d1 + 0.3::DOUBLE * d2 + 0.5::DOUBLE * d3 END dd FROM dp) SELECT i, yi y, yk y_pred FROM dl QUALIFY row_number() OVER (PARTITION BY i ORDER BY dd, yk) = 1",
    "glvq_loss": f"WITH {ASSIGN} SELECT round(sum({MU5}), 9) loss, count(*) n FROM a",
    "proto_priority": f"WITH {ASSIGN}, z AS (SELECT k, coalesce((SELECT sum(d_plus) FROM a WHERE k_plus = k), 0) - coalesce((SELECT sum(d_minus) FROM a WHERE k_minus = k), 0) p FROM pr) SELECT k, round(p, 9) priority, CAST(row_number() OVER (ORDER BY p DESC, k) AS INTEGER) rank FROM z",
    "swap_scan": swap(DC),
    "swap_scan_label": swap(f"CASE WHEN yi = 1 THEN {DC} ELSE 0.0 + 0.2::DOUBLE * d1 + 0.3::DOUBLE * d2 + 0.5::DOUBLE * d3 END"),
    "swap_scan_single": swap("0.0 + d3"),
    "weight_step_global": grads(""),
    "weight_step_label": grads("y"),
    "weight_step_linear": f"WITH {ASSIGN}, g AS (SELECT "
    + ", ".join(f"sum((p{v} * d_minus - q{v} * d_plus) / (d_plus + d_minus + 1e-5) ** 2) g{v}" for v in (1, 2, 3))
    + " FROM a), x AS ("
    + " UNION ALL ".join(f"SELECT 0 id, {v - 1} k, {a}::DOUBLE - 0.1::DOUBLE * g{v} / (abs(g1) + abs(g2) + abs(g3) + 1e-12) x FROM g" for v, a in ((1, 0.5), (2, 0.3), (3, 0.2)))
    + f"), {SIMPLEX} SELECT CAST(k AS INTEGER) v, round(greatest(x - theta, 0), 9) w FROM x JOIN t USING (id)",
    "simplex_project": f"WITH x AS (SELECT vec_id id, k - 1 k, embedding[k]::DOUBLE x FROM embeddings, range(1, 65) t(k)), {SIMPLEX} SELECT id vec_id, CAST(k AS INTEGER) k, round(greatest(x - theta, 0), 9) x FROM x JOIN t USING (id)",
    "normalise_vectors": "WITH x AS (SELECT vec_id, k - 1 k, embedding[k]::DOUBLE x FROM embeddings, range(1, 65) t(k)), s AS (SELECT vec_id, sqrt(sum(x * x)) n, sum(greatest(x, 0)) p FROM x GROUP BY 1) SELECT vec_id, CAST(k AS INTEGER) k, round(CASE WHEN n < 1e-12 THEN 0.125 ELSE x / n END, 9) + 0.0 unit, round(CASE WHEN p > 0 THEN greatest(x, 0) / p ELSE 1 / 64.0::DOUBLE END, 9) mixture FROM x JOIN s USING (vec_id)",
    "grid_jobs": f"WITH {PTS}, {CFG.replace('(VALUES (2), (3)) t2', '(VALUES (2), (3), (30)) t2').replace('(VALUES (2), (3)) t3', '(VALUES (2), (3), (300)) t3')} SELECT config_key || '|-|1' config_key, model, CAST(k0 AS INTEGER) k0, CAST(k1 AS INTEGER) k1, eta FROM cfg WHERE k0 <= (SELECT count(*) FROM pts WHERE y = 0) AND k1 <= (SELECT count(*) FROM pts WHERE y = 1)",
    "top_per_model": f"WITH {POOLED} SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY bal_acc DESC, config_key) AS INTEGER) rank, config_key, round(bal_acc, 9) bal_acc FROM pm QUALIFY rank <= 3",
    "best_config": f"WITH {POOLED} SELECT model, config_key, CAST(k0 AS INTEGER) k0, CAST(k1 AS INTEGER) k1, eta, round(bal_acc, 9) bal_acc FROM pm QUALIFY row_number() OVER (PARTITION BY model ORDER BY bal_acc DESC, config_key) = 1",
    "refine_grid": f"""WITH {POOLED}, b AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY model ORDER BY bal_acc DESC, config_key) = 1), e(n, x) AS (VALUES (0, 0.005::DOUBLE), (1, 0.01), (2, 0.02), (3, 0.05), (4, 0.1)),
 c AS (SELECT b.*, e.n FROM b JOIN e ON b.eta = e.x) SELECT DISTINCT model, CAST(a AS INTEGER) k0, CAST(z AS INTEGER) k1, e.x eta FROM c JOIN e ON abs(e.n - c.n) <= 1, range(2, 11) t8(a), range(2, 11) t9(z) WHERE a BETWEEN k0 - 1 AND k0 + 1 AND z BETWEEN k1 - 1 AND k1 + 1""",
    "correct_rate": f"WITH {RUNS} SELECT CAST(pos AS INTEGER) va_idx, count(*) n_valid, round(avg((y_true = y_pred)::INT), 9) correct_rate, CAST(sum(CASE WHEN y_pred = 1 THEN 1 ELSE -1 END) > 0 AS INTEGER) pred_majority FROM ok GROUP BY pos",
    "link_structure": f"WITH {JOINED} SELECT view, id, y, round(mu, 9) + 0.0 mu, round(d_plus, 9) d_plus, round(d_minus, 9) d_minus, round(knn_purity, 9) knn_purity, round(knn_mean, 9) knn_mean, y_pred, correct FROM jn",
    "wide_pivot": f"WITH {WIDEPT} SELECT id, y, " + ", ".join(f"correct_{v}" for v in VIEWS) + ", " + ", ".join(f"round({m}_{v}, 9) + 0.0 {m}_{v}" for m in ("knn_purity", "mu", "knn_mean") for v in VIEWS) + " FROM wp",
    "perf_vs_structure": f"WITH {JOINED} SELECT view, correct, count(*) n, " + ", ".join(f"round(avg({m}), 9) + 0.0 mean_{m}" for m in ("knn_purity", "mu", "knn_mean", "difficulty")) + " FROM jn GROUP BY view, correct",
    "error_by_quantile": f"WITH {JOINED}, e AS (SELECT view, list_distinct(quantile_cont(mu, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) edges FROM jn GROUP BY view HAVING count(DISTINCT mu) >= 3) SELECT view, CAST(greatest(len([x for x in edges if x < mu]), 1) AS INTEGER) bin, count(*) n, round(avg(1 - correct), 9) error FROM jn JOIN e USING (view) GROUP BY ALL",
    "dominance_groups": f"WITH {WIDEPT}, d AS (SELECT CASE WHEN correct_v1 + correct_v2 + correct_v3 = 0 THEN 'none' ELSE concat_ws('+', CASE WHEN correct_v1 = 1 THEN 'v1' END, CASE WHEN correct_v2 = 1 THEN 'v2' END, CASE WHEN correct_v3 = 1 THEN 'v3' END) END dominance, correct_v1 + correct_v2 + correct_v3 r FROM wp) SELECT dominance, count(*) n, round(avg(r), 9) mean_correct, round(count(*)::DOUBLE / (SELECT count(*) FROM d), 9) share FROM d GROUP BY dominance",
    "alignment_best_view": f"WITH {WIDEPT}, b AS (SELECT *, CASE WHEN knn_purity_v1 >= knn_purity_v2 AND knn_purity_v1 >= knn_purity_v3 THEN 'v1' WHEN knn_purity_v2 >= knn_purity_v3 THEN 'v2' ELSE 'v3' END best FROM wp) SELECT best, count(*) n, round(avg(CASE best WHEN 'v1' THEN correct_v1 WHEN 'v2' THEN correct_v2 ELSE correct_v3 END), 9) best_correct FROM b GROUP BY best",
    "alignment_least_mu": f"WITH {WIDEPT}, b AS (SELECT *, CASE WHEN mu_v1 <= mu_v2 AND mu_v1 <= mu_v3 THEN 'v1' WHEN mu_v2 <= mu_v3 THEN 'v2' ELSE 'v3' END best FROM wp) SELECT best, count(*) n, round(avg(CASE best WHEN 'v1' THEN correct_v1 WHEN 'v2' THEN correct_v2 ELSE correct_v3 END), 9) best_correct FROM b GROUP BY best",
    "complementarity": f"WITH {PTS}, {SINGLE}, z AS (SELECT a.view a, b.view b, sum(a.correct * b.correct)::BIGINT \"both\", sum(a.correct * (1 - b.correct))::BIGINT only_a, sum((1 - a.correct) * b.correct)::BIGINT only_b, sum((1 - a.correct) * (1 - b.correct))::BIGINT neither FROM sc a JOIN sc b ON a.id = b.id AND a.view < b.view GROUP BY ALL) SELECT *, round(\"both\"::DOUBLE / (\"both\" + only_a + only_b), 9) jaccard FROM z",
    "perf_comparison": f"""WITH {POOLED}, {SINGLE}, {FIXED}, s0 AS (SELECT view, {COUNTS} FROM sc GROUP BY view), bl AS (
 SELECT 'single' block, view AS name, {METRICS["balanced_accuracy"]} ba, {METRICS["recall"]} rc FROM s0
 UNION ALL SELECT 'multi', model, balanced_accuracy, recall FROM (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY model ORDER BY bal_acc DESC, config_key) = 1)
 UNION ALL SELECT 'fixed', profile, avg(correct), NULL FROM fx GROUP BY profile)
 SELECT block, name, round(ba, 9) balanced_accuracy, round(rc, 9) recall, round(ba - (SELECT max(ba) FROM bl WHERE block = 'single'), 9) + 0.0 delta FROM bl""",
    "gain_loss": f"WITH {PTS}, {SINGLE}, {FIXED}, c AS (SELECT id, " + ", ".join(f"max(CASE WHEN view = '{v}' THEN correct END) {v}" for v in VIEWS) + " FROM sc GROUP BY id), z AS (SELECT fx.*, v1, v2, v3, greatest(v1, v2, v3) any_, v3 best_ FROM fx JOIN c USING (id)) SELECT profile, " + ", ".join(f"count(*) FILTER (correct = 1 AND {c} = 0) gain_{n}, count(*) FILTER (correct = 0 AND {c} = 1) loss_{n}, count(*) FILTER (correct = 1 AND {c} = 0) - count(*) FILTER (correct = 0 AND {c} = 1) net_{n}" for n, c in (("any", "any_"), ("best", "best_"), ("v1", "v1"), ("v2", "v2"), ("v3", "v3"))) + " FROM z GROUP BY profile",
    "crosstab_dominance": f"""WITH {WIDEPT}, t AS (SELECT *, correct_v1 + correct_v2 + correct_v3 n, greatest(knn_purity_v1, knn_purity_v2, knn_purity_v3) top FROM wp),
 u AS (SELECT CASE WHEN n = 3 THEN 'all' WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'several' WHEN correct_v1 = 1 THEN 'v1' WHEN correct_v2 = 1 THEN 'v2' ELSE 'v3' END prediction,
  CASE WHEN (abs(knn_purity_v1 - top) <= 1e-8 + 1e-5 * abs(top))::INT + (abs(knn_purity_v2 - top) <= 1e-8 + 1e-5 * abs(top))::INT + (abs(knn_purity_v3 - top) <= 1e-8 + 1e-5 * abs(top))::INT > 1 THEN 'tied' WHEN knn_purity_v1 = top THEN 'v1' WHEN knn_purity_v2 = top THEN 'v2' ELSE 'v3' END s FROM t),
 o(place, prediction) AS (VALUES (0, 'v1'), (1, 'v2'), (2, 'v3'), (3, 'all'), (4, 'several'), (5, 'none'))
 SELECT place, prediction, {", ".join(f"(SELECT count(*) FROM u WHERE u.prediction = o.prediction AND s = '{c}') n_{c}" for c in ("v1", "v2", "v3", "tied"))} FROM o""",
    "profile_dominance": f"""WITH {PTS}, {SINGLE}, {FIXED}, c AS (SELECT id, {", ".join(f"max(CASE WHEN view = '{v}' THEN correct END) {v}" for v in VIEWS)} FROM sc GROUP BY id),
 d AS (SELECT id, CASE WHEN v1 + v2 + v3 = 0 THEN 'none' ELSE concat_ws('+', CASE WHEN v1 = 1 THEN 'v1' END, CASE WHEN v2 = 1 THEN 'v2' END, CASE WHEN v3 = 1 THEN 'v3' END) END dominance FROM c),
 z AS (SELECT dominance, profile, sum(correct)::BIGINT hits, count(*)::BIGINT n FROM d JOIN fx USING (id) GROUP BY ALL), y AS (FROM z UNION ALL SELECT 'total', profile, sum(hits)::BIGINT, sum(n)::BIGINT FROM z GROUP BY profile)
 SELECT dominance, profile, format('{{:d}} ({{:+d}})', hits, hits - n) cell FROM y""",
    "boxplot_stats": f"""WITH {JOINED}, q AS (SELECT view, correct, count(*) n, quantile_cont(mu, 0.25) a, quantile_cont(mu, 0.5) b, quantile_cont(mu, 0.75) c FROM jn GROUP BY ALL),
 e AS (SELECT view, correct, min(mu) lo, max(mu) hi FROM jn JOIN q USING (view, correct) WHERE mu BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) GROUP BY ALL)
 SELECT view, correct, n, round(a, 9) + 0.0 q25, round(b, 9) + 0.0 median, round(c, 9) + 0.0 q75, round(lo, 9) + 0.0 whisker_low, round(hi, 9) + 0.0 whisker_high FROM q JOIN e USING (view, correct)""",
    "weights_long": f"WITH {WEIGHTS} " + " UNION ALL ".join(f"SELECT config_key, model, eta, fold, label, '{v}' AS view, round(w_{v}, 9) w FROM ww" for v in VIEWS),
    "weights_wide": f"WITH {WEIGHTS} SELECT config_key, model, eta, fold, label, " + ", ".join(f"round(w_{v}, 9) w_{v}" for v in VIEWS) + ", round(entropy, 9) entropy, round(max_weight, 9) max_weight, dominant FROM wx",
    "weight_means": f"WITH {WEIGHTS} SELECT model, eta, " + ", ".join(f"round(avg(w_{v}), 9) mean_{v}" for v in VIEWS) + ", " + ", ".join(f"count(*) FILTER (dominant = '{v}') dominant_{v}" for v in VIEWS) + ", round(avg(entropy), 9) entropy FROM wx GROUP BY model, eta",
    "weight_means_config": f"WITH {WEIGHTS} SELECT config_key, " + ", ".join(f"round(avg(w_{v}), 9) mean_{v}" for v in VIEWS) + ", " + ", ".join(f"count(*) FILTER (dominant = '{v}') dominant_{v}" for v in VIEWS) + ", round(avg(entropy), 9) entropy FROM wx GROUP BY config_key",
    "weight_means_label": f"WITH {WEIGHTS} SELECT model, label, " + ", ".join(f"round(avg(w_{v}), 9) mean_{v}" for v in VIEWS) + ", " + ", ".join(f"count(*) FILTER (dominant = '{v}') dominant_{v}" for v in VIEWS) + ", round(avg(entropy), 9) entropy FROM wx GROUP BY model, label",
    "weight_groups": f"WITH {WEIGHTS} SELECT config_key, fold, label, weight_class FROM wc",
    "label_distance": f"WITH {LABELS} SELECT config_key, eta, fold, round(label_distance, 9) label_distance FROM ld",
    "share_by_group": f"WITH {WEIGHTS}, z AS (SELECT eta, coalesce(label, -1) AS label, weight_class, count(*) n FROM wc GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY eta, label), 9) share FROM z",
    "share_by_group_wide": f"WITH {WEIGHTS} SELECT eta, coalesce(label, -1) AS label, " + ", ".join(f"round(count(*) FILTER (weight_class = '{c}')::DOUBLE / count(*), 9) {c}" for c in ("near_uniform", "single", "mix", "mixed")) + " FROM wc GROUP BY ALL",
    "eta_stats": f"WITH {LABELS} SELECT eta, count(label_distance) n, round(avg(label_distance), 9) mean, round(stddev_samp(label_distance), 9) std, round(quantile_cont(label_distance, 0.5), 9) median FROM ld GROUP BY eta",
    "value_percent": f"WITH {WEIGHTS} SELECT dominant, count(*) n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM wx), 9) percent FROM wx GROUP BY dominant",
    "fold_accuracy": f"WITH {FOLDACC} SELECT config_key, fold, round(ba, 9) balanced_accuracy FROM fa",
    "top_runs": f"WITH {FOLDACC}, z AS (SELECT config_key, fold, round(ba, 9) b FROM fa) SELECT config_key, fold FROM z WHERE b >= (SELECT quantile_cont(b, 0.75) FROM z)",
    "cluster_cores": f"""WITH {WEIGHTS}, z AS (SELECT *, round(sqrt((w_v1 - 1 / 3.0::DOUBLE) ** 2 + (w_v2 - 1 / 3.0::DOUBLE) ** 2 + (w_v3 - 1 / 3.0::DOUBLE) ** 2), 9) dist FROM wx),
 y AS (SELECT *, row_number() OVER (PARTITION BY dominant ORDER BY dist, config_key, fold, label NULLS FIRST) r, count(*) OVER (PARTITION BY dominant) n FROM z), x AS (SELECT dominant "cluster", max(n) size, avg(w_v1) v1, avg(w_v2) v2, avg(w_v3) v3 FROM y WHERE r <= greatest(floor(n * 0.2), 1) GROUP BY 1)
 SELECT "cluster", size, round(v1, 9) v1, round(v2, 9) v2, round(v3, 9) v3, CASE WHEN v1 >= v2 AND v1 >= v3 THEN 'v1' WHEN v2 >= v3 THEN 'v2' ELSE 'v3' END dominant FROM x""",
    "paired_delta": f"WITH {FOLDACC}, c AS (SELECT model, fold, eta, avg(ba) b FROM fa GROUP BY ALL), z AS (SELECT x.model, y.b - x.b d FROM c x JOIN c y ON x.model = y.model AND x.fold = y.fold WHERE x.eta = 0.01 AND y.eta = 0.05) SELECT model, round(avg(d), 9) + 0.0 mean, round(stddev_samp(d), 9) std, count(*) n FROM z GROUP BY model",
}

OVERLAP = f"{NEAR}, o AS (SELECT a.view a, b.view b, a.i, count(*) FILTER (b2.pj IS NOT NULL) x FROM near a JOIN (VALUES ('v1'), ('v2'), ('v3')) b(view) ON true LEFT JOIN near b2 ON b2.view = b.view AND b2.i = a.i AND b2.pj = a.pj GROUP BY ALL), oj AS (SELECT a, b, i, x::DOUBLE / (20 - x) jaccard FROM o), om AS (SELECT a, b, avg(jaccard) ov FROM oj GROUP BY ALL)"
ORACLES["knn_overlap"] = f"WITH {OVERLAP} SELECT a, b, round(ov, 9) overlap FROM om"
ORACLES["overlap_summary"] = f"WITH {OVERLAP} SELECT a AS view, round(avg(ov), 9) mean, round(min(ov), 9) least, round(max(ov), 9) greatest FROM om WHERE a <> b GROUP BY a"
AGREE = f"{UP}, th AS (SELECT view, quantile_cont(d, 0.1) t FROM up GROUP BY view), sm AS (SELECT view, pi, pj, yi = yj same, d <= t s FROM up JOIN th USING (view)), ab AS (SELECT x.view a, y.view b, unnest(['all', CASE WHEN x.same THEN 'same' ELSE 'diff' END]) subset, x.s sa, y.s sb FROM sm x JOIN sm y ON x.pi = y.pi AND x.pj = y.pj AND x.view < y.view), ag AS (SELECT a, b, subset, avg((sa AND sb)::INT) p, avg((NOT sa AND NOT sb)::INT) q, avg((sa AND NOT sb)::INT) r, avg((NOT sa AND sb)::INT) u, count(*) n FROM ab GROUP BY ALL)"
ORACLES["agreement"] = f"WITH {AGREE} SELECT a, b, subset, round(p, 9) agree_similar, round(q, 9) agree_dissimilar, round(r, 9) a_only, round(u, 9) b_only, n n_pairs FROM ag"
ORACLES["disagreement"] = f"WITH {AGREE} SELECT a, b, round(r + u, 9) disagreement FROM ag WHERE subset = 'all'"
ORACLES["entropy_drift"] = f"""WITH {FOLDS}, {WEIGHTS}, fw AS (SELECT config_key, fold, max(entropy) FILTER (coalesce(label, 0) = 0) entropy, list(w ORDER BY label, v) a FROM (SELECT config_key, fold, coalesce(label, 0) AS label, entropy, unnest([w_v1, w_v2, w_v3]) w, unnest([1, 2, 3]) v FROM wx) GROUP BY ALL),
 fv AS (SELECT fold, list(pos ORDER BY pos) s FROM f GROUP BY fold), z AS (SELECT config_key, fold, entropy, a, s, lag(a) OVER (PARTITION BY config_key ORDER BY fold) pa, lag(s) OVER (PARTITION BY config_key ORDER BY fold) ps FROM fw JOIN fv USING (fold))
 SELECT config_key, fold checkpoint, round(entropy, 9) entropy, round(CASE WHEN pa IS NOT NULL THEN list_distance(a, pa) END, 9) weight_drift, round(CASE WHEN ps IS NOT NULL THEN 1 - len(list_intersect(s, ps))::DOUBLE / len(list_distinct(list_concat(s, ps))) END, 9) proto_drift FROM z"""

ORACLES["winner_weights"] = f"SELECT l.model, l.label, l.view, round(avg(l.w), 9) w FROM ({ORACLES['weights_long']}) l JOIN ({ORACLES['best_config']}) b ON l.config_key = b.config_key GROUP BY ALL"
ORACLES["recall_by_config"] = f"SELECT config_key, s.status, recall FROM ({ORACLES['config_status']}) s LEFT JOIN ({ORACLES['pooled_metrics']}) p USING (config_key)"
ORACLES["purity_ranking"] = f"WITH {PAIRS}, {GROUPS}, z AS (SELECT view, avg(knn_purity) p FROM purity GROUP BY view) SELECT view, round(p, 9) purity_mean, CAST(row_number() OVER (ORDER BY p DESC, view) AS INTEGER) rank FROM z"
PIVOTED = ", ".join(f"max({{0}}) FILTER (b = '{v}') {v}" for v in VIEWS)
ORACLES["pearson_table"] = f"WITH z AS ({ORACLES['corr_pearson']}) SELECT a, {PIVOTED.format('r')} FROM z GROUP BY a"
ORACLES["overlap_table"] = f"WITH z AS ({ORACLES['knn_overlap']}) SELECT a, {PIVOTED.format('overlap')} FROM z GROUP BY a"
ORACLES["models_by_prefix"] = f"WITH {STORED} SELECT model, config_key, count(*) n FROM fr WHERE model LIKE 'lab%' GROUP BY ALL"
ORACLES["derived_seeds"] = f"WITH {PTS} SELECT id, ('0x' || substr(sha256(pos || '|v1|' || y), 1, 8))::BIGINT seed FROM pts"
ROBUST = "view, " + ", ".join(f"{c} robust_{c}" for c in ("mu_count", "mu_mean", "mu_std", "mu_min", "mu_q25", "mu_q50", "mu_q75", "mu_max", "frac_negative", "frac_zero"))
SUMMARY = [ORACLES[n] for n in ("basic_checks", "quantile_dist", "row_mean_describe", "knn_mean", "intrinsic_dim_2nn", "intra_inter", "margin_summary", "zero_stats")] + [
    f"SELECT {ROBUST} FROM ({ORACLES['robust_margin']})",
    f"WITH {PAIRS}, z AS (SELECT DISTINCT view, i, yi FROM pairs) SELECT view, count(*) FILTER (yi = 0) n_class0, count(*) FILTER (yi = 1) n_class1 FROM z GROUP BY view",
    f"WITH {PAIRS}, {GROUPS} SELECT view, round(avg(knn_purity), 9) purity_mean, round(stddev_pop(knn_purity), 9) purity_std FROM purity GROUP BY view",
    f"SELECT view, baseline_mean purity_baseline_mean, baseline_std purity_baseline_std, z purity_z FROM ({ORACLES['purity_permutation']})",
    f"WITH {UP} SELECT view, count(DISTINCT d) n_unique FROM up GROUP BY view",
]
ORACLES["structural_summary"] = f"SELECT * FROM ({SUMMARY[0]}) " + " ".join(f"LEFT JOIN ({x}) USING (view)" for x in SUMMARY[1:])


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
