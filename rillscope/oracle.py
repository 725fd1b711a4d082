"""DuckDB SQL of the registered queries, composed of shared table expressions."""

from __future__ import annotations

RTT = """rtt AS (
  SELECT event_type AS series_id, event_id AS seq, epoch_us(ts) AS epoch_us, epoch_us(ts) / 1e6 AS epoch, value AS rtt_value
  FROM events WHERE value > 0 AND value <= 10000)"""
MINS = """mins AS (
  SELECT series_id, bin_us, min(us) AS epoch_us, min(us) / 1e6 AS epoch, min(rtt_value) AS rtt_value
  FROM (SELECT series_id, epoch_us AS us, epoch_us - epoch_us % 900000000 AS bin_us, rtt_value FROM rtt) GROUP BY series_id, bin_us)"""
INDEXED = """idx AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY epoch_us) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM mins)"""
CPS = "cps AS (SELECT series_id, epoch, least(1.0, rtt_value / 20) AS confidence FROM idx WHERE i % 40 = 0)"
PERIODS = """periods AS (
  SELECT * FROM (SELECT series_id, row_number() OVER w - 1 AS cp_idx, lag(epoch) OVER w AS prev_epoch, epoch AS start_epoch, lead(epoch) OVER w AS end_epoch
  FROM cps WINDOW w AS (PARTITION BY series_id ORDER BY epoch)) WHERE prev_epoch IS NOT NULL AND end_epoch IS NOT NULL)"""
JIT = """jit AS (
  SELECT series_id, epoch_us, epoch, rtt_value - lag(rtt_value) OVER (PARTITION BY series_id ORDER BY epoch_us) AS jitter FROM mins QUALIFY jitter IS NOT NULL)"""
IQR = """iqr AS (
  SELECT series_id, epoch_us, epoch, iqr FROM (SELECT *, quantile_cont(jitter, 0.75) OVER w - quantile_cont(jitter, 0.25) OVER w AS iqr, count(*) OVER w AS c
  FROM jit WINDOW w AS (PARTITION BY series_id ORDER BY epoch_us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE c = 9)"""
DISP = """disp AS (
  SELECT series_id, epoch_us, epoch, dispersion FROM (SELECT *, avg(iqr) OVER w AS dispersion, count(*) OVER w AS c
  FROM iqr WINDOW w AS (PARTITION BY series_id ORDER BY epoch_us ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)) WHERE c = 6)"""
RAWJIT = """rawjit AS (
  SELECT series_id, epoch_us, seq, epoch, rtt_value - lag(rtt_value) OVER (PARTITION BY series_id ORDER BY epoch_us, seq) AS jitter FROM rtt QUALIFY jitter IS NOT NULL)"""


def _stats(values: str, column: str) -> str:
    return f"""(SELECT p.series_id, p.cp_idx, p.start_epoch, p.end_epoch,
    avg(v.{column}) FILTER (v.epoch >= p.start_epoch) AS mean_now, avg(v.{column}) FILTER (v.epoch < p.start_epoch) AS mean_before,
    count(*) FILTER (v.epoch >= p.start_epoch) AS n_now, count(*) FILTER (v.epoch < p.start_epoch) AS n_before,
    stddev_pop(v.{column}) FILTER (v.epoch < p.start_epoch) AS std_before
  FROM periods p JOIN {values} v ON v.series_id = p.series_id AND v.epoch >= p.prev_epoch AND v.epoch <= p.end_epoch GROUP BY ALL)"""


JUMPS = f"""jumps AS (
  SELECT series_id, cp_idx, start_epoch, end_epoch, mean_now - mean_before AS magnitude, mean_now - mean_before > 0.5 AS has_jump, 0.5::DOUBLE AS threshold
  FROM {_stats("mins", "rtt_value")} WHERE n_now >= 1 AND n_before >= 1)"""
DJIT = f"""djit AS (
  SELECT series_id, cp_idx, start_epoch, end_epoch, mean_now - mean_before AS jitter_metric, mean_now > mean_before + 0.25 AS has_significant_jitter, 0.25::DOUBLE AS jitter_threshold, NULL::DOUBLE AS p_value
  FROM {_stats("disp", "dispersion")} WHERE n_now >= 2 AND n_before >= 1)"""
EV = "ev AS (SELECT j.*, d.jitter_metric, d.has_significant_jitter, d.jitter_threshold, d.p_value FROM jumps j JOIN djit d USING (series_id, cp_idx))"
INF = """inf AS (
  SELECT *, CASE WHEN is_congested THEN least(1.0, 0.8 + CASE WHEN magnitude > 2 * threshold THEN 0.1 ELSE 0 END) ELSE 0.0 END::DOUBLE AS confidence
  FROM (SELECT *, coalesce(last_value(CASE WHEN has_jump AND has_significant_jitter THEN true WHEN NOT has_jump THEN false END IGNORE NULLS)
    OVER (PARTITION BY series_id ORDER BY start_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_congested FROM ev))"""
BASE = [RTT, MINS]
TO_CPS = [*BASE, INDEXED, CPS, PERIODS]
TO_DISP = [JIT, IQR, DISP]
TO_INF = [*TO_CPS, *TO_DISP, JUMPS, DJIT, EV, INF]


def scores_cte(kind: str) -> str:
    """Two-window scores, from direct window sums."""
    mean = "abs(mr - ml) / sqrt((vl + vr) / 2)"
    score = f"{mean} * sqrt(w / 2.0) + 0.8 * ln(greatest(vl / vr, vr / vl)) * sqrt(w)" if kind == "bayes" else f"{mean} + 0.5 * ln(greatest(vl / vr, vr / vl)) * sqrt(w)"
    return f"""scores AS (
  SELECT series_id, i, epoch, {score} AS score FROM (
    SELECT a.series_id, a.i, a.epoch, a.w, avg(b.rtt_value) FILTER (b.i < a.i) AS ml, avg(b.rtt_value) FILTER (b.i >= a.i) AS mr,
      greatest(var_pop(b.rtt_value) FILTER (b.i < a.i), 0.001) AS vl, greatest(var_pop(b.rtt_value) FILTER (b.i >= a.i), 0.001) AS vr
    FROM (SELECT *, greatest(20, n // 30)::INT AS w FROM idx) a JOIN idx b ON a.series_id = b.series_id AND b.i >= a.i - a.w AND b.i < a.i + a.w
    WHERE a.n >= 10 AND a.i >= a.w AND a.i < a.n - a.w AND (a.i - a.w) % greatest(5, a.w // 4) = 0 GROUP BY a.series_id, a.i, a.epoch, a.w))"""


def gap_fold(source: str, gap: float, name: str) -> str:
    """Keep rows of ``source`` (series_id, epoch, confidence) at least ``gap`` after the last kept one."""
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY epoch) AS k FROM {source}),
{name}_r AS (
  SELECT series_id, k, epoch, confidence, epoch AS last, true AS kept FROM {name}_k WHERE k = 1
  UNION ALL SELECT c.series_id, c.k, c.epoch, c.confidence, CASE WHEN c.epoch - r.last >= {gap} THEN c.epoch ELSE r.last END, c.epoch - r.last >= {gap}
  FROM {name}_r r JOIN {name}_k c ON c.series_id = r.series_id AND c.k = r.k + 1),
{name} AS (SELECT series_id, epoch, confidence FROM {name}_r WHERE kept)"""


def replace_fold(source: str, gap: float, name: str) -> str:
    """Like gap_fold, but a surer row replaces the one before it."""
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY epoch) AS k FROM {source}),
{name}_r AS (
  SELECT series_id, k, epoch AS e, confidence AS c, 1 AS slot FROM {name}_k WHERE k = 1
  UNION ALL SELECT n.series_id, n.k, CASE WHEN n.epoch - r.e >= {gap} OR n.confidence > r.c THEN n.epoch ELSE r.e END,
    CASE WHEN n.epoch - r.e >= {gap} OR n.confidence > r.c THEN n.confidence ELSE r.c END, CASE WHEN n.epoch - r.e >= {gap} THEN r.slot + 1 ELSE r.slot END
  FROM {name}_r r JOIN {name}_k n ON n.series_id = r.series_id AND n.k = r.k + 1),
{name} AS (SELECT series_id, arg_max(e, k) AS epoch, arg_max(c, k) AS confidence FROM {name}_r GROUP BY series_id, slot)"""


LEVEL_CPS = [
    *BASE,
    INDEXED,
    scores_cte("level"),
    "lcand AS (SELECT series_id, epoch, least(1.0, score / (1.5 * (0.2 * 0.25 / 1.5))) AS confidence FROM scores WHERE score > 0.2 * 0.25 / 1.5)",
    gap_fold("lcand", 1800, "lkept"),
    """lcap AS (SELECT series_id, epoch, confidence FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS c, row_number() OVER (PARTITION BY series_id ORDER BY confidence DESC, epoch) AS r FROM lkept) WHERE c <= 45 OR r <= 35)""",
]


def sql(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def r(*names: str) -> str:
    """Rounded output columns."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def online_ctes(hazard: float = 1 / 250, level: float = 0.9, least: int = 5, prune: float = 1e-6) -> list[str]:
    """Change points of the minima by the recursion over run lengths; a list of hypotheses goes from row to row."""
    spread, off = "(2 * h.beta * (h.n + 2) / (h.n + 1))", "(d.rtt_value - h.mu)"
    told = f"""{{'s': h.s, 'lp': h.lp + lgamma(1.5 + h.n / 2) - lgamma(1 + h.n / 2) - 0.5 * ln(pi() * {spread}) - (1.5 + h.n / 2) * ln(1 + {off} * {off} / {spread}),
        'n': h.n + 1, 'mu': ((1 + h.n) * h.mu + d.rtt_value) / (h.n + 2), 'beta': h.beta + (1 + h.n) * {off} * {off} / (2 * (h.n + 2))}}"""
    older = f"list_transform(r.hs, lambda h: {{'s': h.s, 'lp': h.lp + ln(1 - {hazard}), 'n': h.n, 'mu': h.mu, 'beta': h.beta}})"
    fresh = f"{{'s': d.epoch, 'lp': ln({hazard}), 'n': 0::DOUBLE, 'mu': r.prior, 'beta': 1::DOUBLE}}"
    return [
        "rows_in_order AS MATERIALIZED (SELECT series_id, i, epoch, rtt_value FROM idx)",
        f"""runs AS (
  SELECT series_id, i, epoch, rtt_value AS prior, epoch AS accepted, [{{'s': epoch, 'lp': 0::DOUBLE, 'n': 1::DOUBLE, 'mu': rtt_value, 'beta': 1::DOUBLE}}] AS hs, NULL::DOUBLE AS cp, NULL::DOUBLE AS after FROM rows_in_order WHERE i = 0
  UNION ALL SELECT series_id, i, epoch, prior, CASE WHEN hit THEN b.s ELSE accepted END, hs, CASE WHEN hit THEN b.s END, after FROM (
    SELECT *, after >= {level} AND b.n >= {least} AND b.s > accepted AS hit FROM (
      SELECT *, coalesce(list_sum(list_transform(list_filter(hs, lambda h: h.s > accepted), lambda h: exp(h.lp))), 0) AS after, hs[list_position(list_transform(hs, lambda h: h.lp), list_max(list_transform(hs, lambda h: h.lp)))] AS b FROM (
        SELECT series_id, i, epoch, prior, accepted, list_transform(kept, lambda h: {{'s': h.s, 'lp': h.lp - (top + ln(total)), 'n': h.n, 'mu': h.mu, 'beta': h.beta}}) AS hs FROM (
          SELECT *, list_sum(list_transform(kept, lambda h: exp(h.lp - top))) AS total FROM (
            SELECT *, list_filter(told, lambda h: h.lp >= top + ln({prune})) AS kept FROM (
              SELECT *, list_max(list_transform(told, lambda h: h.lp)) AS top FROM (
                SELECT d.series_id, d.i, d.epoch, r.prior, r.accepted, list_transform(list_append({older}, {fresh}), lambda h: {told}) AS told
                FROM runs r JOIN rows_in_order d ON d.series_id = r.series_id AND d.i = r.i + 1)))))))) ,
online AS (SELECT series_id, cp AS epoch, least(1.0, after) AS confidence, epoch AS detected_epoch FROM runs WHERE cp IS NOT NULL)""",
    ]


def grid_ctes(threshold: float = 0.25, gap: float = 1800) -> list[str]:
    """The choice of Welch candidates: the best of each cell of a time grid, then by rank while there are few.

    Needs ``ws`` (series_id, i, epoch, n, score), ``wm`` (mu, sd) and ``mins``.
    """
    level = lambda k, least: f"greatest(mu + {k * threshold} * sd, {least})"
    apart = lambda width: f"len(list_filter(taken, lambda t: abs(best - t) < {width})) = 0"
    return [
        f"""gc AS MATERIALIZED (SELECT series_id, epoch, score, prio, row_number() OVER (PARTITION BY series_id ORDER BY prio, score DESC, epoch) AS r
  FROM (SELECT ws.series_id, epoch, score, CASE WHEN score > {level(3, 1.0)} THEN 1 WHEN score > {level(1.5, 0.7)} THEN 2 ELSE 3 END AS prio FROM ws JOIN wm USING (series_id) WHERE score > {level(0.5, 0.3)}))""",
        f"""gb AS MATERIALIZED (SELECT series_id, lo, hi, (hi - lo) / 35 AS cell, greatest({gap}, 0.5 * ((hi - lo) / 35)) AS width, cs FROM
  (SELECT series_id, min(epoch) AS lo, max(epoch) AS hi FROM mins GROUP BY 1) JOIN (SELECT series_id, list(epoch ORDER BY r) AS cs FROM gc GROUP BY 1) USING (series_id))""",
        f"""gg AS (SELECT series_id, 0 AS k, lo AS here, []::DOUBLE[] AS taken FROM gb
  UNION ALL SELECT series_id, k + 1, here + cell, CASE WHEN best IS NOT NULL AND {apart("width")} THEN list_append(taken, best) ELSE taken END FROM (
    SELECT gg.*, gb.cell, gb.width, list_filter(gb.cs, lambda c: c >= gg.here AND c <= gg.here + gb.cell AND NOT list_contains(gg.taken, c))[1] AS best FROM gg JOIN gb USING (series_id) WHERE gb.cell > 0 AND gg.here < gb.hi))""",
        "gs AS (SELECT series_id, arg_max(taken, k) AS taken FROM gg GROUP BY 1)",
        f"""gr AS (SELECT series_id, 0 AS k, taken, len(taken) < 25 AS few FROM gs
  UNION ALL SELECT series_id, k, CASE WHEN few AND prio <= 2 AND len(taken) < 40 AND NOT list_contains(taken, best) AND {apart(gap)} THEN list_append(taken, best) ELSE taken END, few
    FROM (SELECT gr.series_id, gc.r AS k, gr.taken, gr.few, gc.prio, gc.epoch AS best FROM gr JOIN gc ON gc.series_id = gr.series_id AND gc.r = gr.k + 1))""",
        "grid_cps AS (SELECT g.series_id, g.epoch, least(1.0, gc.score / 10) AS confidence FROM (SELECT series_id, unnest(arg_max(taken, k)) AS epoch FROM gr GROUP BY 1) g JOIN gc ON gc.series_id = g.series_id AND gc.epoch = g.epoch)",
    ]


#: Kolmogorov-Smirnov statistics of raw jitter in ``periods``, and exact p-values by counting lattice paths diagonal by diagonal.
KS = [
    """ks_in AS (SELECT p.series_id, p.cp_idx, p.start_epoch, p.end_epoch, v.jitter, CASE WHEN v.epoch >= p.start_epoch THEN 1 ELSE 0 END AS cur
  FROM periods p JOIN rawjit v ON v.series_id = p.series_id AND v.epoch >= p.prev_epoch AND v.epoch <= p.end_epoch)""",
    """ks AS MATERIALIZED (SELECT series_id, cp_idx, start_epoch, end_epoch, max(abs(cn / nn - cb / nb)) AS d, max(nb)::BIGINT AS n, max(nn)::BIGINT AS m FROM (
  SELECT *, sum(cur) OVER e AS nn, sum(1 - cur) OVER e AS nb, sum(cur) OVER u AS cn, sum(1 - cur) OVER u AS cb FROM ks_in
  WINDOW e AS (PARTITION BY series_id, cp_idx), u AS (PARTITION BY series_id, cp_idx ORDER BY jitter RANGE UNBOUNDED PRECEDING)) WHERE nn >= 2 AND nb >= 1 GROUP BY ALL)""",
    """paths AS (SELECT series_id, cp_idx, d, n, m, 0 AS s, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS inside FROM ks
  UNION ALL SELECT series_id, cp_idx, d, n, m, s + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN s + 1 - i < 0 OR s + 1 - i > m OR (abs(i / n - (s + 1 - i) / m) >= d - 1e-12 AND s + 1 < n + m) THEN 0.0
      ELSE inside[i + 1] * ((s + 1 - i) / (s + 1)) + CASE WHEN i > 0 THEN inside[i] * (i / (s + 1)) ELSE 0.0 END END) FROM paths WHERE s < n + m)""",
    "ksp AS (SELECT ks.*, least(1.0, greatest(0.0, 1.0 - paths.inside[ks.n + 1])) AS p_value FROM ks JOIN paths ON paths.series_id = ks.series_id AND paths.cp_idx = ks.cp_idx AND paths.s = ks.n + ks.m)",
]
KS_JIT = "djit AS (SELECT series_id, cp_idx, start_epoch, end_epoch, d AS jitter_metric, p_value < 0.05 AS has_significant_jitter, 0.05::DOUBLE AS jitter_threshold, p_value FROM ksp)"


def partition_ctes(model: str, penalty: float = 7.5, jump: int = 5, least: int = 2) -> list[str]:
    """The cheapest partition on a grid of ``jump`` bins by dynamic programming over all starts, and a lower penalty where it has fewer than ten bounds.

    Needs ``idx``; gives ``part_cps``.
    """
    sums = [
        "px AS MATERIALIZED (SELECT series_id, i, n, epoch, rtt_value, rtt_value - avg(rtt_value) OVER (PARTITION BY series_id) AS x FROM idx)",
        "grid_ends AS (SELECT series_id, n, unnest(list_append(range(%d, n, %d), n)) AS e FROM (SELECT DISTINCT series_id, n FROM idx))" % (jump, jump),
        "ends_k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY e) AS k FROM (SELECT DISTINCT * FROM grid_ends))",
        "spots AS MATERIALIZED (SELECT series_id, e AS spot, k FROM ends_k UNION ALL SELECT DISTINCT series_id, 0, 0 FROM ends_k)",
    ]
    if model == "rbf":
        # Kernel sums of blocks of bins, then of all blocks before each two spots.
        cost = [
            "mid AS MATERIALIZED (SELECT a.series_id, median((a.rtt_value - b.rtt_value) * (a.rtt_value - b.rtt_value)) AS middle FROM px a JOIN px b ON a.series_id = b.series_id AND a.i < b.i GROUP BY 1)",
            f"""tiles AS (SELECT a.series_id, a.i // {jump} AS p, b.i // {jump} AS q, sum(exp(-least(100.0, greatest(0.01, CASE WHEN middle > 0 THEN (a.rtt_value - b.rtt_value) * (a.rtt_value - b.rtt_value) / middle ELSE (a.rtt_value - b.rtt_value) * (a.rtt_value - b.rtt_value) END)))) AS s
  FROM px a JOIN px b ON a.series_id = b.series_id JOIN mid ON mid.series_id = a.series_id GROUP BY ALL)""",
            "tall AS MATERIALIZED (SELECT series_id, p + 1 AS p, q + 1 AS q, sum(c) OVER (PARTITION BY series_id, q ORDER BY p) AS s FROM (SELECT *, sum(s) OVER (PARTITION BY series_id, p ORDER BY q) AS c FROM tiles))",
            f"""costs AS (SELECT b.series_id, b.k, a.k AS j, exp(-0.01) * (b.spot - a.spot) - (ee.s - 2 * coalesce(ae.s, 0) + coalesce(aa.s, 0)) / (b.spot - a.spot) AS c
  FROM spots a JOIN spots b ON a.series_id = b.series_id AND a.k < b.k AND b.spot - a.spot >= {least} JOIN tall ee ON ee.series_id = b.series_id AND ee.p = b.k AND ee.q = b.k
  LEFT JOIN tall ae ON ae.series_id = b.series_id AND ae.p = a.k AND ae.q = b.k LEFT JOIN tall aa ON aa.series_id = b.series_id AND aa.p = a.k AND aa.q = a.k)""",
        ]
    else:
        spread = "greatest(b.s2 - a.s2 - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.spot - a.spot), 0)"
        value = spread if model == "l2" else f"(b.spot - a.spot) * ln(greatest({spread} / (b.spot - a.spot), 1e-8))"
        cost = [
            "run AS (SELECT series_id, i + 1 AS i, sum(x) OVER w AS s1, sum(x * x) OVER w AS s2 FROM px WINDOW w AS (PARTITION BY series_id ORDER BY i))",
            "at_spots AS MATERIALIZED (SELECT s.series_id, spot, k, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM spots s LEFT JOIN run ON run.series_id = s.series_id AND run.i = s.spot)",
            f"costs AS (SELECT b.series_id, b.k, a.k AS j, {value} AS c FROM at_spots a JOIN at_spots b ON a.series_id = b.series_id AND a.k < b.k AND b.spot - a.spot >= {least})",
        ]
    return [
        *sums,
        *cost,
        "ct AS MATERIALIZED (SELECT b.series_id, b.k, list(coalesce(c.c, 1e300) ORDER BY a.k) AS costs FROM spots a JOIN spots b ON a.series_id = b.series_id AND a.k < b.k LEFT JOIN costs c ON c.series_id = b.series_id AND c.k = b.k AND c.j = a.k GROUP BY ALL)",
        f"""dp AS (SELECT series_id, pen, 0 AS k, [0.0]::DOUBLE[] AS best, []::BIGINT[] AS prior FROM (SELECT DISTINCT series_id FROM spots), (SELECT unnest([{penalty}, {0.3 * penalty}])::DOUBLE AS pen)
  UNION ALL SELECT series_id, pen, k + 1, list_append(best, m + pen), list_append(prior, list_position(cand, m) - 1) FROM (SELECT *, list_min(cand) AS m FROM (
    SELECT dp.series_id, dp.pen, dp.k, dp.best, dp.prior, list_transform(range(0, dp.k + 1), lambda j: dp.best[j + 1] + ct.costs[j + 1]) AS cand FROM dp JOIN ct ON ct.series_id = dp.series_id AND ct.k = dp.k + 1)))""",
        "ends_dp AS (SELECT series_id, pen, arg_max(prior, k) AS prior FROM dp GROUP BY ALL)",
        "back AS (SELECT series_id, pen, prior, prior[len(prior)] AS j FROM ends_dp UNION ALL SELECT series_id, pen, prior, prior[j] FROM back WHERE j > 0)",
        f"""picked AS (SELECT b.series_id, b.pen, j * {jump} AS i FROM back b JOIN (SELECT series_id, count(*) FILTER (pen = {penalty} AND j > 0) AS many FROM back GROUP BY 1) USING (series_id) WHERE j > 0 AND b.pen = CASE WHEN many < 10 THEN {0.3 * penalty} ELSE {penalty} END)""",
        f"""part_cps AS (SELECT p.series_id, c.epoch, 'ruptures_{model}' || CASE WHEN p.pen < {penalty} THEN '_lowpen' ELSE '' END AS algorithm, least(10, p.i, c.n - p.i) AS w,
    avg(x.rtt_value) FILTER (x.i < p.i) AS ma, avg(x.rtt_value) FILTER (x.i >= p.i) AS mb, var_pop(x.rtt_value) FILTER (x.i < p.i) AS va, var_pop(x.rtt_value) FILTER (x.i >= p.i) AS vb
  FROM picked p JOIN px c ON c.series_id = p.series_id AND c.i = p.i JOIN px x ON x.series_id = p.series_id AND x.i >= p.i - least(10, p.i, c.n - p.i) AND x.i < p.i + least(10, p.i, c.n - p.i) GROUP BY ALL)""",
    ]


def bayes_ctes() -> list[str]:
    """Posterior probabilities of a change by the recursions forwards and backwards over whole lists; needs ``idx``, gives ``bcp_p``."""

    def evidence(a: str, e: str) -> str:
        m, t = f"({e} - {a})", f"(r.q1[{e} + 1] - r.q1[{a} + 1])"
        beta = f"(1 + 0.5 * (r.q2[{e} + 1] - r.q2[{a} + 1] - {t} * {t} / {m}) + {t} * {t} / {m} / (2 * (1 + {m})))"
        return f"(lgamma(1 + {m} / 2) - 0.5 * ln(1 + {m}) - {m} / 2 * ln(2 * pi()) + ({m} - 1) * r.stay - (1 + {m} / 2) * ln(greatest({beta}, 1e-300)))"

    return [
        """bsum AS MATERIALIZED (SELECT series_id, max(n) AS n, list_prepend(0.0, list(c1 ORDER BY i)) AS q1, list_prepend(0.0, list(c2 ORDER BY i)) AS q2, ln(1 / (max(n) + 1.0)) AS move, ln(1 - 1 / (max(n) + 1.0)) AS stay FROM (
  SELECT series_id, i, n, sum(rtt_value) OVER w AS c1, sum(rtt_value * rtt_value) OVER w AS c2 FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY i)) GROUP BY series_id)""",
        f"""fore AS (SELECT series_id, 0 AS t, [0.0]::DOUBLE[] AS vs FROM bsum
  UNION ALL SELECT series_id, t + 1, list_append(vs, top + ln(list_sum(list_transform(cand, lambda c: exp(c - top)))) + move) FROM (SELECT *, list_max(cand) AS top FROM (
    SELECT f.series_id, f.t, f.vs, r.move, list_transform(range(0, f.t + 1), lambda a: f.vs[a + 1] + {evidence("a", "(f.t + 1)")}) AS cand FROM fore f JOIN bsum r ON r.series_id = f.series_id AND f.t < r.n - 1)))""",
        f"""aft AS (SELECT series_id, n AS t, [-move]::DOUBLE[] AS vs FROM bsum
  UNION ALL SELECT series_id, t - 1, list_append(vs, top + ln(list_sum(list_transform(cand, lambda c: exp(c - top))))) FROM (SELECT *, list_max(cand) AS top FROM (
    SELECT f.series_id, f.t, f.vs, list_transform(range(0, r.n - f.t + 1), lambda k: f.vs[k + 1] + r.move + {evidence("(f.t - 1)", "(r.n - k)")}) AS cand FROM aft f JOIN bsum r ON r.series_id = f.series_id AND f.t > 0)))""",
        "fore_all AS (SELECT series_id, arg_max(vs, t) AS fs FROM fore GROUP BY 1)",
        "aft_all AS (SELECT series_id, arg_min(vs, t) AS bs FROM aft GROUP BY 1)",
        """bcp_p AS (SELECT idx.series_id, idx.epoch, CASE WHEN i = 0 THEN 0.0 ELSE least(1.0, exp(fs[i + 1] + bs[n - i + 1] - bs[n + 1])) END AS p
  FROM idx JOIN fore_all ON fore_all.series_id = idx.series_id JOIN aft_all ON aft_all.series_id = idx.series_id)""",
    ]
