"""SQL counterparts of ``workload.tables`` for the comparison run, written independently."""


def wk(d: str) -> str:
    return f"(lpad(CAST(isoyear({d}) % 100 AS VARCHAR), 2, '0') || 'WK' || lpad(CAST(weekofyear({d}) AS VARCHAR), 2, '0'))"


def mo(d: str) -> str:
    return f"strftime({d}, '%y-%m')"


def dy(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r6(x: str) -> str:
    # Adding 0.0 folds a negative zero.
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def levels(src: str, cols: str) -> str:
    return (
        f"SELECT 'ALL' AS subject, {cols} FROM {src} UNION ALL SELECT brand, {cols} FROM {src} "
        f"UNION ALL SELECT generation, {cols} FROM {src}"
    )


def grains(src: str, cols: str, names=("day", "week", "month")) -> str:
    spec = {
        "day": (dy("day"), "day"), "week": (wk("day"), "CAST(date_trunc('week', day) AS DATE)"),
        "month": (mo("day"), "CAST(date_trunc('month', day) AS DATE)"),
    }
    return " UNION ALL ".join(
        f"SELECT '{g}' AS grain, {spec[g][0]} AS period, {spec[g][1]} AS period_start, {cols} FROM {src}" for g in names
    )


_HALF = "(CAST((year(day) - 2023) * 2 + CASE WHEN month(day) > 6 THEN 1 ELSE 0 END AS INTEGER))"

CTE = {
    "places": "SELECT n_nationkey, r_name AS brand, n_name AS generation FROM nation JOIN region ON n_regionkey = r_regionkey",
    "subj": (
        "SELECT DISTINCT 'ALL' AS name, 'group' AS type, CAST(NULL AS VARCHAR) AS parent FROM places UNION "
        "SELECT DISTINCT brand, 'brand', 'ALL' FROM places UNION SELECT generation, 'generation', brand FROM places"
    ),
    "od": (
        "SELECT brand, generation, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS orders, "
        "CAST(count(*) FILTER (o_orderstatus IN ('F','O')) AS DOUBLE) AS retained, "
        "CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS locked, "
        "CAST(count(*) FILTER (o_orderstatus = 'F' AND l_orderkey IS NOT NULL) AS DOUBLE) AS delivered "
        "FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F') f ON o_orderkey = l_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"
    ),
    "odl": levels("od", "day, orders, retained, locked, delivered"),
    "odg": grains("odl", "subject, orders, retained, locked, delivered"),
    "oc": (
        "SELECT subject, grain, period, period_start, sum(orders) AS orders, sum(retained) AS retained, "
        "sum(locked) AS locked, sum(delivered) AS delivered FROM odg GROUP BY 1, 2, 3, 4"
    ),
    # Overview base: only periods with a lock report.
    "ob": "SELECT * FROM oc WHERE locked > 0",
    "chart": (
        "SELECT subject, period, buyers AS value FROM (SELECT subject, strftime(ps, '%y-%m') AS period, "
        "CAST(sum(buyers) AS DOUBLE) AS buyers, sum(n) AS n FROM ("
        + levels("(SELECT brand, generation, ps, count(*) AS buyers, sum(n) AS n FROM (SELECT o_custkey, "
                 "CAST(date_trunc('month', o_orderdate) AS DATE) AS ps, count(*) AS n FROM orders GROUP BY 1, 2) x "
                 "JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)", "ps, buyers, n")
        + ") GROUP BY subject, ps) WHERE buyers < n"
    ),
    "lp": (
        "SELECT l.*, brand, generation, CAST(l_shipdate AS DATE) AS sday FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey "
        "JOIN places ON s_nationkey = n_nationkey"
    ),
    "pc": (
        "SELECT subject, ps, metric, category, base, CAST(count(*) AS DOUBLE) AS n FROM ("
        "SELECT s.subject, ps, d.metric, d.category, d.base FROM (SELECT brand, CAST(date_trunc('month', sday) AS DATE) AS ps, p_type, p_brand, p_size "
        "FROM lp JOIN part ON l_partkey = p_partkey) b, "
        "LATERAL (SELECT 'ALL' AS subject UNION ALL SELECT b.brand) s, "
        "LATERAL (SELECT '动力' AS metric, b.p_type AS category, 100 AS base UNION ALL SELECT '版本', b.p_brand, 200 "
        "UNION ALL SELECT '电池包', CAST(b.p_size AS VARCHAR) || 'kWh', 300) d) GROUP BY 1, 2, 3, 4, 5"
    ),
    "mx": (
        "SELECT subject, strftime(ps, '%y-%m') AS period, ps, metric, category, "
        "(base + coalesce(TRY_CAST(nullif(regexp_extract(category, '(\\d+)', 1), '') AS INTEGER), length(category))) * 256 + ascii(category) AS ord, "
        "n / sum(n) OVER (PARTITION BY subject, ps, metric) AS share, n FROM pc"
    ),
    "mxp": (
        "SELECT m.*, prior.share AS pshare FROM (SELECT m.*, s.prev FROM mx m JOIN (SELECT subject, period, lag(period) OVER "
        "(PARTITION BY subject ORDER BY ps) AS prev FROM (SELECT DISTINCT subject, period, ps FROM mx)) s USING (subject, period)) m "
        "LEFT JOIN mx prior ON prior.subject = m.subject AND prior.period = m.prev AND prior.metric = m.metric AND prior.category = m.category"
    ),
    "mxc": "SELECT *, coalesce(pshare, share) AS previous, share - coalesce(pshare, share) AS change FROM mxp",
    "ch0": (
        "SELECT brand, generation, c_mktsegment AS channel, ps, sum(n) AS n, count(*) AS active FROM (SELECT o_custkey, "
        "CAST(date_trunc('month', o_orderdate) AS DATE) AS ps, count(*) AS n FROM orders GROUP BY 1, 2) x "
        "JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4"
    ),
    "ch1": "SELECT subject, channel, ps, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(active) AS DOUBLE) AS active FROM (" + levels("ch0", "channel, ps, n, active") + ") GROUP BY 1, 2, 3",
    "ch2": "SELECT *, n / sum(n) OVER (PARTITION BY subject, ps) AS share FROM ch1",
    # Dense: every channel of a subject at every period of the subject.
    "ch": (
        "SELECT g.subject, g.ps, strftime(g.ps, '%y-%m') AS period, g.channel, v.n, v.share, v.active FROM ("
        "SELECT * FROM (SELECT DISTINCT subject, ps FROM ch2) JOIN (SELECT DISTINCT subject, channel FROM ch2) USING (subject)) g "
        "LEFT JOIN ch2 v ON v.subject = g.subject AND v.ps = g.ps AND v.channel = g.channel"
    ),
    "cust": (
        "SELECT brand, generation, c_mktsegment AS channel, CAST(count(*) AS DOUBLE) AS n, "
        "CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) AS rich FROM customer JOIN places ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"
    ),
    "st": (
        "WITH b AS (SELECT brand AS subject, channel, sum(n) AS stores FROM cust GROUP BY 1, 2) "
        "SELECT * FROM b UNION ALL SELECT 'ALL', channel, sum(stores) FROM b GROUP BY 2 UNION ALL "
        "SELECT p.generation, b.channel, CASE WHEN b.channel <> 'BUILDING' AND o.rich IS NOT NULL THEN o.rich ELSE b.stores END "
        "FROM places p JOIN b ON b.subject = p.brand LEFT JOIN cust o ON o.generation = p.generation AND o.channel = b.channel"
    ),
    "chr": (
        "SELECT c.*, s.stores, coalesce(active > stores, false) AS bad, "
        "CASE WHEN stores > 0 AND NOT coalesce(active > stores, false) THEN active / stores END AS active_rate, "
        "CASE WHEN stores > 0 THEN c.n / stores END AS productivity FROM ch c LEFT JOIN st s USING (subject, channel)"
    ),
    "cht": (
        "SELECT x.*, CASE WHEN NOT x.openc THEN k.total END AS stores FROM (SELECT subject, period, ps, "
        "CASE WHEN count(n) = count(*) THEN sum(n) END AS n, CASE WHEN count(active) = count(*) THEN sum(active) END AS active, "
        "bool_or(stores IS NULL AND (coalesce(n, -1) <> 0 OR coalesce(active, -1) <> 0)) AS openc, bool_or(bad) AS wrong "
        "FROM chr GROUP BY 1, 2, 3) x LEFT JOIN (SELECT subject, CASE WHEN count(stores) = count(*) THEN sum(stores) END AS total FROM st GROUP BY 1) k USING (subject)"
    ),
    "co0": (
        "SELECT brand, generation, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS st, f.* FROM orders LEFT JOIN ("
        "SELECT l_orderkey, count(*) AS lines, bool_or(l_linestatus = 'F') AS af, bool_or(l_returnflag <> 'R') AS ak, "
        "bool_or(l_returnflag = 'N') AS an, min(CAST(l_shipdate AS DATE)) AS fs, max(CAST(l_shipdate AS DATE)) AS ls FROM lineitem GROUP BY 1) f "
        "ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey"
    ),
    "co1": (
        "SELECT brand, generation, day, count(*) AS s1, count(*) FILTER (st IN ('F','O')) AS s2, "
        "count(*) FILTER (st IN ('F','O') AND lines > 0) AS s3, count(*) FILTER (st IN ('F','O') AND af) AS s4, "
        "count(*) FILTER (st IN ('F','O') AND af AND ak) AS s5, count(*) FILTER (st IN ('F','O') AND af AND ak AND an) AS s6, "
        "count(*) FILTER (st = 'F' AND af AND ak AND an) AS s7, sum(abs(fs - day)) AS wait, count(fs) AS shipped, sum(ls - fs) AS spread "
        "FROM co0 GROUP BY 1, 2, 3"
    ),
    "co2": levels("co1", "day, s1, s2, s3, s4, s5, s6, s7, wait, shipped, spread"),
    "co": (
        "SELECT subject, grain, period, CAST(sum(s1) AS DOUBLE) AS s1, CAST(sum(s2) AS DOUBLE) AS s2, "
        "CAST(sum(s3) AS DOUBLE) AS s3, CAST(sum(s4) AS DOUBLE) AS s4, CAST(sum(s5) AS DOUBLE) AS s5, "
        "CAST(sum(s6) AS DOUBLE) AS s6, CAST(sum(s7) AS DOUBLE) AS s7, "
        "CAST(sum(wait) AS DOUBLE) / nullif(sum(shipped), 0) AS days1, CAST(sum(spread) AS DOUBLE) / nullif(sum(shipped), 0) AS days2 FROM ("
        + grains("co2", "subject, s1, s2, s3, s4, s5, s6, s7, wait, shipped, spread", ("week", "month")) + ") GROUP BY 1, 2, 3"
    ),
    "ev": "SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, brand, generation, CAST(ts AS DATE) AS day FROM events e JOIN places ON e.user_id % 25 = n_nationkey",
    "rh": (
        "SELECT * FROM (SELECT brand AS subject, day, CAST(hour(ts) AS INTEGER) AS hour, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS orders, "
        "CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS cancel FROM ev GROUP BY 1, 2, 3) WHERE orders + cancel > 0"
    ),
    "rhd": "SELECT subject, day, sum(orders) AS orders, sum(cancel) AS cancel FROM rh GROUP BY 1, 2",
    "rd": (
        "SELECT brand AS subject, day, CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS orders, "
        "CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS cancel, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS big_cancel FROM ev GROUP BY 1, 2"
    ),
    "camp": (
        "SELECT r_name AS subject, w.* FROM region, (VALUES ('spring', 1, DATE '2024-01-03', DATE '2024-01-10'), "
        "('summer', 2, DATE '2024-01-10', DATE '2024-01-17'), ('autumn', 3, DATE '2024-01-20', DATE '2024-01-26')) w(campaign, phase, a, b)"
    ),
    # Days covered by exactly one campaign.
    "cday": (
        "SELECT d.subject, d.day, max(c.campaign) AS campaign FROM (SELECT DISTINCT subject, day FROM rd) d JOIN camp c "
        "ON c.subject = d.subject AND d.day BETWEEN c.a AND c.b GROUP BY 1, 2 HAVING count(*) = 1"
    ),
    "rhy": (
        "SELECT m.subject, m.day, c.campaign, CASE WHEN h.day IS NOT NULL THEN h.orders ELSE m.orders END AS orders, "
        "CASE WHEN h.day IS NOT NULL THEN h.cancel ELSE m.cancel END AS cancel FROM rd m JOIN cday c USING (subject, day) "
        "LEFT JOIN rhd h ON h.subject = m.subject AND h.day = m.day AND h.day <= DATE '2024-01-15'"
    ),
    "rhyr": "SELECT *, greatest(orders - cancel, 0) AS retained FROM rhy",
    "ro": (
        "SELECT subject, dimension, label, CAST(count(*) AS DOUBLE) AS orders, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS cancel, "
        "CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS DOUBLE) AS early FROM (SELECT brand AS subject, l_returnflag, l_linestatus, d.* "
        "FROM lp JOIN part ON l_partkey = p_partkey, LATERAL (SELECT 'type' AS dimension, p_type AS label UNION ALL SELECT 'brand', p_brand) d) GROUP BY 1, 2, 3"
    ),
    "lday": (
        "SELECT brand AS subject, day, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS orders, "
        "CAST(count(*) FILTER (event_type = 'purchase' AND coalesce(fs < ts, false)) AS DOUBLE) AS small, "
        "CAST(count(*) FILTER (event_type = 'purchase' AND NOT coalesce(fs < ts, false)) AS DOUBLE) AS direct, "
        "CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS lock, CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS signups "
        "FROM ev LEFT JOIN (SELECT user_id AS u, min(ts) AS fs FROM ev WHERE event_type = 'signup' GROUP BY 1) ON u = user_id GROUP BY 1, 2"
    ),
    # Launch steps as the analysis sees them.
    "ls": (
        "SELECT *, direct AS vdirect, co AS gross, "
        "cs / nullif(cg, 0) AS srate, cl AS vlock FROM (SELECT c.subject, c.campaign, c.phase, c.a, d.day, "
        "CAST(d.day - c.a + 1 AS INTEGER) AS step, d.orders, d.small, d.direct, d.lock, sum(d.orders) OVER w AS co, sum(d.small) OVER w AS cs, "
        "sum(d.direct) OVER w AS cd, sum(d.lock) OVER w AS cl, sum(d.signups) OVER w AS cg FROM camp c JOIN lday d ON d.subject = c.subject AND d.day BETWEEN c.a AND c.b "
        "WINDOW w AS (PARTITION BY c.subject, c.campaign ORDER BY d.day))"
    ),
    "lph": (
        "SELECT subject, campaign, phase, sum(orders) AS orders, sum(greatest(orders - lock / 10, 0)) FILTER (orders - lock / 10 >= 0) AS retained, "
        "arg_max(vlock, step) FILTER (vlock IS NOT NULL) AS locked, arg_max(cs, step) AS small, "
        "coalesce(arg_max(srate, step) FILTER (srate IS NOT NULL), 0) AS srate, "
        "arg_max(cd / gross, step) FILTER (gross > 0) AS dshare, "
        "coalesce(arg_max(cd, step) FILTER (gross > 0), arg_max(cd, step) FILTER (gross = 0 AND cd = 0)) AS num, "
        "coalesce(arg_max(gross, step) FILTER (gross > 0), arg_max(gross, step) FILTER (gross = 0 AND cd = 0)) AS den, "
        "min(day) AS start_date, max(day) AS end_date, count(*) AS steps FROM ls GROUP BY 1, 2, 3"
    ),
    "sk": (
        "SELECT subject, ps, " + wk("ps") + " AS period, code, q / sum(q) OVER (PARTITION BY subject, ps) AS share FROM (SELECT brand AS subject, "
        "CAST(date_trunc('week', sday) AS DATE) AS ps, p_brand || '|' || p_type AS code, sum(l_quantity) AS q "
        "FROM lp JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"
    ),
    "tk": (
        "SELECT subject, ps, period, CAST(rank AS INTEGER) AS rank, round(sum(share) OVER (PARTITION BY subject, ps ORDER BY rank), 9) AS cum FROM (SELECT *, row_number() OVER "
        "(PARTITION BY subject, ps ORDER BY share DESC, code) AS rank FROM sk)"
    ),
    "fc": (
        "SELECT brand, generation, " + mo("sday") + " AS period, CAST(date_trunc('month', CASE WHEN year(sday) < 2000 THEN sday + INTERVAL 100 YEAR ELSE sday END) AS DATE) AS m, p_type, l_returnflag AS flag, "
        "CASE WHEN amt = 0 THEN '免费' WHEN amt < 5000 THEN '0-5000' WHEN amt < 10000 THEN '5000-10000' ELSE '10000-以上' END AS band, "
        "amt, amt * (1 - l_tax) AS act FROM (SELECT *, l_extendedprice * l_discount AS amt FROM lp) JOIN part ON l_partkey = p_partkey"
    ),
    "fb": "SELECT brand, generation, period, band, CAST(count(*) AS DOUBLE) AS n FROM fc GROUP BY 1, 2, 3, 4",
    "fr": (
        "SELECT brand, generation, p_type AS label, row_number() OVER (PARTITION BY generation ORDER BY k DESC, p_type) AS rank, "
        "round(k * 100.0 / sum(k) OVER (PARTITION BY generation), 1) / 100 AS rate, round_even(o / k, 0) AS amount "
        "FROM (SELECT brand, generation, p_type, CAST(count(*) AS DOUBLE) AS k, sum(amt) AS o FROM fc GROUP BY 1, 2, 3)"
    ),
    # Weekly pieces of half-year exports.
    "ex0": (
        "SELECT brand AS subject, day, c_mktsegment AS seg, o_custkey, o_orderstatus AS st, " + _HALF + " AS f FROM "
        "(SELECT *, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS day FROM orders) JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey"
    ),
    "exw": (
        "SELECT subject, CAST(date_trunc('week', day) AS DATE) AS ps, f, CAST(count(*) AS DOUBLE) AS n, "
        "CAST(count(*) FILTER (st = 'F') AS DOUBLE) AS lf FROM ex0 GROUP BY 1, 2, 3"
    ),
    # One or two pieces per week: l is the earlier export, r the later one.
    "exl": (
        "SELECT subject, ps, " + wk("ps") + " AS period, min(f) AS f1, max(f) AS f2, count(*) AS pieces, arg_min(n, f) AS l, arg_max(n, f) AS r, "
        "arg_min(lf, f) AS ll, arg_max(lf, f) AS lr FROM exw GROUP BY 1, 2"
    ),
    "nt": (
        "SELECT CAST(event_id AS VARCHAR) AS id, " + dy("day") + " AS date, day, CASE WHEN event_type = 'error' THEN generation ELSE brand END AS target, "
        "event_type || ' ' || event_id AS text FROM ev WHERE event_type IN ('error', 'signup')"
    ),
}

_NEEDS = {
    "subj": ["places"], "od": ["places"], "odl": ["od"], "odg": ["odl"], "oc": ["odg"], "ob": ["oc"], "chart": ["places"],
    "lp": ["places"], "pc": ["lp"], "mx": ["pc"], "mxp": ["mx"], "mxc": ["mxp"], "ch0": ["places"], "ch1": ["ch0"], "ch2": ["ch1"],
    "ch": ["ch2"], "cust": ["places"], "st": ["cust", "places"], "chr": ["ch", "st"], "cht": ["chr", "st"], "co0": ["places"],
    "co1": ["co0"], "co2": ["co1"], "co": ["co2"], "ev": ["places"], "rh": ["ev"], "rhd": ["rh"], "rd": ["ev"], "cday": ["rd", "camp"],
    "rhy": ["rd", "cday", "rhd"], "rhyr": ["rhy"], "ro": ["lp"], "lday": ["ev"], "ls": ["camp", "lday"], "lph": ["ls"], "sk": ["lp"],
    "tk": ["sk"], "fc": ["lp"], "fb": ["fc"], "fr": ["fc"], "ex0": ["places"], "exw": ["ex0"], "exl": ["exw"], "nt": ["ev"],
}


def _closure(names):
    seen = []
    def visit(n):
        for d in _NEEDS.get(n, ()):
            visit(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        visit(n)
    return seen


def query(needs: str, body: str, extra: str = "") -> str:
    """WITH clause of the named building blocks (and their own needs) plus the body."""
    parts = [f"{n} AS ({CTE[n]})" for n in _closure(needs.split())]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}"
