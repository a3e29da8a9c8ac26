"""The named queries written independently as SQL, for comparison on another engine.

Every text is a chain of common table expressions over the trade tables.
"""

from __future__ import annotations

SEASON = """CASE WHEN {m} IN (12, 1, 2) THEN 'DJF' WHEN {m} IN (3, 4, 5) THEN 'MAM'
 WHEN {m} IN (6, 7, 8) THEN 'JJA' WHEN {m} IN (9, 10, 11) THEN 'SON' END"""

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: str, text: str) -> None:
    PARTS[name] = (tuple(needs.split()), text)


def chain(needs: str, select: str) -> str:
    """WITH clause of everything ``needs`` rests on, followed by ``select``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in PARTS[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    body = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in order)
    return f"WITH RECURSIVE {body}\n{select}"


part(
    "obs",
    "",
    """SELECT n_nationkey AS ID, CAST(l_shipdate AS DATE) AS date, AVG(l_quantity) AS TA,
 COALESCE(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS RN
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY 1, 2""",
)
part(
    "stn",
    "",
    """SELECT n_nationkey AS ID, CAST(124 + 0.25 * n_nationkey AS DOUBLE) AS Long,
 CAST(33 + n_regionkey AS DOUBLE) AS Lat FROM nation""",
)
part("elig", "obs", "SELECT ID FROM obs GROUP BY ID HAVING MIN(YEAR(date)) <= 1995")
part(
    "base",
    "obs elig",
    """SELECT ID, date, TA, RN, DAYOFYEAR(date) AS jdate, YEAR(date) AS yr, MONTH(date) AS mon
 FROM obs WHERE ID IN (SELECT ID FROM elig)""",
)
part(
    "roll",
    "base",
    """SELECT ID, date, jdate, yr, CASE WHEN COUNT(TA) OVER w = 15 THEN AVG(TA) OVER w END AS roll_temp
 FROM base WINDOW w AS (PARTITION BY ID ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""",
)
part(
    "hot",
    "roll",
    """SELECT ID, jdate, ROUND(QUANTILE_CONT(roll_temp, 0.9), 9) AS hw_thrsld, COUNT(roll_temp) AS n
 FROM roll WHERE yr BETWEEN 1995 AND 2000 GROUP BY ID, jdate""",
)
part(
    "wet",
    "base",
    """SELECT ID, ROUND(QUANTILE_CONT(RN, 0.95), 9) AS pl_thrsld
 FROM base WHERE RN > 0 AND yr BETWEEN 1995 AND 2000 GROUP BY ID""",
)
part(
    "flag",
    "base hot wet",
    """SELECT b.*, h.hw_thrsld, w.pl_thrsld, COALESCE(CAST(b.TA > h.hw_thrsld AS INT), 0) AS hot,
 COALESCE(CAST(b.RN > w.pl_thrsld AS INT), 0) AS heavy
 FROM base b LEFT JOIN hot h ON b.ID = h.ID AND b.jdate = h.jdate LEFT JOIN wet w ON b.ID = w.ID""",
)
part(
    "island",
    "flag",
    """SELECT *, ROW_NUMBER() OVER (PARTITION BY ID ORDER BY date)
 - ROW_NUMBER() OVER (PARTITION BY ID, hot ORDER BY date) AS isl FROM flag""",
)
part(
    "runs",
    "island",
    """SELECT *, hot = 1 AND COUNT(*) OVER (PARTITION BY ID, hot, isl) >= 2 AS heatwave FROM island""",
)
part(
    "fact",
    "runs",
    """SELECT *, CAST(heatwave AND COALESCE(MAX(heavy) OVER (PARTITION BY ID, yr ORDER BY date
 ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), 0) = 1 AS INT) AS hw_pluvial FROM runs""",
)
part(
    "rate",
    "fact",
    """SELECT ID, yr, SUM(CAST(heatwave AS INT)) AS events, SUM(hw_pluvial) AS coincidences
 FROM fact GROUP BY ID, yr""",
)
part(
    "months",
    "fact",
    "SELECT ID, yr, mon, COALESCE(SUM(hw_pluvial), 0) AS num_coincidence FROM fact GROUP BY ID, yr, mon",
)
part(
    "seas",
    "months",
    f"""SELECT ID, yr + CAST(mon = 12 AS INT) AS year_season, {SEASON.format(m="mon")} AS season,
 SUM(num_coincidence) AS cdh_count, COUNT(*) AS n_months FROM months GROUP BY 1, 2, 3""",
)
part(
    "totals",
    "seas",
    "SELECT year_season, season, SUM(cdh_count) AS total_cphw FROM seas GROUP BY 1, 2",
)
part(
    "bmean",
    "seas",
    """SELECT ID, season, AVG(cdh_count) AS base_ave, STDDEV_SAMP(cdh_count) AS cdh_sd
 FROM seas WHERE year_season BETWEEN 1995 AND 1999 GROUP BY ID, season""",
)
part(
    "tmean",
    "seas",
    """SELECT ID, season, AVG(cdh_count) AS target_ave
 FROM seas WHERE year_season BETWEEN 2000 AND 2001 GROUP BY ID, season""",
)
part(
    "comp",
    "bmean tmean",
    """SELECT ID, season, base_ave AS cdh_ave, cdh_sd, '1995-1999' AS Period FROM bmean
 UNION ALL SELECT ID, season, target_ave, NULL, '2000-2001' FROM tmean""",
)
part(
    "anom",
    "bmean tmean",
    """SELECT b.ID, b.season, base_ave, cdh_sd, target_ave, (target_ave - base_ave) / cdh_sd AS anomaly
 FROM bmean b LEFT JOIN tmean t ON b.ID = t.ID AND b.season = t.season
 WHERE cdh_sd <> 0 AND target_ave IS NOT NULL""",
)
part(
    "bstat",
    "totals",
    """SELECT season, AVG(total_cphw) AS mu, STDDEV_SAMP(total_cphw) AS sigma
 FROM totals WHERE year_season BETWEEN 1995 AND 1999 GROUP BY season""",
)
part(
    "ecdf",
    "totals",
    """SELECT b.season, 100.0 * SUM(CASE WHEN b.total_cphw <= t.total_cphw THEN 1 ELSE 0 END) / COUNT(*) AS P_value,
 MAX(t.total_cphw) >= MAX(b.total_cphw) AS Is_Record
 FROM totals b LEFT JOIN (SELECT * FROM totals WHERE year_season = 2000) t ON b.season = t.season
 WHERE b.year_season BETWEEN 1995 AND 1999 GROUP BY b.season""",
)
part(
    "pooled",
    "fact",
    """SELECT *, PERCENT_RANK() OVER (ORDER BY TA) * 100 AS pt, PERCENT_RANK() OVER (ORDER BY RN) * 100 AS pr
 FROM fact""",
)
part(
    "ahead",
    "pooled",
    """SELECT *, MAX(pr) OVER (PARTITION BY ID ORDER BY date ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS Pmax_7day
 FROM pooled""",
)
part(
    "ev",
    "ahead stn",
    f"""SELECT a.ID, date, TA, RN, Pmax_7day, hw_thrsld, pl_thrsld,
 CASE WHEN pl_thrsld > 0 THEN GREATEST(Pmax_7day - pl_thrsld, 0) / pl_thrsld END AS P_excess_rel,
 CASE WHEN hw_thrsld > 0 THEN (TA - hw_thrsld) / hw_thrsld END AS T_anom_rel,
 pt AS Tmax_percentile, pt * Pmax_7day / 100 AS intensity, yr, mon,
 {SEASON.format(m="mon")} AS season, yr + CAST(mon = 12 AS INT) AS year_season, Long, Lat
 FROM ahead a LEFT JOIN stn s ON a.ID = s.ID WHERE hw_pluvial = 1""",
)
BINS = (
    "CASE WHEN {c} >= 50 AND {c} <= 60 THEN '[50,60]' WHEN {c} > 60 AND {c} <= 70 THEN '(60,70]'"
    " WHEN {c} > 70 AND {c} <= 80 THEN '(70,80]' WHEN {c} > 80 AND {c} <= 90 THEN '(80,90]'"
    " WHEN {c} > 90 AND {c} <= 100 THEN '(90,100]' END"
)
part(
    "ranked",
    "fact",
    """SELECT *, PERCENT_RANK() OVER (PARTITION BY ID ORDER BY TA) * 100 AS pt,
 PERCENT_RANK() OVER (PARTITION BY ID ORDER BY RN) * 100 AS pr FROM fact""",
)
part(
    "sameday",
    "ranked stn",
    f"""SELECT r.ID, date, TA, RN, yr, pt, pr, {BINS.format(c="pt")} AS Tmax_bin,
 {BINS.format(c="pr")} AS P_bin, Long, Lat
 FROM ranked r LEFT JOIN stn s ON r.ID = s.ID WHERE hw_pluvial = 1""",
)
part(
    "matrix",
    "sameday",
    """SELECT P_bin, Tmax_bin, AVG(pt * pr / 100) AS compound_intensity FROM sameday
 WHERE Tmax_bin IS NOT NULL AND P_bin IS NOT NULL GROUP BY 1, 2""",
)
part(
    "prof",
    "ev",
    """SELECT ID, Long, Lat, season, AVG(intensity) AS mean_intensity, MAX(intensity) AS max_intensity,
 SUM(intensity) AS sum_intensity, COUNT(*) AS freq FROM ev WHERE intensity > 0 GROUP BY 1, 2, 3, 4""",
)
part(
    "smedian",
    "ev",
    "SELECT year_season, season, MEDIAN(intensity) AS v FROM ev GROUP BY 1, 2",
)
part(
    "smean",
    "ev",
    "SELECT year_season, season, AVG(intensity) AS v FROM ev GROUP BY 1, 2",
)
part(
    "ssm",
    "ev",
    """SELECT ID, year_season, season, MEDIAN(intensity) AS annual_mean_intensity
 FROM ev GROUP BY 1, 2, 3""",
)
part(
    "mom",
    "ssm",
    "SELECT ID, season, AVG(annual_mean_intensity) AS intensity_ave FROM ssm GROUP BY 1, 2",
)
part("jnt", "ev", "SELECT *, T_anom_rel * P_excess_rel AS comp_int_rel FROM ev")
part(
    "rep",
    "jnt",
    """SELECT *, CASE WHEN year_season <= 1999 THEN '1995-1999' ELSE '2000-2001' END AS Period FROM (
 SELECT j.*, m.max_comb, ABS(comp_int_rel - max_comb) AS diff,
 ROW_NUMBER() OVER (PARTITION BY j.ID, j.year_season, j.season
 ORDER BY ABS(comp_int_rel - max_comb) NULLS LAST, date) AS place
 FROM jnt j JOIN (SELECT ID, year_season, season, MAX(comp_int_rel) AS max_comb FROM jnt GROUP BY 1, 2, 3) m
 ON j.ID = m.ID AND j.year_season = m.year_season AND j.season = m.season) WHERE place = 1""",
)
# Series under test: season, year_season, v.
part("count_series", "totals", "SELECT season, year_season, CAST(total_cphw AS DOUBLE) AS v FROM totals")
part("count_series_cut", "count_series", "SELECT * FROM count_series WHERE year_season <> 2001")
part(
    "excess_series",
    "count_series",
    """SELECT season, year_season, GREATEST(v - (SELECT MIN(peak) FROM
 (SELECT MAX(v) AS peak FROM count_series GROUP BY season)), 0) AS v FROM count_series""",
)
part("median_series", "smedian", "SELECT season, year_season, v FROM smedian")
part("mean_series", "smean", "SELECT season, year_season, v FROM smean")


def classes(column: str, breaks: tuple, limits: tuple) -> str:
    """Right-closed class number within the limits."""
    low, high = limits
    steps = " + ".join(
        ["1"] + [f"CAST({column} > {b} AS INT)" for b in breaks if low < b < high]
    )
    return f"CASE WHEN {column} >= {low} AND {column} <= {high} THEN {steps} END"


def r9(*columns: str, digits: int = 9) -> str:
    return ", ".join(f"ROUND({c}, {digits}) AS {c.split('.')[-1]}" for c in columns)


COUNTS = (0, 1, 2, 3, 4, 5, 6)
PHI = """(CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 ELSE 0.5 + EXP(-{z} * {z} / 2) / SQRT(2 * PI())
 * SIGN({z}) * LIST_SUM(LIST_TRANSFORM(RANGE(0, 150), lambda k: CASE WHEN {z} = 0 THEN 0 ELSE
 EXP((2 * k + 1) * LN(ABS({z})) - (LGAMMA(2 * k + 2) - k * LN(2) - LGAMMA(k + 1))) END)) END)"""
# Central probability of Student's t for whole degrees of freedom.
CENTRAL = """(CASE WHEN {n} = 1 THEN 2 / PI() * ATAN({t}) WHEN {n} % 2 = 1 THEN 2 / PI() * (ATAN({t} / SQRT({n}))
 + SIN(ATAN({t} / SQRT({n}))) * LIST_SUM(LIST_TRANSFORM(RANGE(0, CAST(({n} - 3) / 2 AS BIGINT) + 1), lambda j:
 SQRT(PI()) / 2 * EXP(LGAMMA(j + 1) - LGAMMA(j + 1.5)) * POW(COS(ATAN({t} / SQRT({n}))), 2 * j + 1))))
 ELSE SIN(ATAN({t} / SQRT({n}))) * LIST_SUM(LIST_TRANSFORM(RANGE(0, CAST(({n} - 2) / 2 AS BIGINT) + 1), lambda j:
 EXP(LGAMMA(j + 0.5) - LGAMMA(j + 1)) / SQRT(PI()) * POW(COS(ATAN({t} / SQRT({n}))), 2 * j))) END)"""


def fit_part(series: str) -> str:
    """Least squares of one series per season from sums about the means."""
    name = f"fit_{series}"
    part(
        f"mid_{series}",
        series,
        f"SELECT season, AVG(year_season) AS xm, AVG(v) AS ym FROM {series} GROUP BY season",
    )
    part(
        f"sum_{series}",
        f"mid_{series}",
        f"""SELECT s.season, COUNT(*) AS n, MIN(year_season) AS x_low, MAX(year_season) AS x_high,
 MAX(xm) AS xm, MAX(ym) AS ym, SUM((year_season - xm) * (year_season - xm)) AS sxx,
 SUM((v - ym) * (v - ym)) AS syy, SUM((year_season - xm) * (v - ym)) AS sxy
 FROM {series} s JOIN mid_{series} m ON s.season = m.season GROUP BY s.season""",
    )
    part(
        name,
        f"sum_{series}",
        f"""SELECT *, sxy / sxx AS slope, ym - sxy / sxx * xm AS intercept, sxy * sxy / (sxx * syy) AS r2,
 SQRT((syy - sxy * sxy / sxx) / (n - 2)) AS s, CAST(n - 2 AS BIGINT) AS df FROM sum_{series}""",
    )
    return name


def linear_sql(series: str) -> str:
    fit = fit_part(series)
    p = "1 - " + CENTRAL.format(t="(ABS(slope) / (s / SQRT(sxx)))", n="df")
    return chain(
        fit,
        f"""SELECT season, {r9("slope", "intercept")},
 CASE WHEN sxx > 0 AND syy > 0 AND df >= 1 THEN ROUND({p}, 9) END AS p_value,
 CASE WHEN sxx > 0 AND syy > 0 THEN ROUND(r2, 9) END AS r2 FROM {fit}""",
    )


def line_sql(series: str) -> str:
    fit = fit_part(series)
    middle = "((low + high) / 2)"
    part(
        f"bisect_{series}",
        fit,
        f"""SELECT season, df, 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1000 AS DOUBLE) AS high FROM {fit}
 UNION ALL SELECT season, df, step + 1,
 CASE WHEN {CENTRAL.format(t=middle, n="df")} < 0.95 THEN {middle} ELSE low END,
 CASE WHEN {CENTRAL.format(t=middle, n="df")} < 0.95 THEN high ELSE {middle} END
 FROM bisect_{series} WHERE step < 60""",
    )
    part(
        f"grid_{series}",
        f"{fit} bisect_{series}",
        f"""SELECT f.*, (b.low + b.high) / 2 AS t, g.i, x_low + (x_high - x_low) * g.i / 79.0 AS x
 FROM {fit} f JOIN bisect_{series} b ON f.season = b.season AND b.step = 60
 CROSS JOIN (SELECT UNNEST(RANGE(0, 80)) AS i) g""",
    )
    half = "t * s * SQRT(1.0 / n + (x - xm) * (x - xm) / sxx)"
    line = "intercept + slope * x"
    return chain(
        f"grid_{series}",
        f"""SELECT season, CAST(i AS INT) AS i, ROUND(x, 7) AS x, ROUND({line}, 7) AS fit,
 ROUND({line} - {half}, 7) AS lower, ROUND({line} + {half}, 7) AS upper FROM grid_{series}""",
    )


def kendall_sql(series: str) -> str:
    """Mann-Kendall by comparing every pair of years."""
    part(
        f"pair_{series}",
        series,
        f"""SELECT a.season, SUM(SIGN(b.v - a.v)) AS S FROM {series} a
 JOIN {series} b ON a.season = b.season AND a.year_season < b.year_season GROUP BY a.season""",
    )
    part(
        f"tie_{series}",
        series,
        f"""SELECT season, SUM(m) AS n, SUM(m * (m - 1) * (2 * m + 5)) AS tv, SUM(m * (m - 1) / 2.0) AS tp
 FROM (SELECT season, v, COUNT(*) AS m FROM {series} GROUP BY season, v) GROUP BY season""",
    )
    part(
        f"mk_{series}",
        f"pair_{series} tie_{series}",
        f"""SELECT t.season, n, S, (n * (n - 1) * (2 * n + 5) - tv) / 18.0 AS varS,
 CASE WHEN n * (n - 1) / 2.0 > tp THEN S / SQRT(n * (n - 1) / 2.0 * (n * (n - 1) / 2.0 - tp)) END AS tau
 FROM tie_{series} t
 JOIN pair_{series} p ON t.season = p.season""",
    )
    part(
        f"mkz_{series}",
        f"mk_{series}",
        f"SELECT *, CASE WHEN varS > 0 THEN (S - SIGN(S)) / SQRT(varS) END AS z FROM mk_{series}",
    )
    part(
        f"mkp_{series}",
        f"mkz_{series}",
        f"SELECT *, CASE WHEN z IS NOT NULL THEN 2 * (1 - {PHI.format(z='ABS(z)')}) END AS p_value FROM mkz_{series}",
    )
    return chain(
        f"mkp_{series}",
        f"""SELECT season, CAST(n AS BIGINT) AS n, CAST(S AS BIGINT) AS S, {r9("varS", "z", "tau", "p_value")},
 CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*'
 WHEN p_value IS NOT NULL THEN 'ns' END AS significance FROM mkp_{series}""",
    )


def bootstrap_parts(name: str, source: str, value: str, summary: str, min_n: int) -> str:
    """Percentile interval over hashed draws, one row per draw."""
    part(
        f"{name}_val",
        source,
        f"""SELECT year_season, season, {value} AS v,
 ROW_NUMBER() OVER (PARTITION BY year_season, season ORDER BY {value}) - 1 AS pick,
 COUNT(*) OVER (PARTITION BY year_season, season) AS n FROM {source}""",
    )
    part(
        "jumps",
        "",
        """SELECT 1 AS step, 40014::BIGINT AS p1, 40692::BIGINT AS p2
 UNION ALL SELECT step + 1, p1 * 40014 % 2147483563, p2 * 40692 % 2147483399 FROM jumps WHERE step < 2048""",
    )
    part(
        "outputs",
        "jumps",
        """SELECT (a.step - 1) // 2 AS item, a.p1 AS a1, a.p2 AS a2, b.p1 AS b1, b.p2 AS b2
 FROM jumps a JOIN jumps b ON b.step = a.step + 1 WHERE a.step % 2 = 1""",
    )
    part(
        f"{name}_block",
        f"{name}_val",
        f"""SELECT year_season, season, n, replicate, UNNEST(RANGE(0, (n - 1) // 1024 + 1)) AS block FROM
 (SELECT year_season, season, n, UNNEST(RANGE(0, 200)) AS replicate FROM
 (SELECT DISTINCT year_season, season, n FROM {name}_val WHERE n >= {min_n}))""",
    )
    part(
        f"{name}_seed",
        f"{name}_block",
        f"""SELECT *, 1 + ('0x' || SUBSTR(digest, 1, 15))::BIGINT % 2147483562 AS s1,
 1 + ('0x' || SUBSTR(digest, 17, 15))::BIGINT % 2147483398 AS s2 FROM (SELECT *,
 MD5('42|' || year_season || '|' || season || '|' || replicate || '|' || block) AS digest FROM {name}_block)""",
    )
    part(
        f"{name}_draw",
        f"{name}_seed outputs",
        f"""SELECT year_season, season, replicate,
 (((s1 * a1 % 2147483563 - s2 * a2 % 2147483399 + 2147483562) % 2147483562) * 2147483562
 + (s1 * b1 % 2147483563 - s2 * b2 % 2147483399 + 2147483562) % 2147483562) % n AS pick
 FROM {name}_seed JOIN outputs ON item < LEAST(n - block * 1024, 1024)""",
    )
    part(
        f"{name}_stat",
        f"{name}_draw",
        f"""SELECT d.year_season, d.season, replicate, CAST({summary}(v) AS DOUBLE) AS stat FROM {name}_draw d
 JOIN {name}_val x ON d.year_season = x.year_season AND d.season = x.season AND d.pick = x.pick
 GROUP BY 1, 2, 3""",
    )
    part(
        f"{name}_ci",
        f"{name}_stat",
        f"""SELECT year_season, season, QUANTILE_CONT(stat, 0.025) AS ci_lower,
 QUANTILE_CONT(stat, 0.975) AS ci_upper FROM {name}_stat GROUP BY 1, 2""",
    )
    return f"{name}_ci"


def histogram_sql(source: str, value: str, bins: int, by_season: bool) -> str:
    """Edges half a width below the lowest value and on; a bin holds what is above its left
    edge and not above its right one, the first also what lies on its left edge."""
    key = "season" if by_season else "1"
    tag = f"{source}_{value}"
    part(
        f"hx_{tag}",
        source,
        f"""SELECT season, Period, {value} AS v, MIN({value}) OVER (PARTITION BY {key}) AS lo,
 MAX({value}) OVER (PARTITION BY {key}) AS hi, COUNT(*) OVER (PARTITION BY season, Period) AS n
 FROM {source} WHERE {value} IS NOT NULL""",
    )
    part(
        f"he_{tag}",
        f"hx_{tag}",
        f"""SELECT *, lo - w / 2 + (bin - 1) * w AS bin_left, lo - w / 2 + bin * w AS bin_right FROM
 (SELECT DISTINCT season, Period, lo, n, CASE WHEN hi > lo THEN (hi - lo) / {bins - 1} ELSE 0.1 END AS w,
 UNNEST(RANGE(1, {bins + 1})) AS bin FROM hx_{tag})""",
    )
    return chain(
        f"hx_{tag} he_{tag}",
        f"""SELECT e.season, e.Period, CAST(e.bin AS INT) AS bin, ROUND(bin_left, 9) AS bin_low,
 ROUND(bin_right, 9) AS bin_high, COUNT(h.v) AS count, ROUND(COUNT(h.v) / (e.n * w), 9) AS density
 FROM he_{tag} e LEFT JOIN hx_{tag} h ON e.season = h.season AND e.Period = h.Period
 AND (h.v > bin_left + 1e-8 * w OR e.bin = 1) AND h.v <= bin_right + 1e-8 * w
 GROUP BY e.season, e.Period, e.bin, bin_left, bin_right, e.n, w""",
    )


def density_sql(source: str, value: str, keys: str, range_key: str) -> str:
    """Linear binning on 512 knots, then the kernel sum, interpolated to the grid."""
    tag = f"{source}_{value}"
    part(
        f"kv_{tag}",
        source,
        f"""SELECT {keys}, {value} AS v, MIN({value}) OVER (PARTITION BY {range_key}) AS lo,
 MAX({value}) OVER (PARTITION BY {range_key}) AS hi FROM {source} WHERE {value} IS NOT NULL""",
    )
    part(
        f"kg_{tag}",
        f"kv_{tag}",
        f"""SELECT {keys}, ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi, COUNT(*) AS n, STDDEV_SAMP(v) AS sd,
 QUANTILE_CONT(v, 0.75) - QUANTILE_CONT(v, 0.25) AS iqr, MAX(ABS(v)) AS size FROM kv_{tag}
 GROUP BY {keys} HAVING COUNT(*) >= 2""",
    )
    part(
        f"kb_{tag}",
        f"kg_{tag}",
        f"""SELECT *, 0.9 * POW(n, -0.2) * CASE WHEN LEAST(sd, iqr / 1.34) > 0 THEN LEAST(sd, iqr / 1.34)
 WHEN sd > 0 THEN sd WHEN size > 0 THEN size ELSE 1 END AS bw FROM kg_{tag}""",
    )
    part(
        f"ka_{tag}",
        f"kb_{tag}",
        f"SELECT *, lo - 4 * bw AS x0, (hi - lo + 8 * bw) / 511 AS delta FROM kb_{tag}",
    )
    part(
        f"kp_{tag}",
        f"kv_{tag} ka_{tag}",
        f"""SELECT {keys}, (v.v - a.x0) / a.delta AS place FROM kv_{tag} v JOIN ka_{tag} a USING ({keys})""",
    )
    part(
        f"kw_{tag}",
        f"kp_{tag}",
        f"""SELECT {keys}, knot, SUM(w) AS w FROM (
 SELECT {keys}, FLOOR(place) AS knot, 1 - (place - FLOOR(place)) AS w FROM kp_{tag}
 UNION ALL SELECT {keys}, FLOOR(place) + 1, place - FLOOR(place) FROM kp_{tag}) GROUP BY {keys}, knot""",
    )
    part(
        f"kx_{tag}",
        f"ka_{tag}",
        f"""SELECT *, lo + (hi - lo) * i / 511.0 AS x FROM (SELECT *, UNNEST(RANGE(0, 512)) AS i FROM ka_{tag})""",
    )
    part(
        f"ky_{tag}",
        f"kx_{tag}",
        f"SELECT *, (x - x0) / delta AS spot FROM kx_{tag}",
    )
    kernel = "EXP(-POW((FLOOR(spot) + {up} - knot) * delta / bw, 2) / 2)"
    return chain(
        f"ky_{tag} kw_{tag}",
        f"""SELECT {keys}, CAST(i AS INT) AS i, ROUND(x, 9) AS x,
 ROUND(SUM(w * ((1 - (spot - FLOOR(spot))) * {kernel.format(up=0)} + (spot - FLOOR(spot)) * {kernel.format(up=1)}))
 / (ANY_VALUE(n) * ANY_VALUE(bw) * SQRT(2 * PI())), 9) AS density
 FROM ky_{tag} y JOIN kw_{tag} w USING ({keys}) GROUP BY {keys}, i, x""",
    )


def density_2d_sql(source: str, y: str = "P_excess_rel", keys: str = "season, Period") -> str:
    tag = f"d2_{source}_{y}"
    part(
        f"{tag}_v",
        source,
        f"""SELECT {keys}, T_anom_rel AS x, {y} AS y, MIN(T_anom_rel) OVER () AS xl,
 MAX(T_anom_rel) OVER () AS xh, MIN({y}) OVER () AS yl, MAX({y}) OVER () AS yh
 FROM {source} WHERE T_anom_rel IS NOT NULL AND {y} IS NOT NULL""",
    )
    part(
        f"{tag}_g",
        f"{tag}_v",
        f"""SELECT {keys}, COUNT(*) AS n, ANY_VALUE(xl) AS xl, ANY_VALUE(xh) AS xh, ANY_VALUE(yl) AS yl,
 ANY_VALUE(yh) AS yh,
 1.06 * LEAST(STDDEV_SAMP(x), (QUANTILE_CONT(x, 0.75) - QUANTILE_CONT(x, 0.25)) / 1.34) * POW(COUNT(*), -0.2) AS hx,
 1.06 * LEAST(STDDEV_SAMP(y), (QUANTILE_CONT(y, 0.75) - QUANTILE_CONT(y, 0.25)) / 1.34) * POW(COUNT(*), -0.2) AS hy
 FROM {tag}_v GROUP BY {keys} HAVING COUNT(*) >= 2""",
    )
    part(
        f"{tag}_x",
        f"{tag}_g {tag}_v",
        f"""SELECT {keys}, v.x AS px, v.y AS py, i, EXP(-POW((g.xl + (g.xh - g.xl) * i / 99.0 - v.x) / hx, 2) / 2) AS kx
 FROM {tag}_v v JOIN {tag}_g g USING ({keys}) CROSS JOIN (SELECT UNNEST(RANGE(0, 100)) AS i)
 WHERE hx > 0 AND hy > 0""",
    )
    part(
        f"{tag}_d",
        f"{tag}_x",
        f"""SELECT {keys}, i AS ix, j AS iy, g.xl + (g.xh - g.xl) * i / 99.0 AS x,
 g.yl + (g.yh - g.yl) * j / 99.0 AS y,
 SUM(kx * EXP(-POW((g.yl + (g.yh - g.yl) * j / 99.0 - py) / hy, 2) / 2))
 / (2 * PI() * ANY_VALUE(n) * ANY_VALUE(hx) * ANY_VALUE(hy)) AS density
 FROM {tag}_x JOIN {tag}_g g USING ({keys}) CROSS JOIN (SELECT UNNEST(RANGE(0, 100)) AS j)
 GROUP BY {keys}, i, j, g.xl, g.xh, g.yl, g.yh""",
    )
    return chain(
        f"{tag}_d",
        f"""SELECT {keys}, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, {r9("x", "y", "density")},
 ROUND(density / MAX(density) OVER (PARTITION BY {keys}), 9) AS ndensity FROM {tag}_d""",
    )


def box_parts() -> None:
    part(
        "boxq",
        "comp",
        """SELECT season, Period, QUANTILE_CONT(cdh_ave, 0.25) AS q25, MEDIAN(cdh_ave) AS median,
 QUANTILE_CONT(cdh_ave, 0.75) AS q75, COUNT(*) AS n FROM comp GROUP BY 1, 2""",
    )
    part(
        "boxed",
        "comp boxq",
        """SELECT c.ID, c.cdh_ave, q.*, cdh_ave BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside
 FROM comp c JOIN boxq q ON c.season = q.season AND c.Period = q.Period""",
    )


def loess_sql(source: str, key: str, x: str, y: str) -> str:
    """Local quadratic fit over single rows rather than distinct abscissae."""
    tag = f"lo_{source}"
    part(
        f"{tag}_p",
        source,
        f"SELECT {key} AS grp, CAST({x} AS DOUBLE) AS x, {y} AS y FROM {source} WHERE {y} IS NOT NULL",
    )
    part(
        f"{tag}_g",
        f"{tag}_p",
        f"""SELECT grp, i, lo + (hi - lo) * i / 79.0 AS x0, GREATEST(FLOOR(n * 0.75 + 1e-5), 1) AS q FROM
 (SELECT grp, MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n, UNNEST(RANGE(0, 80)) AS i FROM {tag}_p GROUP BY grp)""",
    )
    part(
        f"{tag}_d",
        f"{tag}_g",
        f"""SELECT grp, i, x0, q, x, y, ABS(x - x0) AS d, ROW_NUMBER() OVER (PARTITION BY grp, i ORDER BY ABS(x - x0)) AS place
 FROM {tag}_g JOIN {tag}_p USING (grp)""",
    )
    part(
        f"{tag}_w",
        f"{tag}_d",
        f"""SELECT *, CASE WHEN d <= r * 0.001 THEN 1.0 WHEN d < r * 0.999 THEN POW(1 - POW(d / r, 3), 3) ELSE 0 END AS w,
 CASE WHEN r > 0 THEN (x - x0) / r ELSE 0 END AS u FROM
 (SELECT *, MAX(CASE WHEN place = q THEN d END) OVER (PARTITION BY grp, i) AS r FROM {tag}_d)""",
    )
    part(
        f"{tag}_s",
        f"{tag}_w",
        f"""SELECT grp, i, x0, COUNT(DISTINCT x) AS k, SUM(w) AS a0, SUM(w * u) AS a1, SUM(w * u * u) AS a2,
 SUM(w * u * u * u) AS a3, SUM(w * u * u * u * u) AS a4, SUM(w * y) AS b0, SUM(w * u * y) AS b1, SUM(w * u * u * y) AS b2
 FROM {tag}_w WHERE w > 0 GROUP BY grp, i, x0""",
    )
    return chain(
        f"{tag}_s",
        f"""SELECT grp AS {"season" if key == "season" else "scope"}, CAST(i AS INT) AS i, ROUND(x0, 6) AS x,
 ROUND(CASE WHEN k >= 3 THEN (b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - a3 * b2) + a2 * (b1 * a3 - a2 * b2))
 / (a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2))
 WHEN k = 2 THEN (b0 * a2 - b1 * a1) / (a0 * a2 - a1 * a1) ELSE b0 / a0 END, 6) AS fit FROM {tag}_s""",
    )


EVENT_COLUMNS = (
    "ID, date, RN, "
    + r9("TA", "Pmax_7day", "hw_thrsld", "pl_thrsld", "P_excess_rel", "T_anom_rel", "Tmax_percentile", "intensity")
    + ", CAST(yr AS INT) AS year, CAST(mon AS INT) AS month, season, CAST(year_season AS INT) AS year_season, Long, Lat"
)
YS = "CAST(year_season AS INT) AS year_season"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    out["station_days"] = chain("obs", f"SELECT ID, date, {r9('TA')}, RN FROM obs")
    out["station_file_scan"] = chain(
        "obs",
        f"""SELECT ID, date, CASE WHEN DAY(date) IN (27, 29, 30) THEN NULL ELSE ROUND(TA, 9) END AS TA,
 CASE WHEN DAY(date) IN (26, 28) THEN NULL ELSE RN END AS RN FROM obs
 WHERE date BETWEEN DATE '1995-06-01' AND DATE '2001-05-31'""",
    )
    out["station_file_scan_blanks"] = out["station_file_scan"]
    out["station_list"] = chain("stn", "SELECT ID AS STN_ID, Long, Lat FROM stn")
    out["saved_counts"] = chain(
        "months stn",
        """SELECT m.ID, CAST(mon AS INT) AS month, CAST(num_coincidence AS BIGINT) AS num_coincidence,
 Long, Lat, CAST(yr AS INT) AS year FROM months m LEFT JOIN stn s ON m.ID = s.ID""",
    )
    out["rolling_temperature"] = chain("roll", f"SELECT ID, date, {r9('roll_temp')} FROM roll")
    out["hot_thresholds"] = chain("hot", "SELECT ID, CAST(jdate AS INT) AS jdate, hw_thrsld, n FROM hot")
    out["wet_thresholds"] = chain("wet", "SELECT ID, pl_thrsld FROM wet")
    out["eligible_stations"] = chain("elig", "SELECT ID FROM elig")
    out["day_flags"] = chain(
        "fact",
        """SELECT ID, date, hw_thrsld, heatwave, pl_thrsld, heavy AS extreme_precip, hw_pluvial FROM fact""",
    )
    part(
        "warm",
        "base",
        """SELECT *, ROW_NUMBER() OVER (PARTITION BY ID ORDER BY date)
 - ROW_NUMBER() OVER (PARTITION BY ID, TA > 25 ORDER BY date) AS isl FROM base""",
    )
    out["long_runs"] = chain(
        "warm",
        """SELECT ID, date, TA > 25 AND COUNT(*) OVER (PARTITION BY ID, TA > 25, isl) >= 4 AS in_run FROM warm""",
    )
    out["climate_fact"] = chain(
        "fact rate stn",
        f"""SELECT f.ID, CAST(f.yr AS INT) AS year, f.date, {r9('TA')}, RN, CAST(jdate AS INT) AS jdate,
 CAST(mon AS INT) AS month, hw_thrsld, heatwave, pl_thrsld, heavy AS extreme_precip, hw_pluvial,
 ROUND(CASE WHEN events > 0 THEN coincidences / events END, 9) AS ecr, Long, Lat
 FROM fact f LEFT JOIN rate r ON f.ID = r.ID AND f.yr = r.yr LEFT JOIN stn s ON f.ID = s.ID""",
    )
    out["saved_climate_fact"] = out["climate_fact"]
    out["forward_max_percentile"] = chain("ahead", f"SELECT ID, date, {r9('Pmax_7day')} FROM ahead")
    ranks = "ROUND(pt, 9) AS Tmax_percentile, ROUND(pr, 9) AS P_percentile"
    out["station_percent_ranks"] = chain("ranked", f"SELECT ID, date, {ranks} FROM ranked")
    out["pooled_percent_ranks"] = chain("pooled", f"SELECT ID, date, {ranks} FROM pooled")

    out["ecr_station_year"] = chain(
        "rate",
        """SELECT ID, CAST(yr AS INT) AS year, CAST(events AS BIGINT) AS events,
 CAST(coincidences AS BIGINT) AS coincidences,
 ROUND(CASE WHEN events > 0 THEN coincidences / events END, 9) AS ecr FROM rate""",
    )
    part(
        "floods",
        "base",
        """SELECT ID, CAST(RN > 0 AS INT) AS rain, CASE WHEN RN > 0 AND COALESCE(MAX(CAST(RN > 40 AS INT)) OVER
 (PARTITION BY ID, yr ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) = 1 THEN 1 ELSE 0 END AS hit
 FROM base""",
    )
    out["ecr_rain_after_rain"] = chain(
        "floods",
        """SELECT ID, CAST(SUM(rain) AS BIGINT) AS events, CAST(SUM(hit) AS BIGINT) AS coincidences,
 ROUND(SUM(hit) / SUM(rain), 9) AS ecr FROM floods GROUP BY ID""",
    )
    out["monthly_counts"] = chain(
        "months stn",
        """SELECT m.ID, CAST(yr AS INT) AS year, CAST(mon AS INT) AS month,
 CAST(num_coincidence AS BIGINT) AS num_coincidence, Long, Lat FROM months m LEFT JOIN stn s ON m.ID = s.ID""",
    )
    out["seasonal_counts"] = chain(
        "seas",
        f"""SELECT ID, {YS}, season, CAST(cdh_count AS BIGINT) AS cdh_count, n_months,
 CASE season WHEN 'DJF' THEN 1 WHEN 'MAM' THEN 2 WHEN 'JJA' THEN 3 ELSE 4 END AS season_order FROM seas""",
    )
    out["base_means"] = chain(
        "bmean stn",
        f"""SELECT b.ID, season, {r9('base_ave', 'cdh_sd')}, Long, Lat,
 {classes('base_ave', COUNTS, (0, 10))} AS class FROM bmean b LEFT JOIN stn s ON b.ID = s.ID""",
    )
    out["target_means"] = chain(
        "tmean stn",
        f"""SELECT t.ID, season, {r9('target_ave')}, Long, Lat, {classes('target_ave', COUNTS, (0, 6))} AS class
 FROM tmean t LEFT JOIN stn s ON t.ID = s.ID""",
    )
    part("allmean", "seas", "SELECT ID, season, AVG(cdh_count) AS cdh_ave FROM seas GROUP BY 1, 2")
    part("yearmean", "seas", "SELECT ID, AVG(cdh_count) AS cdh_ave, 'all seasons' AS scope FROM seas GROUP BY 1")
    out["seasonal_means"] = chain(
        "allmean stn",
        f"""SELECT a.ID, season, {r9('cdh_ave')}, Long, Lat, {classes('cdh_ave', COUNTS, (0, 6))} AS class
 FROM allmean a LEFT JOIN stn s ON a.ID = s.ID""",
    )
    out["annual_means"] = chain(
        "yearmean stn",
        f"""SELECT a.ID, {r9('cdh_ave')}, Long, Lat,
 {classes('cdh_ave', (0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0), (0, 2.5))} AS class
 FROM yearmean a LEFT JOIN stn s ON a.ID = s.ID""",
    )
    out["recent_points"] = chain(
        "seas",
        """SELECT season, CAST(year_season AS VARCHAR) AS year_season, ROUND(AVG(cdh_count), 9) AS cdh_ave,
 '2000-2001' AS Period, CASE season WHEN 'DJF' THEN 1 WHEN 'JJA' THEN 2 WHEN 'MAM' THEN 3 ELSE 4 END AS axis_place
 FROM seas WHERE year_season IN (2000, 2001) GROUP BY season, year_season""",
    )
    total = f"SELECT {YS}, season, CAST(total_cphw AS BIGINT) AS total_cphw FROM totals"
    out["regional_totals"] = chain("totals", total)
    out["regional_totals_from_months"] = chain(
        "totals", total + " WHERE year_season BETWEEN 1995 AND 1999"
    )
    out["period_comparison"] = chain(
        "comp", f"SELECT ID, season, {r9('cdh_ave', 'cdh_sd')}, Period FROM comp"
    )
    out["standardised_anomaly"] = chain(
        "anom stn",
        f"""SELECT a.ID, season, {r9('base_ave', 'cdh_sd', 'target_ave', 'anomaly')}, Long, Lat,
 {classes('anomaly', (-4, -2, 0, 2, 4, 7), (-4, 6))} AS class FROM anom a LEFT JOIN stn s ON a.ID = s.ID""",
    )
    out["exceedance_counts"] = chain(
        "anom",
        "SELECT season, COUNT(DISTINCT ID) AS n_gauge FROM anom WHERE anomaly > 2 GROUP BY season",
    )
    out["exceedance_ratio"] = chain(
        "anom",
        """SELECT season, COUNT(DISTINCT ID) AS total_gauge, COUNT(DISTINCT CASE WHEN anomaly > 2 THEN ID END) AS n_anom_gt2,
 ROUND(100.0 * COUNT(DISTINCT CASE WHEN anomaly > 2 THEN ID END) / COUNT(DISTINCT ID), 9) AS ratio_pct
 FROM anom GROUP BY season""",
    )
    out["anomaly_limits"] = chain(
        "anom",
        """SELECT ROUND(MIN(anomaly), 9) AS low, ROUND(MAX(anomaly), 9) AS high,
 ROUND(MAX(ABS(anomaly)), 9) AS max_abs FROM anom""",
    )
    out["baseline_stats"] = chain("bstat", f"SELECT season, {r9('mu', 'sigma')} FROM bstat")
    out["ecdf_rank"] = chain("ecdf", f"SELECT season, {r9('P_value')}, Is_Record FROM ecdf")
    out["season_anomaly_table"] = chain(
        "totals bstat ecdf",
        f"""SELECT t.season, CAST(t.total_cphw AS BIGINT) AS target_total, {r9('mu', 'sigma')},
 ROUND((t.total_cphw - mu) / sigma, 9) AS Z_score, {r9('P_value')},
 CASE WHEN Is_Record THEN 'Record High (100%)' WHEN P_value >= 99 THEN 'Extremely High (>99th)'
 WHEN P_value >= 95 THEN 'Very High (>95th)' WHEN P_value >= 90 THEN 'High (>90th)'
 ELSE 'Near Average (<90th)' END AS Record_Status
 FROM totals t LEFT JOIN bstat b ON t.season = b.season LEFT JOIN ecdf e ON t.season = e.season
 WHERE t.year_season = 2000""",
    )
    part(
        "rpz",
        "smean",
        """SELECT s.year_season, s.season, s.v AS obs_intensity, mu, sigma, (s.v - mu) / sigma AS Z_score FROM smean s
 LEFT JOIN (SELECT season, AVG(v) AS mu, STDDEV_SAMP(v) AS sigma FROM smean WHERE year_season <= 1999 GROUP BY season) b
 ON s.season = b.season WHERE s.year_season >= 2000""",
    )
    out["return_periods"] = chain(
        "rpz",
        f"""SELECT season, {YS}, {r9('obs_intensity', 'mu', 'sigma', 'Z_score', digits=6)},
 ROUND(CASE WHEN Z_score > 8 THEN NULL ELSE 1 / (1 - {PHI.format(z='Z_score')}) END, 6) AS Return_Period FROM rpz""",
    )
    out["severity_events"] = chain("ev", f"SELECT {EVENT_COLUMNS} FROM ev")
    out["same_day_events"] = chain(
        "sameday",
        f"""SELECT ID, date, {r9('TA')}, RN, CAST(yr AS INT) AS year, {ranks}, Tmax_bin, P_bin, Long, Lat FROM sameday""",
    )
    out["intensity_matrix"] = chain(
        "matrix",
        f"""SELECT P_bin, Tmax_bin, {r9('compound_intensity')}, ROUND_EVEN(compound_intensity, 2) AS label
 FROM matrix""",
    )
    out["matrix_stations"] = chain(
        "sameday matrix",
        f"""SELECT d.*, {r9('compound_intensity')} FROM (SELECT DISTINCT ID, Long, Lat, Tmax_bin, P_bin FROM sameday
 WHERE Tmax_bin IS NOT NULL AND P_bin IS NOT NULL) d
 LEFT JOIN matrix m ON d.Tmax_bin = m.Tmax_bin AND d.P_bin = m.P_bin""",
    )
    out["matrix_limits"] = chain(
        "matrix",
        """SELECT ROUND(MIN(compound_intensity), 9) AS low, ROUND(MAX(compound_intensity), 9) AS high,
 ROUND(MAX(ABS(compound_intensity)), 9) AS max_abs FROM matrix""",
    )
    out["severity_profile"] = chain(
        "prof",
        f"""SELECT ID, Long, Lat, season, {r9('mean_intensity', 'max_intensity', 'sum_intensity')}, freq,
 {classes('mean_intensity', (0, 20, 40, 60, 80, 90, 100), (0, 100))} AS class FROM prof""",
    )
    out["severity_profile_narrow"] = chain(
        "prof",
        f"""SELECT ID, Long, Lat, season, ROUND(mean_intensity, 9) AS mean_intensity,
 {classes('mean_intensity', (40, 50, 60, 70, 80, 90, 100), (40, 100))} AS class FROM prof""",
    )
    out["severity_station_median"] = chain(
        "ev",
        """SELECT ID, Long, Lat, ROUND(MEDIAN(intensity), 9) AS median_intensity FROM ev
 WHERE intensity > 0 GROUP BY 1, 2, 3""",
    )

    def mean_by_station_season(name: str, where: str) -> str:
        return f"""SELECT ID, Long, Lat, season, ROUND(AVG(intensity), 9) AS {name} FROM ev
 WHERE {where} GROUP BY 1, 2, 3, 4"""

    out["severity_base_by_calendar_year"] = chain(
        "ev", mean_by_station_season("base_mean", "intensity > 0 AND yr <= 1999")
    )
    out["severity_base_all_years"] = chain(
        "ev",
        f"""SELECT *, {classes('base_mean', (0, 40, 60, 80, 90, 100), (0, 100))} AS class FROM
 ({mean_by_station_season('base_mean', 'intensity > 0')})""",
    )
    out["severity_recent"] = chain(
        "ev",
        f"""SELECT *, {classes('recent_mean', (0, 40, 60, 80, 90, 100), (0, 100))} AS class FROM
 ({mean_by_station_season('recent_mean', 'year_season >= 2000')})""",
    )

    def shift(recent: str, base: str, extra: str = "") -> str:
        return f"""SELECT r.ID, r.Long, r.Lat, r.season, {r9('recent_mean', 'base_mean')},
 ROUND(recent_mean - base_mean, 9) AS anomaly{extra} FROM
 (SELECT ID, Long, Lat, season, AVG(intensity) AS recent_mean FROM ev WHERE {recent} GROUP BY 1, 2, 3, 4) r
 LEFT JOIN (SELECT ID, season, AVG(intensity) AS base_mean FROM ev WHERE {base} GROUP BY 1, 2) b
 ON r.ID = b.ID AND r.season = b.season"""

    out["severity_anomaly_calendar_year"] = chain(
        "ev",
        shift(
            "intensity > 0 AND yr >= 2000",
            "intensity > 0 AND yr < 2000",
            ", "
            + classes("(recent_mean - base_mean)", (-15, -10, -5, 0, 5, 10, 15), (-15, 15))
            + " AS class",
        ),
    )
    out["severity_anomaly_season_year"] = chain(
        "ev",
        shift(
            "year_season >= 2000",
            "intensity > 0",
            ", "
            + classes("(recent_mean - base_mean)", (-15, -10, -5, 0, 5, 10, 15), (-15, 15))
            + " AS class",
        ),
    )
    out["severity_series_median"] = chain(
        "smedian", f"SELECT {YS}, season, ROUND(v, 9) AS mean_intensity FROM smedian"
    )
    out["severity_series_mean"] = chain(
        "smean", f"SELECT {YS}, season, ROUND(v, 9) AS mean_intensity FROM smean"
    )
    out["station_season_medians"] = chain(
        "ssm", f"SELECT ID, {YS}, season, {r9('annual_mean_intensity')} FROM ssm"
    )
    out["mean_of_medians"] = chain("mom", f"SELECT ID, season, {r9('intensity_ave')} FROM mom")
    out["frequency_severity"] = chain(
        "prof",
        f"SELECT ID, Long, Lat, season, freq, {r9('sum_intensity', 'mean_intensity')} FROM prof",
    )
    out["frequency_severity_map"] = chain(
        "mom allmean stn",
        f"""SELECT m.ID, m.season, {r9('intensity_ave', 'cdh_ave')}, Long, Lat,
 {classes("cdh_ave", COUNTS, (0, 6))} AS class FROM mom m
 LEFT JOIN allmean a ON m.ID = a.ID AND m.season = a.season LEFT JOIN stn s ON m.ID = s.ID""",
    )
    out["count_trend"] = linear_sql("count_series_cut")
    out["count_excess_trend"] = linear_sql("excess_series")
    out["count_excess_mann_kendall"] = kendall_sql("excess_series")
    out["severity_trend"] = linear_sql("mean_series")
    out["count_trend_line"] = line_sql("count_series_cut")
    out["severity_trend_line"] = line_sql("median_series")
    out["count_mann_kendall"] = kendall_sql("count_series")
    out["severity_mann_kendall_median"] = kendall_sql("median_series")
    out["severity_mann_kendall_mean"] = kendall_sql("mean_series")

    ci = bootstrap_parts("bt", "seas", "cdh_count", "SUM", 1)
    out["bootstrap_total_ci"] = chain(ci, f"SELECT {YS}, season, {r9('ci_lower', 'ci_upper')} FROM {ci}")
    out["regional_series_ci"] = chain(
        f"totals {ci}",
        f"""SELECT CAST(t.year_season AS INT) AS year_season, t.season, CAST(total_cphw AS BIGINT) AS total_cphw,
 {r9('ci_lower', 'ci_upper')} FROM totals t LEFT JOIN {ci} c ON t.year_season = c.year_season AND t.season = c.season
 WHERE t.year_season <> 2001""",
    )
    ci = bootstrap_parts("bs", "ev", "intensity", "AVG", 5)
    out["severity_series_ci"] = chain(
        f"smean {ci}",
        f"""SELECT CAST(t.year_season AS INT) AS year_season, t.season, ROUND(v, 9) AS mean_intensity,
 {r9('ci_lower', 'ci_upper')} FROM smean t LEFT JOIN {ci} c ON t.year_season = c.year_season AND t.season = c.season""",
    )
    late = "CASE WHEN year_season <= 1997 THEN 'early' ELSE 'late' END AS Period"
    part("jper", "jnt", f"SELECT *, {late} FROM jnt")
    out["joint_events"] = chain(
        "jper", f"SELECT ID, date, season, Period, {r9('comp_int_rel')} FROM jper"
    )
    out["representative_events"] = chain(
        "rep",
        f"SELECT {EVENT_COLUMNS}, {r9('comp_int_rel', 'max_comb', 'diff')}, Period FROM rep",
    )
    out["event_counts_by_period"] = chain(
        "jper", "SELECT season, Period, COUNT(*) AS event FROM jper GROUP BY 1, 2"
    )

    def limits(source: str) -> str:
        return " UNION ALL ".join(
            f"""SELECT '{m}' AS measure, ROUND(QUANTILE_CONT({m}, 0.01), 9) AS low,
 ROUND(QUANTILE_CONT({m}, 0.99), 9) AS high, COUNT({m}) AS n FROM {source}"""
            for m in ("T_anom_rel", "P_excess_rel")
        )

    out["representative_limits"] = chain("rep", limits("rep"))
    out["event_limits"] = chain("ev", limits("ev"))
    out["count_histogram"] = histogram_sql("comp", "cdh_ave", 30, True)
    out["heat_anomaly_histogram"] = histogram_sql("rep", "T_anom_rel", 20, False)
    out["rain_excess_histogram"] = histogram_sql("rep", "P_excess_rel", 20, False)
    out["count_density"] = density_sql("comp", "cdh_ave", "season, Period", "season")
    out["annual_count_density"] = density_sql("yearmean", "cdh_ave", "scope", "scope")
    out["heat_anomaly_density"] = density_sql("rep", "T_anom_rel", "season, Period", "1")
    out["rain_excess_density"] = density_sql("rep", "P_excess_rel", "season, Period", "1")
    out["seasonal_mean_density"] = density_sql("allmean", "cdh_ave", "season", "1")
    out["representative_density_2d"] = density_2d_sql("rep")
    out["event_density_2d"] = density_2d_sql("jper")
    out["severity_density_2d"] = density_2d_sql("ev", "intensity", "season")
    box_parts()
    out["count_box_stats"] = chain(
        "boxed",
        f"""SELECT season, Period, {r9('q25', 'median', 'q75')}, n,
 ROUND(LEAST(MIN(CASE WHEN inside THEN cdh_ave END), q25), 9) AS whisker_low,
 ROUND(GREATEST(MAX(CASE WHEN inside THEN cdh_ave END), q75), 9) AS whisker_high,
 COUNT(*) FILTER (NOT inside) AS n_outliers FROM boxed GROUP BY season, Period, q25, median, q75, n""",
    )
    out["count_box_outliers"] = chain(
        "boxed", f"SELECT season, Period, ID, {r9('cdh_ave')} FROM boxed WHERE NOT inside"
    )
    out["frequency_severity_curve"] = loess_sql("prof", "'all seasons'", "freq", "mean_intensity")
    out["severity_series_curve"] = loess_sql("median_series", "season", "year_season", "v")
    return out


ORACLE_SQL = build()
