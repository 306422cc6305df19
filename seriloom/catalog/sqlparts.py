"""Shared SQL building blocks for the counterparts (DuckDB dialect)."""

from __future__ import annotations

from seriloom.functions import fixed_values as fv

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, sql: str, *deps: str) -> None:
    PARTS[name] = (list(deps), sql)


def sql(body: str, *deps: str) -> str:
    """``body`` behind the WITH clauses it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in PARTS[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body


def R(expr: str, name: str | None = None, places: int = 6) -> str:
    """Rounded double without negative zero; published figures are the exact binary value written out."""
    value = f"CAST({expr} AS DOUBLE)"
    out = f"(round({value}, {places}) + 0.0)"
    if places != 6:
        out = f"(CAST(format('{{:.{places}f}}', {value}) AS DOUBLE) + 0.0)"
    return f"{out} AS {name}" if name else out


def B(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def level_list(levels: list[float]) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in levels) + "]"


def wis_sql(y: str, q: str, levels: list[float], intervals: list[tuple[float, float, float]]) -> str:
    """WIS of ``q`` (a list aligned to ``levels``) against ``y``."""
    at = {round(x, 3): i + 1 for i, x in enumerate(levels)}
    terms = [f"0.5::DOUBLE * abs({y} - {q}[{at[0.5]}])"]
    for lo, hi, a in intervals:
        lower, upper = f"{q}[{at[round(lo, 3)]}]", f"{q}[{at[round(hi, 3)]}]"
        terms.append(
            f"{a / 2.0}::DOUBLE * (({upper} - {lower}) + {2.0 / a}::DOUBLE * "
            f"(greatest({lower} - {y}, 0.0) + greatest({y} - {upper}, 0.0)))"
        )
    return "(" + " + ".join(terms) + f") / {len(intervals) + 0.5}::DOUBLE"


ORDERS = {
    "nation": "SELECT n_name AS series_id, o.* FROM orders o JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey",
    "segment": "SELECT c_mktsegment AS series_id, o.* FROM orders o JOIN customer ON o_custkey = c_custkey",
    "nation_segment": "SELECT n_name || '/' || c_mktsegment AS series_id, o.* FROM orders o JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey",
    "customer": "SELECT 'C' || o_custkey AS series_id, o.* FROM orders o",
}
SUFFIX = {"nation": "", "segment": "_seg", "nation_segment": "_ns", "customer": "_cust"}

for _key, _src in ORDERS.items():
    _s = SUFFIX[_key]
    part(
        f"obs{_s}",
        "SELECT series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS obs_date, "
        "CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS ili, "
        "CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS ari "
        f"FROM ({_src}) GROUP BY 1, 2",
    )


def profile_part(name: str, src: str) -> None:
    """Indicator facts and the guard decision, from plain aggregates."""
    part(
        name,
        f"""SELECT *, CASE WHEN n_both >= {fv.MIN_BOTH_WEEKS}
            AND greatest(med_ili, med_ari) / least(med_ili, med_ari) > {fv.SCALE_RATIO}
            AND winner_weeks >= {fv.MIN_WINNER_WEEKS} AND winner_years >= {fv.MIN_WINNER_YEARS}
            THEN winner END AS keep_only
        FROM (SELECT *, CASE winner WHEN 'ari' THEN n_ari WHEN 'ili' THEN n_ili END AS winner_weeks,
                CASE winner WHEN 'ari' THEN years_ari WHEN 'ili' THEN years_ili END AS winner_years
            FROM (SELECT *, CASE WHEN med_ili IS NULL OR med_ari IS NULL THEN NULL
                    WHEN med_ari > med_ili THEN 'ari' ELSE 'ili' END AS winner
                FROM (SELECT series_id,
                    count(*) FILTER (WHERE ili IS NOT NULL AND ari IS NOT NULL) AS n_both,
                    count(*) FILTER (WHERE ili > 0) AS n_ili,
                    count(*) FILTER (WHERE ari > 0) AS n_ari,
                    date_diff('day', min(obs_date) FILTER (WHERE ili > 0), max(obs_date) FILTER (WHERE ili > 0))
                        / 365.25::DOUBLE AS years_ili,
                    date_diff('day', min(obs_date) FILTER (WHERE ari > 0), max(obs_date) FILTER (WHERE ari > 0))
                        / 365.25::DOUBLE AS years_ari,
                    quantile_cont(ili, 0.5) FILTER (WHERE ili > 0) AS med_ili,
                    quantile_cont(ari, 0.5) FILTER (WHERE ari > 0) AS med_ari
                    FROM {src} GROUP BY 1)))""",
        src,
    )


def combined_part(name: str, src: str, profile: str) -> None:
    part(
        name,
        f"""SELECT series_id, obs_date, cases, data_type FROM (
            SELECT o.series_id, o.obs_date, n_ili, n_ari,
                CASE WHEN n_ari = 0 THEN 0 WHEN n_ili = 0 THEN 1
                     WHEN keep_only = 'ili' THEN 0 WHEN keep_only = 'ari' THEN 1
                     WHEN coalesce(ili, 0) = 0 AND ari > 0 THEN 1 ELSE 0 END AS data_type,
                CASE WHEN n_ari = 0 THEN ili WHEN n_ili = 0 THEN ari
                     WHEN keep_only = 'ili' THEN ili WHEN keep_only = 'ari' THEN ari
                     WHEN coalesce(ili, 0) = 0 AND ari > 0 THEN ari ELSE ili END AS cases
            FROM {src} o JOIN {profile} p USING (series_id) WHERE n_ili > 0 OR n_ari > 0)
        WHERE n_ili = 0 OR n_ari = 0 OR cases > 0""",
        src,
        profile,
    )


def weekly_part(name: str, src: str) -> None:
    """Weekly means on a calendar spine, labelled by the closing Sunday."""
    part(
        f"{name}_m",
        "SELECT series_id, CAST(date_trunc('week', obs_date) + INTERVAL 6 DAY AS DATE) AS week, "
        f"avg(cases) AS value FROM {src} GROUP BY 1, 2",
        src,
    )
    part(
        name,
        f"""SELECT s.series_id, s.week,
            row_number() OVER (PARTITION BY s.series_id ORDER BY s.week) - 1 AS idx, m.value
        FROM (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
              FROM (SELECT series_id, min(week) AS lo, max(week) AS hi FROM {name}_m GROUP BY 1)) s
        LEFT JOIN {name}_m m ON m.series_id = s.series_id AND m.week = s.week""",
        f"{name}_m",
    )


for _key in ORDERS:
    _s = SUFFIX[_key]
    profile_part(f"profile{_s}", f"obs{_s}")
    combined_part(f"combined{_s}", f"obs{_s}", f"profile{_s}")
    weekly_part(f"weekly{_s}", f"combined{_s}")

# the first indicator alone keeps its zeros
part("ili_only", "SELECT series_id, obs_date, ili AS cases FROM obs", "obs")
weekly_part("weekly_ili", "ili_only")

# training series: zeros kept, runs of more than three zeros missing, lead-in trimmed
part(
    "no_runs",
    f"""SELECT series_id, week, idx, CASE WHEN value = 0 AND run > {fv.MAX_ZERO_RUN} THEN NULL ELSE value END AS value
    FROM (SELECT *, count(*) FILTER (WHERE value = 0) OVER (PARTITION BY series_id, grp) AS run
          FROM (SELECT *, count(*) FILTER (WHERE value IS NULL OR value <> 0)
                    OVER (PARTITION BY series_id ORDER BY idx) AS grp FROM weekly_ili))""",
    "weekly_ili",
)
part(
    "clean",
    f"""SELECT w.series_id, w.week, w.idx - coalesce(h.first_hit, 0) AS idx, w.value
    FROM no_runs w LEFT JOIN (
        SELECT a.series_id, min(a.idx) AS first_hit
        FROM (SELECT series_id, idx, count(*) OVER (PARTITION BY series_id) AS n,
                avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead
              FROM no_runs) a
        JOIN (SELECT series_id, quantile_cont(value, 0.5) AS med FROM no_runs WHERE value > 0 GROUP BY 1) b USING (series_id)
        WHERE a.idx < a.n - {fv.LEAD_WINDOW} AND a.ahead > {fv.LEAD_SHARE}::DOUBLE * b.med GROUP BY 1) h
    ON h.series_id = w.series_id WHERE w.idx >= coalesce(h.first_hit, 0)""",
    "no_runs",
)

# raw text feed
part(
    "feed",
    """SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS COUNTRY_CODE, n_name AS COUNTRY_AREA_TERRITORY,
        CASE WHEN o_orderkey % 97 = 0 THEN '7' ELSE strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') END AS ISO_WEEKSTARTDATE,
        CASE o_orderpriority WHEN '1-URGENT' THEN '0-4' WHEN '2-HIGH' THEN 'all' ELSE 'ALL' END AS AGEGROUP_CODE,
        CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' WHEN o_orderstatus = 'F' THEN CAST(CAST(floor(o_totalprice / 1000.0) AS BIGINT) AS VARCHAR)
             WHEN o_orderstatus = 'P' THEN '0' END AS ILI_CASE,
        CASE WHEN o_orderkey % 83 = 0 THEN '-' WHEN o_orderstatus = 'O' THEN CAST(CAST(floor(o_totalprice / 1000.0) AS BIGINT) AS VARCHAR)
             WHEN o_orderstatus = 'P' THEN '0' END AS ARI_CASE,
        o_orderkey AS row_key
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)

# several reports per day, two indicators on very different scales
part(
    "amounts",
    """SELECT n_name AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
        CASE o_orderstatus WHEN 'F' THEN round(o_totalprice / 1000.0) WHEN 'P' THEN 0.0::DOUBLE END AS ili,
        CASE WHEN o_orderstatus <> 'F' THEN round(round(o_totalprice / 1000.0) / 16.0) END AS ari
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
profile_part("profile_amounts", "amounts")

part(
    "weather",
    """SELECT l_returnflag AS location, CAST(l_shipdate AS DATE) AS date, avg(l_discount) AS temp_mean,
        max(l_discount) AS temp_max, min(l_discount) AS temp_min, avg(l_tax) AS humidity_mean, min(l_tax) AS humidity_min
    FROM lineitem GROUP BY 1, 2""",
)
part(
    "sites",
    """SELECT n_name AS series_id, CASE WHEN n_regionkey IN (0, 3) THEN 'A' WHEN n_regionkey IN (1, 4) THEN 'N' ELSE 'R' END AS location
    FROM nation""",
)
part(
    "boxes",
    """SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, lower(n_name) AS name,
        n_nationkey * 7.0::DOUBLE - 90.0 AS min_lon, n_nationkey * 5.0::DOUBLE - 65.0 AS min_lat,
        n_nationkey * 7.0::DOUBLE - 80.0 AS max_lon, n_nationkey * 5.0::DOUBLE - 58.5 AS max_lat FROM nation""",
)
part(
    "edges",
    """SELECT a.n_name AS src, b.n_name AS dst, r.rank FROM nation a, (SELECT unnest([1, 2, 3, 4]) AS rank) r
    JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5 * r.rank) % 25""",
)
