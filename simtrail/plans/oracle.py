"""Independent SQL for every registered query, written for DuckDB.

These are the cross-engine correctness checks: each statement computes the
same result as the Spark query of the same name, from the same driver tables
(views ``orders``, ``events``, ``customer`` ...), with engine-native SQL --
window ``percent_rank``/``lead`` over whole devices, ``quantile_cont``,
``GROUPING SETS`` -- rather than the library's distributed plans.
"""

from __future__ import annotations

from simtrail import config
from simtrail.plans.catalog import CORRIDOR, CORRIDORS, DAY_STEP, DAYS, PERIOD, SLOTS

F_, O_, P_ = SLOTS.names
FS, OS, PS = SLOTS.score_columns


def _mixed_activity() -> str:
    return """
activity AS (
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS ifa,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS carrier,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'cellular' ELSE 'wifi' END AS network,
         CAST(o_orderdate AS DATE) AS date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS brq_count
  FROM orders
)"""


def _activity(period=None) -> str:
    where = ""
    if period:
        where = (
            f"WHERE o_orderdate >= TIMESTAMP '{period[0]} 00:00:00' "
            f"AND o_orderdate < CAST(DATE '{period[1]}' + INTERVAL 1 DAY AS TIMESTAMP)"
        )
    return f"""
activity AS (
  SELECT o_custkey AS ifa, o_orderstatus AS carrier, 'cellular' AS network,
         CAST(o_orderdate AS DATE) AS date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS brq_count
  FROM orders {where}
)"""


def _base(period=None, months=False, activity=None) -> str:
    periods = (
        "CAST((year(last_date) * 12 + month(last_date)) - (year(first_date) * 12 + month(first_date)) + 1 AS DOUBLE)"
        if months
        else "CAST(1 AS DOUBLE)"
    )
    return (activity or _activity(period)) + f""",
valid AS (SELECT * FROM activity WHERE ifa IS NOT NULL AND carrier IS NOT NULL AND network = 'cellular'),
daily AS (SELECT ifa, carrier, date, sum(brq_count) AS brq_day FROM valid GROUP BY ifa, carrier, date),
pair AS (
  SELECT ifa, carrier, min(date) AS earliest_date, max(date) AS latest_date,
         count(date) AS data_usage_freq, CAST(sum(brq_day) AS BIGINT) AS brq_count
  FROM daily GROUP BY ifa, carrier
),
multi AS (SELECT * FROM pair WHERE ifa IN (SELECT ifa FROM pair GROUP BY ifa HAVING count(*) > 1)),
bounds AS (SELECT max(latest_date) AS last_date, min(earliest_date) AS first_date FROM multi),
rfm AS (
  SELECT ifa, carrier,
         CAST(date_diff('day', latest_date, last_date) + 1 AS INTEGER) AS recency_days,
         CAST(data_usage_freq AS DOUBLE) / {periods} AS usage_frequency,
         CAST(brq_count AS DOUBLE) / {periods} AS brq_m,
         data_usage_freq, brq_count
  FROM multi CROSS JOIN bounds
)"""


def _scores(period=None) -> str:
    return _base(period) + """,
pct AS (
  SELECT *,
    percent_rank() OVER (ORDER BY recency_days DESC NULLS LAST) AS r_percentile,
    percent_rank() OVER (ORDER BY usage_frequency ASC NULLS FIRST) AS f_percentile,
    percent_rank() OVER (ORDER BY brq_m ASC NULLS FIRST) AS m_percentile
  FROM rfm
),
score AS (
  SELECT *, r + f + m AS rfm FROM (
    SELECT *, r_percentile * CAST(5 AS DOUBLE) AS r, f_percentile * CAST(5 AS DOUBLE) AS f,
           m_percentile * CAST(5 AS DOUBLE) AS m
    FROM pct)
)"""


def _wide(period=None) -> str:
    zero = "CAST(0 AS DOUBLE)"
    per = ",\n".join(
        f"    sum(CASE WHEN carrier = '{c}' THEN coalesce(rfm, {zero}) ELSE {zero} END) AS {col}"
        for c, col in zip(SLOTS.names, SLOTS.score_columns)
    )
    return _scores(period) + f""",
wide AS (
  SELECT ifa,
    array_to_string(list_sort(list(DISTINCT carrier)), ',') AS carriers,
    CAST(count(DISTINCT carrier) AS INTEGER) AS carrier_number,
    list_reduce(list(coalesce(rfm, {zero}) ORDER BY carrier), lambda a, b: a + b) AS all_rfm,
{per}
  FROM score GROUP BY ifa HAVING count(DISTINCT carrier) > 1
)"""


def _pick(op: str) -> str:
    cols = dict(zip(SLOTS.names, SLOTS.score_columns))
    whens = []
    for c in SLOTS.names:
        others = [o for o in SLOTS.names if o != c]
        cond = " AND ".join(f"{cols[c]} {op} {cols[o]}" for o in others)
        whens.append(f"WHEN {cond} THEN '{c}'")
    return "CASE " + " ".join(whens) + f" ELSE '{config.NO_SIM}' END"


def _ranked(period=None) -> str:
    sec = []
    for remaining in (SLOTS.challenger_1, SLOTS.challenger_2, SLOTS.focal):
        rest = ", ".join(f"'{c}'" for c in SLOTS.names if c != remaining)
        sec.append(f"WHEN primary_sim IN ({rest}) AND third_raw IN ({rest}) THEN '{remaining}'")
    return _wide(period) + f""",
ranked0 AS (SELECT *, {_pick('>')} AS primary_sim, {_pick('<')} AS third_raw FROM wide),
ranked AS (
  SELECT *,
    CASE {' '.join(sec)} ELSE '{config.OTHER_SIM}' END AS secondary_sim,
    CASE WHEN carrier_number = 2 THEN '{config.NO_SIM}' ELSE third_raw END AS third_sim
  FROM ranked0
)"""


def _delta_expr(rule: str) -> str:
    if rule == "ranked":
        return (
            f"CASE WHEN secondary_sim = '{O_}' OR primary_sim = '{O_}' THEN {FS} - {OS} "
            f"WHEN secondary_sim = '{P_}' OR primary_sim = '{P_}' THEN {FS} - {PS} "
            f"ELSE {FS} - {OS} - {PS} END"
        )
    if rule == "total":
        return f"{FS} - {PS} - {OS}"
    if rule == "by_count":
        return f"CASE WHEN carrier_number = 3 THEN {FS} - {OS} ELSE {FS} - {PS} - {OS} END"
    raise ValueError(rule)


def _profile(period=None, rule="ranked") -> str:
    return _ranked(period) + f""",
profile AS (
  SELECT ifa, primary_sim, secondary_sim, third_sim, all_rfm, {FS}, {OS}, {PS},
         {_delta_expr(rule)} AS delta_rfm
  FROM ranked
)"""


def _with(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


SCORE_COLS = (
    "ifa, carrier, recency_days, usage_frequency, brq_m, data_usage_freq, brq_count, "
    "r_percentile, f_percentile, m_percentile, r, f, m, rfm"
)

DELTA_SEGMENTS = """
SELECT delta_class, devices,
       CAST(devices AS DOUBLE) / CAST(sum(devices) OVER () AS DOUBLE) * CAST(100 AS DOUBLE) AS share_pct
FROM (
  SELECT CASE WHEN delta_rfm > 0 THEN 'primary_focal' WHEN delta_rfm < 0 THEN 'secondary_focal'
              WHEN delta_rfm = 0 THEN 'either' END AS delta_class,
         count(DISTINCT ifa) AS devices
  FROM profile GROUP BY 1
)"""

# --- job B -------------------------------------------------------------------
DAYPART_SQL = " ".join(
    f"WHEN hour(seen_at) BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in config.DAYPARTS
)


def _features(devices: bool = False, seen_at: str = "ts", obs_id: str = "event_id") -> str:
    restrict = ""
    prefix = ""
    if devices:
        prefix = _profile().strip() + ",\n"
        restrict = "WHERE user_id IN (SELECT ifa FROM profile)"
    return prefix + f"""
pts AS (SELECT user_id AS ifa, {obs_id} AS obs_id, {seen_at} AS seen_at, event_type AS state FROM events {restrict}),
moves AS (
  SELECT *, lead(state) OVER w AS next_state, (lead(1) OVER w) IS NOT NULL AS has_next
  FROM pts WINDOW w AS (PARTITION BY ifa ORDER BY seen_at ASC NULLS FIRST, obs_id ASC NULLS FIRST, state ASC NULLS FIRST)
),
trip AS (
  SELECT *, state || '{config.TRAVEL_SEPARATOR}' || next_state AS travel FROM moves
  WHERE has_next AND state IS NOT NULL AND next_state IS NOT NULL AND state <> next_state
),
feat AS (
  SELECT *, dayname(seen_at) AS day, CAST(hour(seen_at) AS INTEGER) AS hour,
    CASE WHEN dayofweek(seen_at) IN (0, 6) THEN 'weekend' WHEN seen_at IS NOT NULL THEN 'weekday' END AS weekday_weekend,
    CASE {DAYPART_SQL} END AS time_of_day
  FROM trip
),
tprofile AS (
  SELECT ifa, travel, weekday_weekend, time_of_day, count(*) AS count
  FROM feat GROUP BY ifa, travel, weekday_weekend, time_of_day
)"""


def _corridor() -> str:
    keys = ", ".join(f"'{k}'" for k in config.corridor_keys(*CORRIDOR))
    return _features() + f""",
crows AS (SELECT ifa, weekday_weekend, time_of_day, count FROM tprofile WHERE travel IN ({keys})),
per_device AS (SELECT ifa, CAST(sum(count) AS BIGINT) AS count FROM crows GROUP BY ifa)"""


def _tiers(cuts=config.TIER_CUTS) -> str:
    ps = ", ".join(str(c) for c in cuts)
    whens = [f"WHEN count > 0 AND count <= c[1] THEN '{config.TIER_LABELS[0][0]}'"]
    for i in range(1, len(cuts)):
        whens.append(f"WHEN count > c[{i}] AND count <= c[{i + 1}] THEN '{config.TIER_LABELS[i][0]}'")
    whens.append(f"WHEN count > c[{len(cuts)}] THEN '{config.TIER_LABELS[len(cuts)][0]}'")
    levels = " ".join(
        f"WHEN tier_id = '{tid}' THEN '{name}'" for tid, name in config.TIER_LABELS[: len(cuts) + 1]
    )
    return _corridor() + f""",
cuts AS (SELECT quantile_cont(count, [{ps}]) AS c FROM per_device WHERE count IS NOT NULL),
tier0 AS (SELECT ifa, count, CASE {' '.join(whens)} END AS tier_id FROM per_device CROSS JOIN cuts),
tiers AS (SELECT ifa, count, tier_id, CASE {levels} END AS tier_level FROM tier0)"""


def _corridors() -> str:
    names = " ".join(
        f"WHEN travel IN ({', '.join(repr(k) for k in config.corridor_keys(a, b))}) THEN '{a}{config.TRAVEL_SEPARATOR}{b}'"
        for a, b in CORRIDORS
    )
    whens = [
        f"WHEN count > {'0' if i == 0 else f'c[{i}]'} AND count <= c[{i + 1}] THEN '{config.TIER_LABELS[i][1]}'"
        for i in range(len(config.TIER_CUTS))
    ]
    ids = [w.replace(f"'{config.TIER_LABELS[i][1]}'", f"'{config.TIER_LABELS[i][0]}'") for i, w in enumerate(whens)]
    last, label = f"WHEN count > c[{len(config.TIER_CUTS)}] THEN", config.TIER_LABELS[len(config.TIER_CUTS)]
    return _features() + f""",
crows AS (SELECT CASE {names} END AS corridor, ifa, weekday_weekend, time_of_day, count FROM tprofile),
per_device AS (SELECT corridor, ifa, CAST(sum(count) AS BIGINT) AS count FROM crows WHERE corridor IS NOT NULL GROUP BY 1, 2),
cuts AS (SELECT corridor, quantile_cont(count, [{', '.join(map(str, config.TIER_CUTS))}]) AS c FROM per_device GROUP BY corridor),
tiers AS (
  SELECT corridor, ifa, count, CASE {' '.join(ids)} {last} '{label[0]}' END AS tier_id,
         CASE {' '.join(whens)} {last} '{label[1]}' END AS tier_level
  FROM per_device JOIN cuts USING (corridor)
)"""


def _corridor_segments(source: str, dim: str, agg: str) -> str:
    return f"""
SELECT corridor, CASE WHEN grouping(segment) = 1 THEN '{config.ALL_SEGMENTS}' ELSE segment END AS segment, {dim}, {agg}
FROM {source} JOIN membership USING (ifa) WHERE corridor IS NOT NULL
GROUP BY GROUPING SETS ((corridor, segment, {dim}), (corridor, {dim}))"""


MEMBERSHIP = "membership AS (SELECT c_custkey AS ifa, c_mktsegment AS segment FROM customer)"


def _segment_grouping(source: str, dim: str, agg: str) -> str:
    return f"""
SELECT CASE WHEN grouping(segment) = 1 THEN '{config.ALL_SEGMENTS}' ELSE segment END AS segment,
       {dim}, {agg}
FROM {source} JOIN membership USING (ifa)
GROUP BY GROUPING SETS ((segment, {dim}), ({dim}))"""


def oracle_sql() -> dict[str, str]:
    deciles = ", ".join(str(p) for p in config.DECILES)
    decile_cols = ", ".join(f"p[{i + 1}] AS p{round(p * 100):02d}" for i, p in enumerate(config.DECILES))
    return {
        "multi_sim_devices": _with(
            _activity(),
            "SELECT ifa, count(DISTINCT carrier) AS total_carriers FROM activity "
            "WHERE carrier IS NOT NULL AND network = 'cellular' GROUP BY ifa HAVING count(DISTINCT carrier) > 1",
        ),
        "rfm_base": _with(_base(), "SELECT * FROM rfm"),
        "rfm_base_monthly_norm": _with(_base(months=True), "SELECT * FROM rfm"),
        "rfm_base_mixed": _with(_base(activity=_mixed_activity()), "SELECT * FROM rfm"),
        "rfm_score": _with(_scores(), f"SELECT {SCORE_COLS} FROM score"),
        "recency_rank": _with(_scores(), "SELECT ifa, carrier, recency_days, r_percentile FROM score"),
        "frequency_rank": _with(_scores(), "SELECT ifa, carrier, usage_frequency, f_percentile FROM score"),
        "monetary_rank": _with(_scores(), "SELECT ifa, carrier, brq_m, m_percentile FROM score"),
        "recency_distribution": _with(
            _base(), "SELECT recency_days, carrier, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY 1, 2"
        ),
        "frequency_distribution": _with(
            _base(), "SELECT data_usage_freq, carrier, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY 1, 2"
        ),
        "monetary_distribution": _with(
            _base(), "SELECT brq_m, carrier, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY 1, 2"
        ),
        "score_key_check": _with(
            _scores(),
            "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT ifa, carrier FROM score)) AS distinct_keys FROM score",
        ),
        "score_maxima": _with(_scores(), "SELECT max(r) AS max_r, max(f) AS max_f, max(m) AS max_m FROM score"),
        "carrier_wide": _with(_wide(), f"SELECT ifa, carriers, carrier_number, all_rfm, {FS}, {OS}, {PS} FROM wide"),
        "carrier_pivot": _with(
            _scores(),
            "SELECT ifa, "
            + ", ".join(
                f"coalesce(sum(rfm) FILTER (WHERE carrier = '{c}'), CAST(0 AS DOUBLE)) AS {col}"
                for c, col in zip(SLOTS.names, SLOTS.score_columns)
            )
            + " FROM score GROUP BY ifa",
        ),
        "sim_rank": _with(
            _ranked(),
            f"SELECT ifa, carrier_number, {FS}, {OS}, {PS}, primary_sim, secondary_sim, third_sim FROM ranked",
        ),
        "sim_profile": _with(_profile(), "SELECT * FROM profile"),
        "sim_profile_period": _with(_profile(PERIOD), "SELECT * FROM profile"),
        "focal_delta_total": _with(_profile(rule="total"), "SELECT ifa, delta_rfm FROM profile"),
        "focal_delta_by_count": _with(_profile(rule="by_count"), "SELECT ifa, delta_rfm FROM profile"),
        "profile_key_check": _with(
            _profile(), "SELECT count(*) AS rows, count(DISTINCT ifa) AS distinct_keys FROM profile"
        ),
        "carrier_number_values": _with(_wide(), "SELECT DISTINCT carrier_number FROM wide"),
        "delta_segments": _with(_profile(), DELTA_SEGMENTS),
        "delta_segments_period": _with(_profile(PERIOD), DELTA_SEGMENTS),
        "primary_sim_breakdown": _with(
            _profile(), "SELECT primary_sim, count(DISTINCT ifa) AS count FROM profile GROUP BY 1"
        ),
        "secondary_sim_breakdown": _with(
            _profile(), "SELECT secondary_sim, count(DISTINCT ifa) AS count FROM profile GROUP BY 1"
        ),
        "location_points": f"""
SELECT user_id AS ifa, event_id AS obs_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at,
       event_type AS city, event_type AS state, '{config.COUNTRY_KEPT}' AS country, CAST(1 AS BIGINT) AS brq_count
FROM events""",
        "movement_table": _with(
            _features(seen_at="date_trunc('second', ts)"),
            "SELECT ifa, obs_id, state AS city, state, CAST(1 AS BIGINT) AS brq_count, "
            "strftime(seen_at, '%Y-%m-%d') AS date, strftime(seen_at, '%H:%M:%S') AS time, dayname(seen_at) AS day, "
            "CAST(hour(seen_at) AS INTEGER) AS hour, next_state, has_next FROM moves",
        ),
        "trips_tied": _with(
            _features(seen_at="date_trunc('hour', ts)", obs_id="CAST(NULL AS BIGINT)"),
            "SELECT ifa, state, next_state, travel, day, hour, weekday_weekend, time_of_day FROM feat",
        ),
        "profile_csv_round_trip": _with(_profile(), "SELECT CAST(ifa AS VARCHAR) AS ifa, * EXCLUDE (ifa) FROM profile"),
        "segments_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS ifa, c_mktsegment AS segment FROM customer",
        "locations_round_trip": f"""
SELECT CAST(user_id AS VARCHAR) AS ifa, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at,
       event_type AS city, event_type AS state, '{config.COUNTRY_KEPT}' AS country, CAST(1 AS BIGINT) AS brq_count
FROM events""",
        "locations_of_days": f"""
SELECT CAST(user_id AS VARCHAR) AS ifa, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at,
       event_type AS city, event_type AS state, '{config.COUNTRY_KEPT}' AS country, CAST(1 AS BIGINT) AS brq_count
FROM (SELECT * REPLACE (ts + to_days(CAST({DAY_STEP - 1} * (day(ts) - 1) AS INTEGER)) AS ts) FROM events)
WHERE CAST(ts AS DATE) BETWEEN DATE '{DAYS[0]}' AND DATE '{DAYS[1]}'""",
        "activity_of_period": _with(
            _activity(PERIOD),
            "SELECT CAST(ifa AS VARCHAR) AS ifa, carrier, network, strftime(date, '%Y-%m-%d') AS date, brq_count FROM activity",
        ),
        "segment_folders_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS ifa, c_mktsegment AS segment FROM customer",
        "profile_replaced_round_trip": _with(_profile(), "SELECT CAST(ifa AS VARCHAR) AS ifa, * EXCLUDE (ifa) FROM profile"),
        "rfm_base_merged": _with(_base(), "SELECT * FROM rfm"),
        "sim_profile_of_states": _with(_profile(PERIOD), "SELECT * FROM profile"),
        "movements": _with(_features(), "SELECT ifa, obs_id, state, next_state, has_next FROM moves"),
        "trips": _with(
            _features(),
            "SELECT ifa, obs_id, state, next_state, travel, day, hour, weekday_weekend, time_of_day FROM feat",
        ),
        "trip_profile": _with(_features(), "SELECT * FROM tprofile"),
        "od_matrix": _with(
            _features(),
            "SELECT travel, weekday_weekend, time_of_day, CAST(sum(count) AS BIGINT) AS count "
            "FROM tprofile GROUP BY 1, 2, 3",
        ),
        "travel_counts": _with(_features(), "SELECT travel, count(*) AS count FROM trip GROUP BY 1"),
        "undirected_travel": _with(
            _features(),
            f"SELECT least(state, next_state) || '{config.TRAVEL_SEPARATOR}' || greatest(state, next_state) AS route, "
            "count(*) AS count FROM trip GROUP BY 1",
        ),
        "top_trips": _with(
            _features(),
            "SELECT * FROM tprofile ORDER BY count DESC, ifa, travel, weekday_weekend, time_of_day LIMIT 10",
        ),
        "profiled_trip_profile": _with(_features(devices=True), "SELECT * FROM tprofile"),
        "profiled_trips_early": _with(
            _features(devices=True),
            "SELECT ifa, obs_id, state, next_state, travel, day, hour, weekday_weekend, time_of_day FROM feat",
        ),
        "corridor_by_weekpart": _with(
            _corridor(), "SELECT weekday_weekend, CAST(sum(count) AS BIGINT) AS count FROM crows GROUP BY 1"
        ),
        "corridor_by_daypart": _with(
            _corridor(), "SELECT time_of_day, CAST(sum(count) AS BIGINT) AS count FROM crows GROUP BY 1"
        ),
        "corridor_per_device": _with(_corridor(), "SELECT * FROM per_device"),
        "corridor_deciles": _with(
            _corridor(),
            f"SELECT {decile_cols} FROM (SELECT quantile_cont(count, [{deciles}]) AS p FROM per_device)",
        ),
        "corridor_tiers": _with(_tiers(), "SELECT * FROM tiers"),
        "corridor_tiers_four": _with(_tiers(config.TIER_CUTS_FOUR), "SELECT * FROM tiers"),
        "tier_levels": _with(_tiers(), "SELECT DISTINCT tier_level FROM tiers"),
        **{
            f"corridors_by_{name}": _with(
                _corridors(), f"SELECT corridor, {dim}, CAST(sum(count) AS BIGINT) AS count FROM crows WHERE corridor IS NOT NULL GROUP BY 1, 2"
            )
            for name, dim in (("weekpart", "weekday_weekend"), ("daypart", "time_of_day"))
        },
        "segment_tier_merged": _with(
            _tiers() + ",\n" + MEMBERSHIP,
            _segment_grouping("tiers", "tier_level", "count(DISTINCT ifa) AS ifa_count"),
        ),
        "sim_breakdowns_merged": _with(
            _profile(),
            " UNION ALL ".join(
                f"SELECT '{c}' AS rank, {c} AS sim, count(DISTINCT ifa) AS count FROM profile GROUP BY {c}"
                for c in ("primary_sim", "secondary_sim")
            ),
        ),
        "corridors_per_device": _with(_corridors(), "SELECT * FROM per_device"),
        "corridors_deciles": _with(
            _corridors(),
            f"SELECT corridor, {decile_cols} FROM (SELECT corridor, quantile_cont(count, [{deciles}]) AS p FROM per_device GROUP BY corridor)",
        ),
        "corridors_tiers": _with(_corridors(), "SELECT * FROM tiers"),
        "corridors_segment_tiers": _with(
            _corridors() + ",\n" + MEMBERSHIP, _corridor_segments("tiers", "tier_level", "count(DISTINCT ifa) AS ifa_count")
        ),
        **{
            f"corridors_segment_{name}s": _with(
                _corridors() + ",\n" + MEMBERSHIP, _corridor_segments("crows", dim, "CAST(sum(count) AS BIGINT) AS count")
            )
            for name, dim in (("weekpart", "weekday_weekend"), ("daypart", "time_of_day"))
        },
        "segment_tier_profile": _with(
            _tiers() + ",\n" + MEMBERSHIP,
            _segment_grouping("tiers", "tier_level", "count(DISTINCT ifa) AS ifa_count"),
        ),
        "segment_daypart_profile": _with(
            _corridor() + ",\n" + MEMBERSHIP
            + ",\ndp AS (SELECT ifa, time_of_day, CAST(sum(count) AS BIGINT) AS count FROM crows GROUP BY 1, 2)",
            _segment_grouping("dp", "time_of_day", "CAST(sum(count) AS BIGINT) AS count"),
        ),
        "segment_weekpart_profile": _with(
            _corridor() + ",\n" + MEMBERSHIP
            + ",\nwp AS (SELECT ifa, weekday_weekend, CAST(sum(count) AS BIGINT) AS count FROM crows GROUP BY 1, 2)",
            _segment_grouping("wp", "weekday_weekend", "CAST(sum(count) AS BIGINT) AS count"),
        ),
        "segment_travel": _with(
            _features() + ",\n" + MEMBERSHIP,
            "SELECT segment, travel, CAST(sum(count) AS BIGINT) AS count FROM tprofile JOIN membership USING (ifa) "
            "GROUP BY 1, 2",
        ),
    }
