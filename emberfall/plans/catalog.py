"""Named queries over the trade tables: one per table-valued operator.

Doubles are rounded at this edge only, so that results can be compared between
engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfall.functions.calendar import (
    alphabetical_season_index,
    period_of,
    season_order,
)
from emberfall.functions.measures import class_breaks
from emberfall.operators import (
    anomalies,
    bootstrap,
    coincidence,
    distribution,
    frequency,
    joint,
    ranks,
    rows,
    severity,
    thresholds,
    trend,
)
from emberfall.plans import climate
from emberfall.plans.settings import TRADE
from emberfall.sources import trade_view
from emberfall.sources.observations import FILE_COLUMNS, FILE_WIDTH, read_observations
from emberfall.sources.stations import read_stations, with_coordinates
from emberfall.sources.tables import load_table, save_table
from emberfall.workspace import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed class breaks and limits of the maps.
COUNT_BREAKS, COUNT_LIMITS = (0, 1, 2, 3, 4, 5, 6), (0, 6)
ANNUAL_BREAKS, ANNUAL_LIMITS = (0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0), (0, 2.5)
ANOMALY_BREAKS, ANOMALY_LIMITS = (-4, -2, 0, 2, 4, 7), (-4, 6)
SEVERITY_BREAKS, SEVERITY_LIMITS = (0, 40, 60, 80, 90, 100), (0, 100)
NARROW_BREAKS, NARROW_LIMITS = (40, 50, 60, 70, 80, 90, 100), (40, 100)
MEAN_SEVERITY_BREAKS = (0, 20, 40, 60, 80, 90, 100)
SHIFT_BREAKS, SHIFT_LIMITS = (-15, -10, -5, 0, 5, 10, 15), (-15, 15)

STATION_SEASON = ["ID", "Long", "Lat", "season"]
SERIES = ["year_season", "season"]


def tidy(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            F.round(F.col(name), digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def query(name: str, digits: int = 9) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def register(build: Query) -> Query:
        REGISTRY[name] = lambda spark, sf_dir: tidy(build(spark, sf_dir), digits)
        return build

    return register


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return climate.number_observations(trade_view.station_days(spark, sf), TRADE)


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return climate.compound_days(trade_view.station_days(spark, sf), TRADE)


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return climate.flagged_days(trade_view.station_days(spark, sf), TRADE)


def _seasons(spark: SparkSession, sf: str) -> DataFrame:
    return climate.season_counts(trade_view.station_days(spark, sf), TRADE)


def _located(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return with_coordinates(df, trade_view.stations(spark, sf))


def _events_of(days: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return _located(severity.severity_events(days), spark, sf)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _events_of(_days(spark, sf), spark, sf)


def _same_day(spark: SparkSession, sf: str) -> DataFrame:
    return _located(severity.same_day_events(_days(spark, sf)), spark, sf)


def _joint(spark: SparkSession, sf: str) -> DataFrame:
    return joint.joint_events(_events(spark, sf)).withColumn(
        "Period",
        period_of(
            F.col("year_season"), TRADE.last_early_year, ("early", "late")
        ),
    )


def _representatives(spark: SparkSession, sf: str) -> DataFrame:
    picked = joint.representative_events(joint.joint_events(_events(spark, sf)))
    labels = (TRADE.base_label, TRADE.target_label)
    return materialise(
        picked.withColumn("Period", period_of(F.col("year_season"), TRADE.base[1], labels)),
        "representatives",
    )


def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    seasons = materialise(_seasons(spark, sf), "seasons")
    return materialise(
        frequency.period_comparison(
            frequency.base_means(seasons, TRADE.base),
            frequency.target_means(seasons, TRADE.target),
            TRADE.base_label,
            TRADE.target_label,
        ),
        "comparison",
    )


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(frequency.regional_totals(_seasons(spark, sf)), "totals")


def _trended(series: DataFrame) -> DataFrame:
    return series.filter(F.col("year_season") != TRADE.dropped_year)


# Sources and sinks


@query("station_days")
def station_days(spark, sf):
    return trade_view.station_days(spark, sf)


def _raw_lines(days: DataFrame, between: str = ",") -> DataFrame:
    """Station days as lines of the raw daily file, with its sentinels and gaps."""
    day = F.dayofmonth("date")
    heat = (
        F.when(day == 29, F.lit("-99.0"))
        .when(day == 30, F.lit("n/a"))
        .when(day == 27, F.lit("NaN"))
        .otherwise(F.col("TA").cast("string"))
    )
    rain = (
        F.when(day == 26, F.lit("Infinity"))
        .when(F.col("RN") == 0, F.lit("-9.0"))
        .otherwise(F.col("RN").cast("string"))
    )
    cells = [F.lit("0")] * FILE_WIDTH
    cells[FILE_COLUMNS["date_raw"]] = F.date_format("date", "yyyyMMdd")
    cells[FILE_COLUMNS["ID"]] = F.col("ID").cast("string")
    cells[FILE_COLUMNS["TA"]] = heat
    cells[FILE_COLUMNS["RN"]] = rain
    short = F.concat_ws(between, *cells[: FILE_COLUMNS["TA"] + 1])
    full = F.concat_ws(between, *cells)
    return days.select(F.when(day == 28, short).otherwise(full).alias("value"))


def _file_scan(spark: SparkSession, sf: str, between: str) -> DataFrame:
    lines = _raw_lines(trade_view.station_days(spark, sf), between)
    frame = spark.sql(
        "SELECT explode(array('# START', '#  TM, STN', '#7777END', 'end of file')) AS value"
    )
    path = scratch_path(spark, "raw")
    lines.unionByName(frame).write.text(path)
    return read_observations(
        spark, path, start="1995-06-01", end="2001-05-31", pattern="part-*"
    )


@query("station_file_scan")
def station_file_scan(spark, sf):
    return _file_scan(spark, sf, ",")


@query("station_file_scan_blanks")
def station_file_scan_blanks(spark, sf):
    return _file_scan(spark, sf, "   ")


@query("station_list")
def station_list(spark, sf):
    path = scratch_path(spark, "stations")
    listed = trade_view.stations(spark, sf)
    listed.select(F.lit(0).alias("X"), "STN_ID", "Long", "Lat").write.csv(path, header=True)
    return read_stations(spark, path)


@query("saved_counts")
def saved_counts(spark, sf):
    path = scratch_path(spark, "counts")
    save_table(
        _located(coincidence.monthly_counts(_flagged(spark, sf)), spark, sf), path, ["year"]
    )
    return load_table(spark, path)


@query("saved_climate_fact")
def saved_climate_fact(spark, sf):
    path = scratch_path(spark, "fact")
    save_table(climate_fact(spark, sf), path, ["year"])
    return load_table(spark, path)


# Windows and thresholds


@query("rolling_temperature")
def rolling_temperature(spark, sf):
    rolled = thresholds.rolling_temperature(_numbered(spark, sf), TRADE.rolling_rows)
    return rolled.select("ID", "date", "roll_temp")


@query("hot_thresholds")
def hot_thresholds(spark, sf):
    return thresholds.hot_thresholds(
        _numbered(spark, sf), TRADE.climatology, TRADE.hot_quantile, TRADE.rolling_rows
    )


@query("wet_thresholds")
def wet_thresholds(spark, sf):
    return thresholds.wet_thresholds(
        _numbered(spark, sf), TRADE.climatology, TRADE.wet_quantile
    )


@query("eligible_stations")
def eligible_stations(spark, sf):
    landed = rows.land_observations(trade_view.station_days(spark, sf))
    return rows.eligible_stations(landed, TRADE.first_year_max)


@query("day_flags")
def day_flags(spark, sf):
    return _flagged(spark, sf).select(
        "ID", "date", "hw_thrsld", "heatwave", "pl_thrsld", "extreme_precip", "hw_pluvial"
    )


@query("long_runs")
def long_runs(spark, sf):
    warm = _numbered(spark, sf).withColumn("warm", F.col("TA") > 25)
    spread = rows.spread_chunks(warm, halo=3)
    held = rows.with_min_run(spread, "warm", 4, "in_run", rows.chunk_window())
    return rows.home_rows(held).select("ID", "date", "in_run")


@query("climate_fact")
def climate_fact(spark, sf):
    fact = climate.climate_fact(_days(spark, sf), trade_view.stations(spark, sf))
    return fact.drop("row_no", "rain_ahead")


@query("forward_max_percentile")
def forward_max_percentile(spark, sf):
    days = _days(spark, sf)
    ranked = severity.with_forward_percentile(
        days, ranks.percent_rank_tables(days, ["RN"])["RN"]
    )
    return ranked.select("ID", "date", "Pmax_7day")


@query("station_percent_ranks")
def station_percent_ranks(spark, sf):
    ranked = severity.station_percent_ranks(_days(spark, sf))
    return ranked.select("ID", "date", "Tmax_percentile", "P_percentile")


@query("pooled_percent_ranks")
def pooled_percent_ranks(spark, sf):
    ranked = severity.pooled_percent_ranks(_days(spark, sf))
    return ranked.select("ID", "date", "Tmax_percentile", "P_percentile")


# Coincidence and frequency


@query("ecr_station_year")
def ecr_station_year(spark, sf):
    return climate.station_year_rates(trade_view.station_days(spark, sf), TRADE)


@query("ecr_rain_after_rain")
def ecr_rain_after_rain(spark, sf):
    wet = _numbered(spark, sf).select(
        "ID",
        "date",
        "year",
        "row_no",
        (F.col("RN") > 0).alias("rain"),
        (F.col("RN") > 40).alias("flood"),
    )
    flagged = coincidence.coincidence_flags(wet, "rain", "flood", max_lag=3)
    return coincidence.coincidence_rate(flagged, "rain", "coincides", ["ID"])


@query("monthly_counts")
def monthly_counts(spark, sf):
    return _located(coincidence.monthly_counts(_flagged(spark, sf)), spark, sf)


@query("seasonal_counts")
def seasonal_counts(spark, sf):
    counts = coincidence.seasonal_counts(coincidence.monthly_counts(_flagged(spark, sf)))
    return counts.withColumn("season_order", season_order(F.col("season")))


@query("base_means")
def base_means(spark, sf):
    means = _located(frequency.base_means(_seasons(spark, sf), TRADE.base), spark, sf)
    return means.withColumn("class", class_breaks(F.col("base_ave"), COUNT_BREAKS, (0, 10)))


@query("target_means")
def target_means(spark, sf):
    means = _located(frequency.target_means(_seasons(spark, sf), TRADE.target), spark, sf)
    return means.withColumn(
        "class", class_breaks(F.col("target_ave"), COUNT_BREAKS, COUNT_LIMITS)
    )


@query("seasonal_means")
def seasonal_means(spark, sf):
    means = frequency.count_means(_seasons(spark, sf), ["ID", "season"])
    return _located(means, spark, sf).withColumn(
        "class", class_breaks(F.col("cdh_ave"), COUNT_BREAKS, COUNT_LIMITS)
    )


@query("annual_means")
def annual_means(spark, sf):
    means = frequency.count_means(_seasons(spark, sf), ["ID"])
    return _located(means, spark, sf).withColumn(
        "class", class_breaks(F.col("cdh_ave"), ANNUAL_BREAKS, ANNUAL_LIMITS)
    )


@query("recent_points")
def recent_points(spark, sf):
    points = frequency.recent_points(_seasons(spark, sf), TRADE.target, TRADE.target_label)
    return points.withColumn("axis_place", alphabetical_season_index(F.col("season")))


@query("regional_totals")
def regional_totals(spark, sf):
    return frequency.regional_totals(_seasons(spark, sf))


@query("regional_totals_from_months")
def regional_totals_from_months(spark, sf):
    months = coincidence.with_season(coincidence.monthly_counts(_flagged(spark, sf)))
    in_base = months.filter(F.col("year_season").between(*TRADE.base))
    return frequency.regional_totals(in_base, "num_coincidence")


@query("period_comparison")
def period_comparison(spark, sf):
    return _comparison(spark, sf)


@query("standardised_anomaly")
def standardised_anomaly(spark, sf):
    found = frequency.standardised_anomaly(_seasons(spark, sf), TRADE.base, TRADE.target)
    return _located(found, spark, sf).na.drop(how="any").withColumn(
        "class", class_breaks(F.col("anomaly"), ANOMALY_BREAKS, ANOMALY_LIMITS)
    )


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.standardised_anomaly(_seasons(spark, sf), TRADE.base, TRADE.target)


@query("exceedance_counts")
def exceedance_counts(spark, sf):
    return frequency.exceedance_counts(_anomalies(spark, sf), limit=2.0)


@query("exceedance_ratio")
def exceedance_ratio(spark, sf):
    return frequency.exceedance_ratio(_anomalies(spark, sf), limit=2.0)


@query("anomaly_limits")
def anomaly_limits(spark, sf):
    return frequency.value_limits(_anomalies(spark, sf), "anomaly")


# Baselines


@query("baseline_stats")
def baseline_stats(spark, sf):
    return anomalies.baseline_stats(_totals(spark, sf), "total_cphw", TRADE.base)


@query("ecdf_rank")
def ecdf_rank(spark, sf):
    return anomalies.ecdf_rank(
        _totals(spark, sf), "total_cphw", TRADE.base, TRADE.record_year
    )


@query("season_anomaly_table")
def season_anomaly_table(spark, sf):
    return anomalies.season_anomaly_table(
        _totals(spark, sf), "total_cphw", TRADE.base, TRADE.record_year
    )


@query("return_periods", digits=6)
def return_periods(spark, sf):
    series = materialise(severity.severity_series_mean(_events(spark, sf)), "series")
    return anomalies.return_periods(series, "mean_intensity", TRADE.base[1])


# Severity


@query("severity_events")
def severity_events(spark, sf):
    return _events(spark, sf)


@query("same_day_events")
def same_day_events(spark, sf):
    return _same_day(spark, sf)


@query("intensity_matrix")
def intensity_matrix(spark, sf):
    return severity.intensity_matrix(_same_day(spark, sf))


@query("matrix_stations")
def matrix_stations(spark, sf):
    events = materialise(_same_day(spark, sf), "same-day")
    matrix = severity.intensity_matrix(events).drop("label")
    return severity.matrix_stations(events, matrix)


@query("matrix_limits")
def matrix_limits(spark, sf):
    matrix = severity.intensity_matrix(_same_day(spark, sf))
    return frequency.value_limits(matrix, "compound_intensity")


@query("severity_profile")
def severity_profile(spark, sf):
    profile = severity.severity_profile(_events(spark, sf), STATION_SEASON)
    return profile.withColumn(
        "class",
        class_breaks(F.col("mean_intensity"), MEAN_SEVERITY_BREAKS, SEVERITY_LIMITS),
    )


@query("severity_profile_narrow")
def severity_profile_narrow(spark, sf):
    profile = severity.severity_profile(_events(spark, sf), STATION_SEASON)
    return profile.select(
        *STATION_SEASON,
        "mean_intensity",
        class_breaks(F.col("mean_intensity"), NARROW_BREAKS, NARROW_LIMITS).alias("class"),
    )


@query("severity_station_median")
def severity_station_median(spark, sf):
    return severity.severity_medians(_events(spark, sf), ["ID", "Long", "Lat"])


def _positive(where: Column) -> Column:
    return (F.col("intensity") > 0) & where


@query("severity_base_by_calendar_year")
def severity_base_by_calendar_year(spark, sf):
    before = F.col("year") <= TRADE.base[1]
    return severity.mean_intensity(
        _events(spark, sf), STATION_SEASON, _positive(before), "base_mean"
    )


@query("severity_base_all_years")
def severity_base_all_years(spark, sf):
    means = severity.mean_intensity(
        _events(spark, sf), STATION_SEASON, F.col("intensity") > 0, "base_mean"
    )
    return means.withColumn(
        "class", class_breaks(F.col("base_mean"), SEVERITY_BREAKS, SEVERITY_LIMITS)
    )


@query("severity_recent")
def severity_recent(spark, sf):
    since = F.col("year_season") > TRADE.base[1]
    found = severity.mean_intensity(_events(spark, sf), STATION_SEASON, since, "recent_mean")
    return found.withColumn(
        "class", class_breaks(F.col("recent_mean"), SEVERITY_BREAKS, SEVERITY_LIMITS)
    )


@query("severity_anomaly_calendar_year")
def severity_anomaly_calendar_year(spark, sf):
    after = F.col("year") > TRADE.base[1]
    found = severity.severity_anomaly(
        _events(spark, sf), STATION_SEASON, _positive(after), _positive(~after)
    )
    return found.withColumn(
        "class", class_breaks(F.col("anomaly"), SHIFT_BREAKS, SHIFT_LIMITS)
    )


@query("severity_anomaly_season_year")
def severity_anomaly_season_year(spark, sf):
    since = F.col("year_season") > TRADE.base[1]
    found = severity.severity_anomaly(
        _events(spark, sf), STATION_SEASON, since, F.col("intensity") > 0
    )
    return found.withColumn(
        "class", class_breaks(F.col("anomaly"), SHIFT_BREAKS, SHIFT_LIMITS)
    )


@query("severity_series_median")
def severity_series_median(spark, sf):
    return severity.severity_series_median(_events(spark, sf))


@query("severity_series_mean")
def severity_series_mean(spark, sf):
    return severity.severity_series_mean(_events(spark, sf))


@query("station_season_medians")
def station_season_medians(spark, sf):
    return severity.station_season_medians(_events(spark, sf))


@query("mean_of_medians")
def mean_of_medians(spark, sf):
    return severity.mean_of_medians(severity.station_season_medians(_events(spark, sf)))


def _frequency_severity(spark: SparkSession, sf: str) -> DataFrame:
    return severity.severity_profile(_events(spark, sf), STATION_SEASON).select(
        *STATION_SEASON, "freq", "sum_intensity", "mean_intensity"
    )


@query("frequency_severity")
def frequency_severity(spark, sf):
    return _frequency_severity(spark, sf)


@query("frequency_severity_map")
def frequency_severity_map(spark, sf):
    days = _days(spark, sf)
    seasons = coincidence.seasonal_counts(coincidence.monthly_counts(days))
    counts = frequency.count_means(seasons, ["ID", "season"])
    medians = severity.station_season_medians(_events_of(days, spark, sf))
    joined = severity.mean_of_medians(medians).join(counts, ["ID", "season"], "left")
    classed = joined.withColumn("class", class_breaks(F.col("cdh_ave"), COUNT_BREAKS, COUNT_LIMITS))
    return _located(classed, spark, sf)


# Trend and inference


@query("count_trend")
def count_trend(spark, sf):
    return trend.linear_trend(
        _trended(_totals(spark, sf)), "total_cphw", "year_season", ["season"]
    )


@query("severity_trend")
def severity_trend(spark, sf):
    series = severity.severity_series_mean(_events(spark, sf))
    return trend.linear_trend(series, "mean_intensity", "year_season", ["season"])


@query("count_trend_line", digits=7)
def count_trend_line(spark, sf):
    return trend.trend_line(
        _trended(_totals(spark, sf)), "total_cphw", "year_season", ["season"]
    )


@query("severity_trend_line", digits=7)
def severity_trend_line(spark, sf):
    series = severity.severity_series_median(_events(spark, sf))
    return trend.trend_line(series, "mean_intensity", "year_season", ["season"])


@query("count_mann_kendall")
def count_mann_kendall(spark, sf):
    return trend.mann_kendall(_totals(spark, sf), "total_cphw", "year_season", ["season"])


def _excess(spark: SparkSession, sf: str) -> DataFrame:
    """Totals above the lowest of the seasons' highest totals: flat for that season."""
    totals = materialise(_totals(spark, sf), "totals")
    peaks = totals.groupBy("season").agg(F.max("total_cphw").alias("peak"))
    limit = peaks.select(F.min("peak")).scalar()
    return totals.withColumn("excess", F.greatest(F.col("total_cphw") - limit, F.lit(0)))


@query("count_excess_trend")
def count_excess_trend(spark, sf):
    return trend.linear_trend(_excess(spark, sf), "excess", "year_season", ["season"])


@query("count_excess_mann_kendall")
def count_excess_mann_kendall(spark, sf):
    return trend.mann_kendall(_excess(spark, sf), "excess", "year_season", ["season"])


@query("severity_mann_kendall_median")
def severity_mann_kendall_median(spark, sf):
    series = materialise(severity.severity_series_median(_events(spark, sf)), "series")
    return trend.mann_kendall(series, "mean_intensity", "year_season", ["season"])


@query("severity_mann_kendall_mean")
def severity_mann_kendall_mean(spark, sf):
    series = materialise(severity.severity_series_mean(_events(spark, sf)), "series")
    return trend.mann_kendall(series, "mean_intensity", "year_season", ["season"])


@query("bootstrap_total_ci")
def bootstrap_total_ci(spark, sf):
    seasons = materialise(_seasons(spark, sf), "seasons")
    return bootstrap.bootstrap_ci(
        seasons, "cdh_count", SERIES, "sum", TRADE.replicates, TRADE.seed
    )


@query("regional_series_ci")
def regional_series_ci(spark, sf):
    seasons = materialise(_seasons(spark, sf), "seasons")
    intervals = bootstrap.bootstrap_ci(
        seasons, "cdh_count", SERIES, "sum", TRADE.replicates, TRADE.seed
    )
    return _trended(bootstrap.with_interval(frequency.regional_totals(seasons), intervals))


@query("severity_series_ci")
def severity_series_ci(spark, sf):
    events = materialise(_events(spark, sf), "events")
    intervals = bootstrap.bootstrap_ci(
        events, "intensity", SERIES, "mean", TRADE.replicates, TRADE.seed, min_n=5
    )
    return bootstrap.with_interval(severity.severity_series_mean(events), intervals)


# Joint distribution


@query("joint_events")
def joint_events(spark, sf):
    return _joint(spark, sf).select("ID", "date", "season", "Period", "comp_int_rel")


@query("representative_events")
def representative_events(spark, sf):
    return _representatives(spark, sf)


@query("event_counts_by_period")
def event_counts_by_period(spark, sf):
    return joint.event_counts(_joint(spark, sf))


@query("representative_limits")
def representative_limits(spark, sf):
    return distribution.quantile_limits(
        _representatives(spark, sf), ["T_anom_rel", "P_excess_rel"]
    )


@query("event_limits")
def event_limits(spark, sf):
    return distribution.quantile_limits(_events(spark, sf), ["T_anom_rel", "P_excess_rel"])


# Distribution statistics


@query("count_histogram")
def count_histogram(spark, sf):
    return distribution.histogram(
        _comparison(spark, sf), "cdh_ave", ["season", "Period"], 30, ["season"]
    )


@query("heat_anomaly_histogram")
def heat_anomaly_histogram(spark, sf):
    return distribution.histogram(
        _representatives(spark, sf), "T_anom_rel", ["season", "Period"], 20
    )


@query("rain_excess_histogram")
def rain_excess_histogram(spark, sf):
    return distribution.histogram(
        _representatives(spark, sf), "P_excess_rel", ["season", "Period"], 20
    )


@query("count_density")
def count_density(spark, sf):
    return distribution.kde_1d(
        _comparison(spark, sf), "cdh_ave", ["season", "Period"], ["season"]
    )


@query("annual_count_density")
def annual_count_density(spark, sf):
    means = frequency.count_means(_seasons(spark, sf), ["ID"])
    means = materialise(means.withColumn("scope", F.lit("all seasons")), "annual")
    return distribution.kde_1d(means, "cdh_ave", ["scope"])


@query("heat_anomaly_density")
def heat_anomaly_density(spark, sf):
    return distribution.kde_1d(
        _representatives(spark, sf), "T_anom_rel", ["season", "Period"]
    )


@query("rain_excess_density")
def rain_excess_density(spark, sf):
    return distribution.kde_1d(
        _representatives(spark, sf), "P_excess_rel", ["season", "Period"]
    )


@query("seasonal_mean_density")
def seasonal_mean_density(spark, sf):
    means = frequency.count_means(_seasons(spark, sf), ["ID", "season"])
    return distribution.kde_1d(materialise(means, "means"), "cdh_ave", ["season"])


@query("representative_density_2d")
def representative_density_2d(spark, sf):
    return distribution.kde_2d(
        _representatives(spark, sf), "T_anom_rel", "P_excess_rel", ["season", "Period"]
    )


@query("event_density_2d")
def event_density_2d(spark, sf):
    return distribution.kde_2d(
        materialise(_joint(spark, sf), "joint"),
        "T_anom_rel",
        "P_excess_rel",
        ["season", "Period"],
    )


@query("severity_density_2d")
def severity_density_2d(spark, sf):
    return distribution.kde_2d(
        materialise(_events(spark, sf), "events"), "T_anom_rel", "intensity", ["season"]
    )


@query("count_box_stats")
def count_box_stats(spark, sf):
    return distribution.box_stats(_comparison(spark, sf), "cdh_ave", ["season", "Period"])


@query("count_box_outliers")
def count_box_outliers(spark, sf):
    return distribution.box_outliers(
        _comparison(spark, sf), "cdh_ave", ["season", "Period"], ["ID"]
    )


@query("frequency_severity_curve", digits=6)
def frequency_severity_curve(spark, sf):
    points = _frequency_severity(spark, sf).withColumn("scope", F.lit("all seasons"))
    return distribution.loess_curve(points, "mean_intensity", "freq", ["scope"])


@query("severity_series_curve", digits=6)
def severity_series_curve(spark, sf):
    series = severity.severity_series_median(_events(spark, sf))
    return distribution.loess_curve(series, "mean_intensity", "year_season", ["season"])
