"""Stop and edge tables from schedules, and waits from observed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import clock_seconds, plain_id
from ..functions.compat import exact_quantile, first_of, half_even, require_columns, zero_to_null


def consecutive(df: DataFrame, by: list[str], order: list[str], carry: dict[str, str]) -> DataFrame:
    """Each row with the following row's values: carry maps a column to the name of its following value. The last row of a group goes (WIN-1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumns({new: F.lead(c).over(w) for c, new in carry.items()}).withColumn("_more", F.lead(F.lit(1)).over(w))
    return out.filter("_more is not null").drop("_more")


def connections(stop_times: DataFrame) -> DataFrame:
    """trip_id, from_stop_id, to_stop_id, departure, arrival in seconds, for consecutive stops of a trip (WIN-1)."""
    require_columns(stop_times, ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"], "stop_times")
    t = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), clock_seconds(F.col("arrival_time")).alias("arr"), clock_seconds(F.col("departure_time")).alias("dep"))
    hops = consecutive(t, ["trip_id"], ["stop_sequence"], {"stop_id": "to_stop_id", "arr": "arrival"})
    return hops.select("trip_id", F.col("stop_id").alias("from_stop_id"), "to_stop_id", F.col("dep").alias("departure"), "arrival").filter("arrival >= departure")


def active_services(calendar: DataFrame, exceptions: DataFrame, date: str) -> DataFrame:
    """service_id that run on an ISO date: those of the weekly calendar, plus added ones, minus removed ones (SET-5)."""
    d = F.to_date(F.lit(date))
    ymd, day = F.date_format(d, "yyyyMMdd"), F.lower(F.date_format(d, "EEEE"))
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    runs = F.lit(False)
    for name in days:
        runs = F.when(day == name, F.col(name) == "1").otherwise(runs)
    base = calendar.filter(ymd.between(F.col("start_date"), F.col("end_date")) & runs).select("service_id")
    today = exceptions.filter(F.col("date") == ymd)
    return base.union(today.filter("exception_type = '1'").select("service_id")).distinct().subtract(today.filter("exception_type = '2'").select("service_id"))


def trips_of_the_day(trips: DataFrame, calendar: DataFrame | None, exceptions: DataFrame | None, date: str) -> DataFrame:
    """The trips whose service runs on an ISO date; all of them where a feed has no calendar, and an error, when it runs, where it has one and no service runs (SET-5)."""
    if calendar is None and exceptions is None:
        return trips
    spark = trips.sparkSession
    days = "monday, tuesday, wednesday, thursday, friday, saturday, sunday".replace(",", " string,")
    calendar = spark.createDataFrame([], f"service_id string, start_date string, end_date string, {days} string") if calendar is None else calendar
    exceptions = spark.createDataFrame([], "service_id string, date string, exception_type string") if exceptions is None else exceptions
    active = active_services(calendar, exceptions, date)
    n = active.agg(F.count("*").alias("_n"))  # one row
    runs = F.when(F.col("_n") > 0, F.coalesce("_runs", F.lit(False))).otherwise(F.raise_error(F.lit(f"no service runs on {date}")).cast("boolean"))
    return trips.join(active.withColumn("_runs", F.lit(True)), "service_id", "left").join(F.broadcast(n)).filter(runs).select(trips.columns)


def bus_edges(route_stops: DataFrame, speeds: DataFrame, seconds: str) -> DataFrame:
    """Edges between consecutive stops of a route with the median observed seconds, else the network's median (WIN-2, GRF-9).

    route_stops: route_id, route_name, stop_sequence, stop_id; speeds: route_id, from_stop_id, to_stop_id and `seconds`.
    """
    hops = consecutive(route_stops, ["route_id"], ["stop_sequence"], {"stop_id": "to_stop_id", "stop_sequence": "to_sequence"}).withColumnsRenamed({"stop_id": "from_stop_id", "stop_sequence": "from_sequence"})
    return fill_by_median(hops, speeds, ["route_id", "from_stop_id", "to_stop_id"], seconds, "duration_seconds", "duration_source", ("hourly_median", "network_median"))


def fill_by_median(edges: DataFrame, observed: DataFrame, keys: list[str], value: str, out: str, source: str, names: tuple[str, str]) -> DataFrame:
    """edges with the median of the observed non-zero values of the same keys, else of all of them, and which it was (GRF-9)."""
    seen = observed.withColumn("_v", zero_to_null(F.col(value).try_cast("double")))
    own = seen.groupBy(*keys).agg(F.median("_v").alias("_own"))
    whole = exact_quantile(seen, "_v", 0.5, out="_all")
    out_df = edges.join(own, keys, "left").join(F.broadcast(whole), how="left")  # one row at most
    return out_df.withColumn(source, F.when(F.col("_own").isNotNull(), names[0]).otherwise(names[1])).withColumn(out, F.coalesce("_own", "_all")).drop("_own", "_all")


def metro_timetable(raw: DataFrame, names: dict[str, str], day: str = "DAY") -> DataFrame:
    """Stops of each train in clock order, numbered anew (WIN-4). names maps line, station_code, station_name, day, direction, express, train, arrival, departure to columns.

    A missing arrival is the departure and the other way round; rows without either go (PRJ-21). Clock order puts times after midnight first.
    """
    c = {k: F.col(v) for k, v in names.items()}
    trip = F.concat_ws("_", *[F.coalesce(c[k].cast("string"), F.lit("")) for k in ("line", "day", "direction", "express", "train")])
    t = raw.filter(c["day"] == day).select(trip.alias("trip_id"), c["line"].alias("line"), plain_id(c["station_code"]).alias("station_code"), c["station_name"].alias("station_name"), F.coalesce(c["arrival"], c["departure"]).alias("a"), F.coalesce(c["departure"], c["arrival"]).alias("d")).dropna(subset=["a", "d"])
    t = t.select("trip_id", "line", "station_code", "station_name", clock_seconds(F.col("a"), False).alias("arrival"), clock_seconds(F.col("d"), False).alias("departure"))
    return t.withColumn("stop_sequence", F.row_number().over(Window.partitionBy("trip_id").orderBy("departure", "station_code")))


def metro_edges(timetable: DataFrame, stop: Column, longest: int = 1800) -> DataFrame:
    """line, from_stop_id, to_stop_id with the median seconds between consecutive stops, those over 0 and under `longest` (WIN-3, PRJ-17)."""
    t = timetable.select("trip_id", "line", "stop_sequence", stop.alias("from_stop_id"), "arrival", "departure")
    hops = consecutive(t, ["trip_id"], ["stop_sequence"], {"from_stop_id": "to_stop_id", "arrival": "next_arrival"}).withColumn("s", F.col("next_arrival") - F.col("departure"))
    return hops.filter((F.col("s") > 0) & (F.col("s") < longest)).groupBy("line", "from_stop_id", "to_stop_id").agg(F.median("s").alias("duration_seconds"))


def two_stage_match(wanted: DataFrame, known: DataFrame, key: str, name: str, x: str, y: str, span: float = 0.01, labels: tuple[str, str] = ("station_code_line", "unambiguous_station_name")) -> DataFrame:
    """wanted (key, name) with x and y of the same key, else the mean of the same name where that name's places lie within `span` on both axes (JOIN-9)."""
    exact = first_of(known.filter(F.col(x).isNotNull()).select(key, x, y), [key], [F.col(x), F.col(y)])
    wide = lambda c: F.max(c) - F.min(c) < span
    by_name = known.groupBy(name).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"), wide(x).alias("_sx"), wide(y).alias("_sy")).filter("_sx and _sy").drop("_sx", "_sy")
    out = wanted.join(exact, key, "left").join(by_name, name, "left")
    return out.withColumn("matched_by", F.when(F.col(x).isNotNull(), labels[0]).when(F.col("_x").isNotNull(), labels[1])).withColumn(x, F.coalesce(x, "_x")).withColumn(y, F.coalesce(y, "_y")).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).drop("_x", "_y")


def network_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, nodes of edge tables: distinct ends of from_stop_id and to_stop_id (SNK-8)."""
    out = None
    for name, df in tables.items():
        ends = df.select(F.explode(F.array("from_stop_id", "to_stop_id")).alias("n")).agg(F.count_distinct("n").alias("nodes"))
        one = df.agg(F.count("*").alias("rows")).crossJoin(ends).select(F.lit(name).alias("table"), "rows", "nodes")
        out = one if out is None else out.unionByName(one)
    return out


def clipped_wait(seconds: Column, low: int = 60, high: int = 900) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), half_even(seconds))).cast("int")


def frequency_waits(runs: DataFrame, route: str, n: str) -> DataFrame:
    """Half the mean headway of the median hourly runs, within 60 and 900 seconds (CAL-1)."""
    r = runs.filter(F.col(n).try_cast("double") > 0).groupBy(route).agg(F.median(F.col(n).try_cast("double")).alias("runs_per_hour"))
    return r.withColumn("wait_seconds", clipped_wait(F.lit(1800.0) / F.col("runs_per_hour")))


def headway_waits(departures: DataFrame, route: str, within: list[str], seconds: str, longest: int = 1800) -> DataFrame:
    """Half the median gap between departures of the same `within`, gaps over 0 and up to `longest` (CAL-2, WIN-5)."""
    gap = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(route, *within).orderBy(seconds))
    g = departures.withColumn("_gap", gap).filter((F.col("_gap") > 0) & (F.col("_gap") <= longest))
    return g.groupBy(route).agg(F.median("_gap").alias("headway_seconds")).withColumn("wait_seconds", clipped_wait(F.col("headway_seconds") / 2))
