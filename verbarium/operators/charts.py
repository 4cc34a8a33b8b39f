"""The aggregations behind charts and plots."""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up, to_number, trim
from ..plans.staging import running
from .selection import header_names

TICKS = 5
LABELS = 12
PREVIEW = 200


# -- line and bar chart of one column --------------------------------------------------------------------------------------------


def chart_geometry(df: DataFrame, y: str, height: float = 240.0) -> DataFrame:
    """One row: n_points, skipped, y_min, y_max (both include 0), span, label_every, ticks. A single aggregate."""
    v = to_number(F.col(y).cast("string"))
    one = df.agg(F.count(v).alias("n_points"), F.count_if(v.isNull()).alias("skipped"), F.least(F.min(v), F.lit(0.0)).alias("y_min"), F.greatest(F.max(v), F.lit(0.0)).alias("y_max"))
    one = one.withColumns({"y_min": F.coalesce("y_min", F.lit(0.0)), "y_max": F.coalesce("y_max", F.lit(0.0))})
    one = one.withColumn("span", F.when(F.col("y_max") - F.col("y_min") == 0, 1.0).otherwise(F.col("y_max") - F.col("y_min")))
    one = one.withColumn("label_every", F.greatest(F.lit(1), F.ceil(F.col("n_points") / LABELS)).cast("long"))
    ticks = F.transform(F.sequence(F.lit(0), F.lit(TICKS - 1)), lambda k: F.col("y_min") + F.col("span") * k / (TICKS - 1))
    return one.withColumn("ticks", ticks)


def chart_points(df: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """order, label, value of the rows whose y is a number."""
    v = to_number(F.col(y).cast("string"))
    return df.select(order, F.coalesce(F.col(x).cast("string"), F.lit("")).alias("label"), v.alias("value")).where("value is not null")


def tick_label(v: Column) -> Column:
    """Thousands as `4k` or `1.5k`, else at most two decimals."""
    return F.when(F.abs(v) >= 1000, F.concat(_plain(round_half_up(v / 100) / 10), F.lit("k"))).otherwise(_plain(round_half_up(v, 2)))


def _plain(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")


def default_y(df: DataFrame, order: str, preview: int = 40) -> str | None:
    """The first column with a number among the first rows."""
    head = df.orderBy(order).limit(preview)
    names = [c for c in df.columns if c != order]
    row = head.agg(*[F.count(F.when(trim(F.col(f"`{c}`").cast("string")) != "", to_number(F.col(f"`{c}`").cast("string")))).alias(f"c{k}") for k, c in enumerate(names)]).first()
    return next((c for k, c in enumerate(names) if row[k]), None)


def preview(df: DataFrame, order: str, most: int = PREVIEW) -> DataFrame:
    """The first rows in their order, as text, nulls empty: what is shown beside a chart."""
    return df.orderBy(order).limit(most).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


# -- plots -----------------------------------------------------------------------------------------------------------------------


def plot_rows(df: DataFrame) -> DataFrame:
    """Distinct column names; blank cells are null, others unchanged."""
    named = df.toDF(*header_names(df.columns))
    return named.select(*[F.when(trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`")).alias(c) for c in named.columns])


def bar_count(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    keys = [x] + ([color] if color else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def bar_percent(df: DataFrame, x: str, color: str | None = None, within: bool = True) -> DataFrame:
    """Counts as percentages of their x (with a colour), or of all rows."""
    counts = bar_count(df, x, color)
    whole = F.sum("n").over(Window.partitionBy(x)) if color and within else df.agg(F.count(F.lit(1)).alias("all")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / whole)


def sorted_bars(counts: DataFrame, x: str, order: str | list[str] = "descending") -> DataFrame:
    """By number, or in the order of a list (others last)."""
    if isinstance(order, list):
        place = F.array_position(F.array(*map(F.lit, order)), F.col(x))
        return counts.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), x)
    return counts.orderBy(F.desc("n") if order == "descending" else F.asc("n"), x)


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    return df.select(F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y"), *([F.col(color).alias("color")] if color else []))


def box(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, n, q1, median, q3, and whiskers at the last values within 1.5 times the range between quartiles (linear interpolation).

    Values are ranked by ranges over the cluster, so that a group of any size spans many tasks; of each group the values at six ranks are taken.
    """
    v = F.col(y).cast("double")
    values = df.select(F.col(x).alias("x"), v.alias("v"), F.lit(1).cast("long").alias("one")).where("v is not null")
    ranked = running(values, ["x"], ["v"], "one").select("x", "v", "seq")
    sizes = values.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    both = ranked.join(sizes, ranked["x"].eqNullSafe(sizes["x"])).select(ranked["x"], "v", "seq", "n")
    place = {c: (F.col("n") - 1) * p for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    at = {f"{c}_{side}": F.max(F.when(F.col("seq") == f(h).cast("long"), F.col("v"))) for c, h in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    q = both.groupBy("x", "n").agg(*[a.alias(c) for c, a in at.items()])
    q = q.select("x", "n", *[(F.col(f"{c}_low") + (h - F.floor(h)) * (F.col(f"{c}_high") - F.col(f"{c}_low"))).alias(c) for c, h in place.items()])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    fences = q.select(F.col("x").alias("fx"), low.alias("lower"), high.alias("upper"))
    inside = values.join(fences, F.col("x").eqNullSafe(F.col("fx"))).groupBy("x").agg(F.min(F.when(F.col("v") >= F.col("lower"), F.col("v"))).alias("low"), F.max(F.when(F.col("v") <= F.col("upper"), F.col("v"))).alias("high"))
    return q.join(inside.withColumnRenamed("x", "ex"), F.col("x").eqNullSafe(F.col("ex"))).drop("ex").withColumnRenamed("x", x)


def histogram(df: DataFrame, x: str, step: float) -> DataFrame:
    """bin_start, n of the bins that have values."""
    b = (F.floor(F.col(x).cast("double") / step) * step).alias("bin_start")
    return df.where(F.col(x).isNotNull()).groupBy(b).agg(F.count(F.lit(1)).alias("n"))


#: fixed values: the single time units, each as the part that a Spark expression takes from a timestamp
UNITS = {
    "year": "year(t)", "quarter": "quarter(t)", "month": "month(t)", "date": "day(t)", "week": "int((dayofyear(t) + 6 - (dayofweek(t) - 1)) / 7)", "day": "dayofweek(t) - 1",
    "dayofyear": "dayofyear(t)", "hours": "hour(t)", "minutes": "minute(t)", "seconds": "second(t)", "milliseconds": "int(extract(second from t) * 1000) % 1000",
}


def time_units(unit: str) -> list[str]:
    """The single units of a combined one, such as yearmonthdate; an optional `utc` goes first."""
    rest, out = unit.removeprefix("utc"), []
    names = sorted(UNITS, key=len, reverse=True)
    while rest:
        found = next((n for n in names if rest.startswith(n)), None)
        if not found:
            raise ValueError(f"unknown time unit: {unit}")
        out.append(found)
        rest = rest[len(found) :]
    return out


def time_histogram(df: DataFrame, t: str, unit: str) -> DataFrame:
    """A column for each single unit, and n. Times are read in the session's zone; set it to UTC for `utc` units."""
    named = df.select(F.col(t).cast("timestamp").alias("t")).where("t is not null")
    parts = [F.expr(UNITS[u]).cast("int").alias(u) for u in time_units(unit)]
    return named.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


def invalid_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n_valid, n_invalid; a single aggregate, then unpivoted."""
    v = {c: to_number(F.when(trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))) for c in columns}
    one = df.agg(*[F.count(v[c]).alias(f"v{k}") for k, c in enumerate(columns)], *[F.count_if(v[c].isNull()).alias(f"i{k}") for k, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"v{k}").alias("n_valid"), F.col(f"i{k}").alias("n_invalid")) for k, c in enumerate(columns)])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def map_points(df: DataFrame, lat: str, lon: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """latitude, longitude, weight of the usable rows; and one row: usable, invalid. A missing, zero or unreadable weight is 1."""
    a, b = (F.col(c).cast("string").try_cast("double") for c in (lat, lon))
    w = F.coalesce(F.nullif(F.col(weight).cast("string").try_cast("double"), F.lit(0.0)), F.lit(1.0)) if weight else F.lit(1.0)
    usable = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    rows = df.where(usable).select(a.alias("latitude"), b.alias("longitude"), F.when(F.isnan(w), 1.0).otherwise(w).alias("weight"))
    return rows, df.agg(F.count_if(usable).alias("usable"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("invalid"))


TILE = 256
MOST_LATITUDE = 85.05112878


def mercator(lat: Column, lon: Column, zoom: int, tile_x: float = 0, tile_y: float = 0) -> tuple[Column, Column]:
    """Pixels at a zoom, relative to a tile, two decimals."""
    world = TILE * 2**zoom
    phi = F.radians(F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), lat)))
    x = (lon + 180) / 360 * world - tile_x * TILE
    y = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * world - tile_y * TILE
    return round_half_up(x, 2), round_half_up(y, 2)


def best_zoom(points: DataFrame, target: int = 512, tile: int = TILE, most: int = 20) -> int:
    """The closest zoom at which all points fit a square of `target` pixels. A zoom doubles the world's width of one tile, so it is a matter of what
    part of the world's width and height the points span."""
    r = points.agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east")).first()
    if r.south is None:
        return 0

    def down(latitude: float) -> float:
        phi = math.radians(max(-MOST_LATITUDE, min(MOST_LATITUDE, latitude)))
        return 0.5 - math.asinh(math.tan(phi)) / (2 * math.pi)

    part = max((r.east - r.west) / 360, down(r.south) - down(r.north))
    return most if part <= 0 else max(0, min(most, math.floor(math.log2(target / (tile * part)))))


def heat_cells(points: DataFrame, zoom: int, cell: int = 16) -> DataFrame:
    """Weights binned to cells of pixels, for a heat map."""
    x, y = mercator(F.col("latitude"), F.col("longitude"), zoom)
    return points.groupBy(F.floor(x / cell).alias("cell_x"), F.floor(y / cell).alias("cell_y")).agg(F.sum("weight").alias("weight"))


# -- configuration ---------------------------------------------------------------------------------------------------------------

#: fixed values: the builders of plots, and arguments that histograms no longer take
PLOTS = ("barPlotCount", "barPlotPercent", "scatterPlot", "boxPlot", "histogramPlot", "plotMapHeatmap")
DROPPED = ("maxbins", "minstep", "nice")
WIDTHS = (1, 2, 3)


def default_config(sources: list[str]) -> dict:
    """A configuration without plots: a dataset for each source, named by its file name without extension; names that repeat are numbered."""
    datasets: dict[str, dict] = {}
    for source in sources:
        file = source.rsplit("/", 1)[-1] or "dataset"
        base = (file.rsplit(".", 1)[0] if "." in file else file) or "dataset"
        name = next(n for n in (base if k == 1 else f"{base} {k}" for k in itertools.count(1)) if n not in datasets)
        datasets[name] = {"source": source}
    return {"plots": {"globalConfig": {"actions": False}, "datasets": datasets, "plotList": []}}


def _is_width(x) -> bool:
    try:
        return float(x) in WIDTHS
    except (TypeError, ValueError):
        return False


def check_config(config: dict) -> list[str]:
    """What is wrong with a plots configuration; unknown fields and unknown builders are left alone, as a later release may know them.

    `plots` holds `datasets`, an object of named datasets, and `plotList`, whose plots each name a dataset (`dataset.name`), have a builder with its
    arguments (`makeSpec.plotFunction`, `makeSpec.args`) or a specification of their own (`customSpec`), and are one to three columns wide.
    """
    plots = config.get("plots") if isinstance(config, dict) else None
    if not isinstance(plots, dict):
        return ["plots must be an object"]
    datasets, listed = plots.get("datasets"), plots.get("plotList")
    rules = [(plots.get("globalConfig", {}), dict, "globalConfig must be an object"), (datasets, dict, "datasets must be an object of named datasets"), (listed, list, "plotList must be a list")]
    out = [text for value, kind, text in rules if not isinstance(value, kind)]
    for k, plot in enumerate(listed if isinstance(listed, list) else [], 1):
        if not isinstance(plot, dict):
            out.append(f"plot {k} must be an object")
            continue
        name = plot["dataset"].get("name") if isinstance(plot.get("dataset"), dict) else None
        spec = plot.get("makeSpec")
        builder = spec.get("plotFunction") if isinstance(spec, dict) else None
        width = next((plot[c] for c in ("plotCardSpan", "span") if plot.get(c) is not None), 1)
        own = isinstance(plot.get("customSpec"), dict) and plot["customSpec"]
        broken = {
            "must name a dataset": not (isinstance(name, str) and name),
            f"names a dataset that is missing: {name!r}": isinstance(name, str) and name and isinstance(datasets, dict) and name not in datasets,
            "needs a builder or a specification": not own and not (isinstance(builder, str) and builder.strip()),
            "makeSpec.args must be an object": bool(spec) and not (isinstance(spec, dict) and isinstance(spec.get("args"), dict)),
            "config must be an object": not isinstance(plot.get("config", {}), dict),
            "width must be 1, 2 or 3 columns": not _is_width(width),
        }
        out += [f"plot {k}: {text}" for text, so in broken.items() if so]
    return out


def bind_datasets(config: dict, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Configured datasets found among the tables (by source), and those that are missing: (name, source)."""
    found, missing = {}, []
    for name, said in config["plots"].get("datasets", {}).items():
        source = said if isinstance(said, str) else (said or {}).get("source") or (said or {}).get("path") or ""
        if source in tables:
            found[name] = plot_rows(tables[source])
        else:
            missing.append((name, source))
    return found, missing


def histogram_arguments(args: dict) -> tuple[dict, list[str]]:
    """Arguments that a histogram takes, and a warning about each that it drops. It bins numbers by `step` or times by `xTimeUnit`."""
    if args.get("xType") not in ("quantitative", "temporal"):
        raise ValueError("a histogram needs a quantitative or temporal variable (xType)")
    if args["xType"] == "temporal" and not args.get("xTimeUnit"):
        raise ValueError("a temporal histogram needs an xTimeUnit")
    drop = [k for k in DROPPED if args.get(k) is not None]
    return {k: v for k, v in args.items() if k not in DROPPED}, [f"{k} is ignored" for k in drop]


def color_scale(palette: dict[str, str]) -> dict[str, list[str]]:
    return {"domain": list(palette), "range": list(palette.values())}


def embed_options(base: dict, own: dict) -> dict:
    """Own options over the base, nested dictionaries merged."""
    return {**base, **{k: embed_options(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}}


def config_text(config: dict) -> str:
    return json.dumps(config, ensure_ascii=False, indent=2)
