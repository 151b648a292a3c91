"""Sensors, indices and yearly metrics by name, compiled to one aggregation over the observations.

A metric names its index and gives the partial aggregates it needs and a closing
expression over them. The compiled job computes every needed index once per row from the
bands that the row's sensor provides, runs all partial aggregates of all metrics in one
``groupBy``, and closes the metrics in one projection: one scan and one shuffle, however
many metrics are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, reasons

KEY = ["stand_id", "year"]


@dataclass(frozen=True)
class Sensor:
    """Years in service and the columns that hold its bands."""

    name: str
    bands: Mapping[str, str]
    first: int
    last: int | None = None


@dataclass(frozen=True)
class Index:
    """Band algebra with its valid range; values outside count as missing."""

    name: str
    bands: tuple[str, ...]
    build: Callable[..., Column]
    valid: tuple[float, float] = (-1.0, 1.0)


@dataclass(frozen=True)
class Partial:
    """Partial aggregates by name and the closing expressions: value and reason, over a lookup of the aggregates."""

    aggregates: Mapping[str, Column]
    value: Callable[[Mapping[str, Column]], Column]
    reason: Callable[[Mapping[str, Column]], Column]


@dataclass
class Catalogue:
    """Registered sensors, indices and yearly metrics. A second registration of a name is refused."""

    defaults: Mapping[str, object] = field(default_factory=dict)
    sensors: dict[str, Sensor] = field(default_factory=dict)
    indices: dict[str, Index] = field(default_factory=dict)
    metrics: dict[str, tuple[Callable[..., Partial], str, dict]] = field(default_factory=dict)

    def _new(self, table: dict, name: str) -> None:
        if name in table:
            raise ValueError(f"{name!r} is registered twice")

    def sensor(self, name: str, bands: Mapping[str, str], first: int, last: int | None = None) -> Sensor:
        self._new(self.sensors, name)
        self.sensors[name] = Sensor(name, dict(bands), first, last)
        return self.sensors[name]

    def index(self, name: str, bands: Sequence[str], valid: tuple[float, float] = (-1.0, 1.0)):
        def add(build):
            self._new(self.indices, name)
            self.indices[name] = Index(name, tuple(bands), build, valid)
            return build

        return add

    def metric(self, name: str, index: str, **params):
        def add(build):
            self._new(self.metrics, name)
            self.metrics[name] = (build, index, params)
            return build

        return add

    def _known(self, table: dict, kind: str, name: str):
        if name not in table:
            raise KeyError(f"Unknown {kind} {name!r}. Known: {sorted(table)}")
        return table[name]

    def index_column(self, name: str) -> Column:
        """The index of a row from the bands of its ``sensor``; null for sensors that are not registered or not in service.

        A registered sensor that lacks a band of the index is refused when the expression is built.
        """
        index = self._known(self.indices, "index", name)
        out = None
        for sensor in self.sensors.values():
            missing = [b for b in index.bands if b not in sensor.bands]
            if missing:
                raise ValueError(f"Sensor {sensor.name!r} has no bands {missing} for index {name!r}")
            value = index.build(*[finite(sensor.bands[b]) for b in index.bands])
            serving = (F.col("sensor") == sensor.name) & (F.col("year") >= sensor.first)
            if sensor.last is not None:
                serving = serving & (F.col("year") <= sensor.last)
            out = F.when(serving, value) if out is None else out.when(serving, value)
        if out is None:
            raise ValueError("No sensor is registered")
        value = finite(out)
        return F.when(value.between(*index.valid), value)

    def compute(self, observations: DataFrame, names: Sequence[str] | None = None, *, keys: Sequence[str] = KEY, **override) -> DataFrame:
        """Named metrics (all by default) per stand and year: ``<name>`` and ``<name>_reason``."""
        wanted = list(names or sorted(self.metrics))
        if len(set(wanted)) < len(wanted):
            raise ValueError("a metric is asked for twice")
        parts = {}
        for name in wanted:
            build, index, params = self._known(self.metrics, "metric", name)
            merged = {**self.defaults, **params, **override}
            used = merged.pop("index", index)
            parts[name] = (used, merged, build)
        used = sorted({u for u, _m, _b in parts.values()})
        rows = observations.withColumn("year", F.col("year").cast("int")).withColumns({f"_index_{u}": self.index_column(u) for u in used})
        partials = {name: build(F.col(f"_index_{u}"), F.col("doy").cast("int"), **merged) for name, (u, merged, build) in parts.items()}
        aggregates = [c.alias(f"_{name}_{a}") for name, p in partials.items() for a, c in p.aggregates.items()]
        agg = rows.groupBy(*keys).agg(*aggregates)
        out = []
        for name, p in partials.items():
            have = {a: F.col(f"_{name}_{a}") for a in p.aggregates}
            why = p.reason(have)
            out += [F.when(why.isNull(), p.value(have)).alias(name), why.alias(f"{name}_reason")]
        return agg.select(*keys, *out)


def few(n: Column, least: int, where: str = "") -> Column:
    return F.when(n < least, F.concat(F.lit("n_obs="), n.cast("string"), F.lit(f"{where} < min_obs={least}")))


def standard_catalogue() -> Catalogue:
    """Sensors of the parameter table with columns red, nir and swir, three indices and the usual metrics."""
    c = Catalogue({"doy_min": P.SEASON["doy_min"], "doy_max": P.SEASON["doy_max"], "min_obs": P.SEASON["min_obs"]})
    for name, first, last, *_ in P.SENSORS:
        c.sensor(name, {"red": "red", "nir": "nir", "swir1": "swir1", "swir2": "swir2"}, first, last)
    ratio = lambda a, b: F.try_divide(a - b, a + b)
    c.index("ndvi", ("nir", "red"))(ratio)
    c.index("nbr", ("nir", "swir2"))(ratio)
    c.index("ndmi", ("nir", "swir1"))(ratio)

    def season(value, doy, doy_min, doy_max):
        return F.when(doy.between(doy_min, doy_max), value)

    def in_season(close):
        def build(value, doy, *, doy_min, doy_max, min_obs):
            v = season(value, doy, doy_min, doy_max)
            aggregates = {"n": F.count(v), "v": close(v)}
            return Partial(aggregates, lambda a: a["v"], lambda a: few(a["n"], min_obs, f" in DOY {doy_min}-{doy_max}"))

        return build

    c.metric("ndvi_season_mean", "ndvi")(in_season(F.avg))
    c.metric("nbr_season_min", "nbr")(in_season(F.min))
    c.metric("ndmi_season_mean", "ndmi")(in_season(F.avg))

    @c.metric("ndvi_season_contrast", "ndvi", min_obs=2)
    def contrast(value, doy, *, doy_min, doy_max, min_obs):
        """Mean in the season minus mean outside it."""
        inside, outside = F.when(doy.between(doy_min, doy_max), value), F.when(~doy.between(doy_min, doy_max), value)
        aggregates = {"ni": F.count(inside), "no": F.count(outside), "i": F.avg(inside), "o": F.avg(outside)}
        return Partial(aggregates, lambda a: a["i"] - a["o"], lambda a: reasons(
            (a["ni"] < min_obs, few(a["ni"], min_obs, " in season")), (a["no"] < min_obs, few(a["no"], min_obs, " out of season"))
        ))

    @c.metric("ndvi_spread", "ndvi")
    def spread(value, doy, *, doy_min, doy_max, min_obs):
        """Standard deviation over the whole year."""
        return Partial({"n": F.count(value), "s": F.stddev_pop(value)}, lambda a: a["s"], lambda a: few(a["n"], min_obs))

    return c
