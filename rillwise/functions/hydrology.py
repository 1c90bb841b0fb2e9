"""Risk, rainfall and drain formulas as column expressions. Missing input stays null."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

# Fixed values.
MANNING_N, SLOPE, DIAMETER_MM = 0.013, 0.001, (100, 3000)
REAL_BANDS = ((0.70, "HIGH"), (0.45, "ELEVATED"), (0.25, "MODERATE"))
SYNTH_BANDS = ((0.80, "CRITICAL"), (0.60, "HIGH"), (0.35, "MODERATE"))
ALERT_BANDS = ((1.5, "RED"), (1.0, "ORANGE"), (0.75, "YELLOW"))
NOWCAST = ((20.0, "LOW", 15), (50.0, "MODERATE", 40), (80.0, "HIGH", 70))
COLOURS, OTHER_COLOUR = {"CRITICAL": "#d62828", "HIGH": "#f97316", "MODERATE": "#eab308", "LOW": "#22c55e"}, "#94a3b8"
RAIN_REFERENCE_MM = 90.0
STRIP_M, VELOCITY_MS, INLET_MIN, RUNOFF, RUNOFF_MIN = 40.0, 0.9, 10.0, (0.65, 0.90), 180.0


def at_most(x: Column, limit: float) -> Column:
    """Null stays null: least() alone would take the limit for it."""
    return F.when(x.isNotNull(), F.least(x, F.lit(limit)))


def at_least(x: Column, limit: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(limit)))


def manning_capacity(diameter_mm: Column, slope: float = SLOPE, n: float = MANNING_N) -> Column:
    """Full-bore flow in m3/s; null for a diameter that is no number or beyond 100 to 3000 mm."""
    if n <= 0 or slope <= 0:
        raise ValueError("n and slope must be positive")
    d = diameter_mm.cast("string").try_cast("double")
    m = d / 1000
    flow = (1 / n) * (pi * m * m / 4) * F.pow(m / 4, 2 / 3) * slope**0.5
    return F.when(~F.isnan(d) & d.between(*DIAMETER_MM), flow)


def capacity_fields(diameter_mm: Column, conduit_type: Column, null_is_pipe: bool = True) -> Column:
    """capacity (4 decimals), method and note; only pipes have one."""
    kind = F.coalesce(conduit_type, F.lit("pipe")) if null_is_pipe else conduit_type
    flow = F.when(kind == "pipe", F.round(manning_capacity(diameter_mm), 4))
    note = F.when(F.coalesce(kind, F.lit("")) != "pipe", "not a circular pipe").when(flow.isNull(), "no valid diameter").otherwise("assumed slope and roughness")
    return F.struct(flow.alias("capacity"), F.when(flow.isNotNull(), "manning_full_bore").alias("method"), note.alias("note"))


def rainfall_multiplier(mm: Column) -> Column:
    """0.3 when dry to 1 at the reference; 1 where rain is unknown, not a number or negative."""
    rain = mm.cast("string").try_cast("double")
    return F.when(rain >= 0, F.when(F.isnan(rain), 1.0).otherwise(0.3 + 0.7 * F.least(rain / RAIN_REFERENCE_MM, F.lit(1.0)))).otherwise(1.0)


def banded(value: Column, bands, lowest: str, missing: str | None = None) -> Column:
    out = F.when(value.isNull(), F.lit(missing))
    for least, name in bands:
        out = out.when(value >= least, name)
    return out.otherwise(lowest)


def risk_level(p: Column) -> Column:
    return banded(p, REAL_BANDS, "LOW")


def risk_level_synth(p: Column) -> Column:
    return banded(p, SYNTH_BANDS, "LOW")


def risk_color(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])[level], F.lit(OTHER_COLOUR))


def nowcast(rain: Column) -> Column:
    """level and score (percent) by rain thresholds."""
    level, score = F.when(rain.isNull(), None), F.when(rain.isNull(), None)
    for below, name, value in NOWCAST:
        level, score = level.when(rain < below, name), score.when(rain < below, value)
    return F.struct(level.otherwise("CRITICAL").alias("level"), score.otherwise(90).cast("int").alias("score"))


def adjusted_probability(susceptibility: Column, mm: Column, hours: Column) -> Column:
    """Susceptibility (rounded to 4 decimals) under rain and over hours, at most 1."""
    return F.round(at_most(F.round(susceptibility, 4) * rainfall_multiplier(mm) * (1 + 0.1 * hours / 60), 1.0), 4)


def drain_alert(load: Column) -> Column:
    return banded(load, ALERT_BANDS, "GREEN", "UNKNOWN")


def drain_hazard(load: Column, distance_m: Column) -> Column:
    return F.coalesce(0.9 * at_least(at_most((load - 0.75) / 1.25, 1.0), 0.0) * at_least(1 - distance_m / 300, 0.0), F.lit(0.0))


def scenario_risk(susceptibility: Column, mm: Column, hazard: Column, depth_cm: Column) -> Column:
    """Union of rain-driven risk and drain hazard; without rain, standing depth sets the multiplier."""
    dry = 0.3 * at_most(depth_cm / 10, 1.0)
    m = F.when(mm == 0, dry).otherwise(rainfall_multiplier(mm))
    return 1 - (1 - at_most(susceptibility * m, 1.0)) * (1 - hazard)


def runoff_coefficient(minutes: Column) -> Column:
    return RUNOFF[0] + (RUNOFF[1] - RUNOFF[0]) * at_most(minutes / RUNOFF_MIN, 1.0)


def pipe_load(intensity_mm_h: Column, minutes: Column, area_m2: Column, path_m: Column, capacity: Column) -> Column:
    """tc_min, fraction, inflow (m3/s), load (inflow by capacity) and overflow (m3 over the storm) of a pipe under a storm."""
    tc = INLET_MIN + path_m / VELOCITY_MS / 60
    fraction = at_most(minutes / tc, 1.0)
    inflow = runoff_coefficient(minutes) * intensity_mm_h / 1000 / 3600 * area_m2 * fraction
    return F.struct(
        tc.alias("tc_min"), fraction.alias("fraction"), inflow.alias("inflow"),
        F.when(capacity > 0, inflow / capacity).alias("load"),
        F.when(capacity > 0, at_least(inflow - capacity, 0.0) * minutes * 60).alias("overflow"),
    )


def depth_probability(depth_cm: Column) -> Column:
    return F.round(1 / (1 + F.exp(-(depth_cm - 10) / 5)), 3)


def coverage_class(p: Column, covered: Column) -> Column:
    return F.when(p.isNull(), "no_data").when(F.coalesce(covered, F.lit(False)), "full").otherwise("terrain_only")


def source_state(present: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "ERROR").when(F.coalesce(present, F.lit(False)), "LOADED").otherwise("MISSING")


def live_state(configured: Column, last_success: Column, last_error: Column) -> Column:
    return F.when(~F.coalesce(configured, F.lit(False)), "NOT_CONFIGURED").when(last_success.isNotNull(), "LIVE").when(last_error.isNotNull(), "ERROR").otherwise("UNKNOWN")


def condition(rain: Column, humidity: Column) -> Column:
    return F.when(rain > 10, "heavy_rain").when(rain > 0, "rain").when(humidity > 80, "humid").otherwise("clear")


def has_any(*features: Column) -> Column:
    """Whether any feature is known."""
    return F.coalesce(*[f.cast("double") for f in features]).isNotNull()


# The depth model's cell and its limits.
CELL_AREA_M2 = 250000.0


def water_depth_cm(rain_mm_h: Column, minutes: Column, imperviousness: Column, drain_capacity: Column, distance_to_drain: Column, elevation: Column, slope: Column, floods: Column) -> Column:
    """Depth over a grid cell without the random part: runoff less drainage, shaped by terrain, and a bias by past floods; 1 decimal, at least 0."""
    hours = minutes / 60.0
    rain = rain_mm_h / (1 + 0.3 * (hours - 1)) * hours
    runoff = rain * (0.30 + imperviousness / 100 * 0.65) / 1000 * CELL_AREA_M2
    efficiency = at_least(1 - rain_mm_h / 200, 0.2)
    removed = drain_capacity * hours * efficiency * at_least(1 - distance_to_drain / 100, 0.3)
    shape = at_least(2 - elevation / 10, 0.5) * at_least(1 - slope / 5, 0.3)
    depth = at_least(runoff - removed, 0.0) / CELL_AREA_M2 * shape * 100 + floods * 0.5
    return at_least(F.round(depth, 1), 0.0)
