"""The tool registry: named table functions with declared arguments, as an assistant calls them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.plans import tools
from fathomline.plans.registry import query
from fathomline.plans.survey import tiered
from fathomline.plans.telemetry import hav_sql
from fathomline.plans.views import FIX_SQL, SCORED_SQL, fixes


@dataclass(frozen=True)
class Tool:
    """A table function: its arguments with their types and defaults (None: required), and what it returns for them."""

    arguments: dict[str, tuple[type, Any]]
    run: Callable[..., DataFrame]


def find_detections(spark: SparkSession, d: str, kind: str, least: float, limit: int) -> DataFrame:
    rows = tiered(spark, d).filter((F.col("class") == kind) & (F.col("severity") >= least))
    return rows.orderBy(F.desc("severity"), F.desc("confidence"), "id").limit(min(max(limit, 1), 50)).select("id", "severity")


def near(spark: SparkSession, d: str, lat: float, lon: float, radius: float) -> DataFrame:
    at = geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return fixes(spark, d).withColumn("distance_m", at).filter(F.col("distance_m") <= radius).select("id", "distance_m")


TOOLS = {
    "list_surveys": Tool({}, tools.x01),
    "survey_summary": Tool({"survey": (int, None)}, lambda spark, d, survey: tools.x02(spark, d).filter(F.col("survey") == survey)),
    "find_detections": Tool({"kind": (str, None), "least": (float, 0.0), "limit": (int, 10)}, find_detections),
    "filtered_detections": Tool({"survey": (int, None)}, lambda spark, d, survey: tiered(spark, d).filter(F.col("suppressed") & (F.col("strip") % 8 == survey)).select("id", "class")),
    "prior_targets": Tool({"survey": (int, None)}, lambda spark, d, survey: tools.x08(spark, d).filter(F.col("survey") == survey)),
    "near": Tool({"lat": (float, None), "lon": (float, None), "radius": (float, 1000.0)}, near),
    "authorities": Tool({"lang": (str, None)}, lambda spark, d, lang: tools.x34(spark, d).filter(F.col("lang") == lang)),
}


def run_tool(spark: SparkSession, d: str, name: str, arguments: dict[str, Any]) -> DataFrame:
    """Calls a tool. Arguments are brought to their types, unknown ones are dropped, missing ones take their default; a required one that is missing or unfit is an error."""
    if name not in TOOLS:
        raise ValueError(f"there is no tool {name}; there are {', '.join(sorted(TOOLS))}")
    given = {}
    for key, (kind, default) in TOOLS[name].arguments.items():
        value = arguments.get(key, default)
        if value is None:
            raise ValueError(f"{name} needs {key}")
        try:
            given[key] = kind(value)
        except (TypeError, ValueError):
            raise ValueError(f"{key} of {name} is no {kind.__name__}: {value!r}") from None
    return TOOLS[name].run(spark, d, **given)


CALLS = (("list_surveys", {}), ("find_detections", {"kind": "error", "least": "0.2", "limit": 80, "colour": "red"}), ("filtered_detections", {"survey": "3"}), ("near", {"lat": "10.5", "lon": 79.5, "radius": 9000}))


@query("d18_tool_calls", f"""WITH {SCORED_SQL}, {FIX_SQL} SELECT 'list_surveys' AS tool, count(DISTINCT strip % 8) AS n FROM tiered UNION ALL SELECT 'find_detections', least(count(*), 50) FROM tiered WHERE class = 'error' AND severity >= 0.2
  UNION ALL SELECT 'filtered_detections', count(*) FROM tiered WHERE suppressed AND strip % 8 = 3 UNION ALL SELECT 'near', count(*) FROM fix WHERE {hav_sql('10.5', '79.5', 'lat', 'lon')} <= 9000""")
def d18(spark, d):
    counts = [run_tool(spark, d, name, arguments).agg(F.count("*").alias("n")).select(F.lit(name).alias("tool"), "n") for name, arguments in CALLS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
