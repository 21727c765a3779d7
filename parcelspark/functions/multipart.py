"""Polygons of several parts: ``parts: array<rings>``, each part an exterior with its holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import RINGS_TYPE, from_coordinates, perimeter, polygon_area, to_coordinates

PARTS_TYPE = f"array<{RINGS_TYPE}>"
_POLYGON = "type string, coordinates array<array<array<double>>>"
_MULTI = "type string, coordinates array<array<array<array<double>>>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_part(rings: Column | str) -> Column:
    return F.array(_col(rings))


def parts_area(parts: Column | str) -> Column:
    """Area of all parts; parts of a valid geometry share none."""
    return F.aggregate(_col(parts), F.lit(0.0), lambda n, r: n + polygon_area(r))


def parts_perimeter(parts: Column | str) -> Column:
    return F.aggregate(_col(parts), F.lit(0.0), lambda n, r: n + perimeter(r))


def parts_from_geojson(geometry: Column | str) -> Column:
    """Parts of a GeoJSON geometry text: Polygon or MultiPolygon; null for other types and broken coordinates."""
    text = _col(geometry)
    kind = F.get_json_object(text, "$.type")
    single, multi = F.from_json(text, _POLYGON)["coordinates"], F.from_json(text, _MULTI)["coordinates"]
    return F.when(kind == "Polygon", F.when(single.isNotNull(), F.array(from_coordinates(single)))).when(
        kind == "MultiPolygon", F.transform(multi, from_coordinates))


def geojson_of_parts(parts: Column | str) -> Column:
    """GeoJSON text: a Polygon for one part, else a MultiPolygon."""
    parts = _col(parts)
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(parts, to_coordinates).alias("coordinates")))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), to_coordinates(F.get(parts, F.lit(0))).alias("coordinates")))
    return F.when(F.size(parts) == 1, single).otherwise(multi)


def exploded_parts(layer: DataFrame, keys: list[str], parts: str = "parts") -> DataFrame:
    """``keys, part, rings``: one row per part, numbered from 0."""
    return layer.select(*keys, F.posexplode(parts).alias("part", "rings"))


def gathered_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, parts``: parts back in their order. The parts of one feature came from one row."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "rings"))).alias("_p"))
    return listed.select(*keys, F.transform("_p", lambda p: p["rings"]).alias("parts"))
