"""Explicit triangle meshes as cell and facet tables, and functions on their vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_of(triangles: DataFrame) -> DataFrame:
    """(a, b, n_triangles, is_boundary): the different edges of triangles (tid, a, b, c); one triangle makes a boundary edge."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))]))
    return triangles.select(sides.alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("n_triangles")).withColumn("is_boundary", F.col("n_triangles") == 1)


def facets_of(triangles: DataFrame) -> DataFrame:
    """(tid, a, b): each triangle with its edges."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))]))
    return triangles.select("tid", sides.alias("e")).select("tid", "e.a", "e.b")


def boundary_vertices(triangles: DataFrame) -> DataFrame:
    """(id) of the vertices on a boundary edge."""
    border = edges_of(triangles).where("is_boundary")
    return border.select(F.col("a").alias("id")).union(border.select("b")).distinct()


def triangle_centroids(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tid, x, y, z) from vertices (id, x, y, z)."""
    corners = triangles.select("tid", F.explode(F.array("a", "b", "c")).alias("id")).join(vertices, "id")
    return corners.groupBy("tid").agg(*[F.avg(n).alias(n) for n in ("x", "y", "z")])


def euler(triangles: DataFrame) -> DataFrame:
    """One row: vertices in use, edges, triangles and their alternating sum."""
    used = triangles.select(F.explode(F.array("a", "b", "c")).alias("id")).agg(F.countDistinct("id").alias("v"))
    return used.join(F.broadcast(edges_of(triangles).agg(F.count("*").alias("e")))).join(F.broadcast(triangles.agg(F.count("*").alias("f")))).withColumn("euler", F.expr("v - e + f"))  # one row each


def along_axis(axis: str, scale: float = 1.0) -> Column:
    return F.col(axis) * scale


def rotated(angle: float, scale: float = 1.0) -> Column:
    """The x coordinate after a turn by ``angle`` radians about z."""
    return (F.col("x") * F.cos(F.lit(angle)) + F.col("y") * F.sin(F.lit(angle))) * scale


def steepest(triangles: DataFrame, values: DataFrame, up: bool = True) -> DataFrame:
    """(id, next): each vertex's highest (or lowest) neighbour over an edge, or itself at an extremum. ``values``: id, value."""
    e = edges_of(triangles)
    both = e.select(F.col("a").alias("id"), F.col("b").alias("nid")).union(e.select("b", "a"))
    order = F.struct(F.col("nvalue").alias("v"), F.col("nid").alias("i"))
    near = both.join(values.select(F.col("id").alias("nid"), F.col("value").alias("nvalue")), "nid").groupBy("id").agg((F.max(order) if up else F.min(order)).alias("best"))
    own = F.struct(F.col("value").alias("v"), F.col("id").alias("i"))
    beyond = F.col("best") > own if up else F.col("best") < own
    return values.join(near, "id", "left").select("id", F.when(beyond, F.col("best.i")).otherwise(F.col("id")).alias("next"))
