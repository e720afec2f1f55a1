"""Access decisions: route, required role, outcome."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.text import col_of

# Role levels, and the levels of an unknown user and an unknown required role.
ROLE_LEVELS = {"viewer": 1, "analyst": 2, "admin": 3}
UNKNOWN_USER_LEVEL = 0
UNKNOWN_REQUIRED_LEVEL = 999
DEFAULT_ROLE = "viewer"


class Route(NamedTuple):
    prefix: str
    required_role: str | None
    exact: bool = False


# The gateway's routes; no role means public.
GATEWAY_ROUTES = (
    Route("/health", None, exact=True),
    Route("/brain/health", None, exact=True),
    Route("/auth/", None),
    Route("/", "viewer"),
    Route("/kibana/", "analyst"),
    Route("/admin/", "admin"),
)

# Route tables longer than this are joined instead of being written into the expression.
MAX_LITERAL_ROUTES = 500


def _level(role: Column, unknown: int) -> Column:
    pairs = [F.lit(x) for pair in ROLE_LEVELS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(role, F.lit(""))], F.lit(unknown))


def role_sufficient(user_role: Column | str, required_role: Column | str) -> Column:
    return _level(col_of(user_role), UNKNOWN_USER_LEVEL) >= _level(
        col_of(required_role), UNKNOWN_REQUIRED_LEVEL
    )


def match_route(path: Column | str, routes: Sequence[Route] = GATEWAY_ROUTES) -> Column:
    """struct(prefix, exact, required_role) of the best route: exact first, then longest prefix."""
    if len(routes) > MAX_LITERAL_ROUTES:
        raise ValueError("join a long route table with match_route_table")
    value = col_of(path)
    best = None
    for route in sorted(routes, key=lambda r: (not r.exact, -len(r.prefix), r.prefix)):
        hit = value == route.prefix if route.exact else value.startswith(route.prefix)
        found = F.struct(
            F.lit(route.prefix).alias("prefix"),
            F.lit(route.exact).alias("exact"),
            F.lit(route.required_role).cast("string").alias("required_role"),
        )
        best = F.when(hit, found) if best is None else best.when(hit, found)
    return best


def match_route_table(requests: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """``match_route`` for a route table ``(prefix, exact, required_role)`` of any size.

    Every distinct path is matched once, by equality: as a whole with exact routes, and cut to each length that a prefix
    of the table has with the others. So a path gives as many rows as there are lengths, however long it is, and there is no
    theta join. A prefix shared by all paths is skew on the large side only, which Spark splits. Adds the column ``route``.
    """
    sizes = routes.where(~F.col("exact")).agg(F.collect_set(F.length("prefix"))).first()[0]
    lengths = F.array(*(F.lit(n) for n in sorted(sizes))).cast("array<int>")
    paths = requests.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct()
    cuts = F.transform(
        F.filter(lengths, lambda n: n <= F.length("_path")),
        lambda n: F.struct(F.substring(F.col("_path"), F.lit(1), n).alias("prefix"), F.lit(False).alias("exact")),
    )
    whole = F.array(F.struct(F.col("_path").alias("prefix"), F.lit(True).alias("exact")))
    rank = F.struct(F.col("exact").cast("int"), F.length("prefix"))
    best = (
        paths.select("_path", F.inline(F.concat(cuts, whole)))
        .join(routes, ["prefix", "exact"])
        .groupBy("_path")
        .agg(F.max_by(F.struct("prefix", "exact", "required_role"), rank).alias("route"))
    )
    return requests.join(best, F.col(path) == F.col("_path"), "left").drop("_path")


def access_audit(requests: DataFrame, routes: Sequence[Route] | DataFrame = GATEWAY_ROUTES) -> DataFrame:
    """Adds ``route``, ``required_role`` and ``status`` to requests ``(path, role, token_ok)``.

    Public routes always pass. Otherwise: no valid token is 401, too low a role is 403. A path
    without any route is 404.
    """
    if isinstance(routes, DataFrame):
        matched = match_route_table(requests, routes)
    else:
        matched = requests.withColumn("route", match_route("path", routes))
    required = F.col("route.required_role")
    status = (
        F.when(F.col("route").isNull(), 404)
        .when(required.isNull(), 200)
        .when(~F.coalesce("token_ok", F.lit(False)), 401)
        .when(~role_sufficient("role", required), 403)
        .otherwise(200)
    )
    return (
        matched.withColumn("status", status)
        .withColumn("required_role", required)
        .withColumn("route", F.col("route.prefix"))
    )


def with_roles(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the ``role`` of ``username``; a user who is not listed has none."""
    roles = users.groupBy("username").agg(F.min("role").alias("role"))
    return requests.join(roles, "username", "left")
