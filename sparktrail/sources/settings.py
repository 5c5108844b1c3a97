"""Configured servers from settings files: at the top, for each project, and in a folder's own file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SETTINGS = "mcpServers map<string, string>, projects map<string, string>"
_PROJECT = "mcpServers map<string, string>"


def server_names(files: DataFrame) -> DataFrame:
    """(host_id, path, server) from settings (host_id, path, body), each name once a file.

    Names stand under mcpServers, of the whole file and of each of its projects, whatever the servers' own settings hold,
    which is never read. Malformed files and parts name nothing.
    """
    j = files.withColumn("j", F.from_json("body", _SETTINGS)).select("host_id", "path", "j.*")
    projects = F.coalesce(F.map_values("projects"), F.array())
    inner = F.flatten(F.transform(projects, lambda p: F.coalesce(F.map_keys(F.from_json(p, _PROJECT)["mcpServers"]), F.array().cast("array<string>"))))
    names = F.concat(F.coalesce(F.map_keys("mcpServers"), F.array().cast("array<string>")), inner)
    return j.select("host_id", "path", F.explode(F.array_distinct(names)).alias("server"))


def configured_servers(files: DataFrame, folder: str | None = None) -> DataFrame:
    """(host_id, servers): a host's server names as a sorted JSON list, hosts without any left out.

    Files called .mcp.json belong to their folder: they count only for `folder`, the others always.
    """
    own = F.regexp_extract("path", r"^(.*)/\.mcp\.json$", 1)
    local = F.col("path").rlike(r"(^|/)\.mcp\.json$")
    meant = files.filter(~local | (own == folder.rstrip("/"))) if folder else files.filter(~local)
    return server_names(meant).groupBy("host_id").agg(F.to_json(F.array_sort(F.collect_set("server"))).alias("servers"))
