"""Groups kept up with changed edges: only groups that a change touches are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrado.operators.graph import FEW, connected_components
from terrado.sources.tables import materialize

#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000


def _few(ids: DataFrame) -> DataFrame:
    """Written once, as it is read more than once; marked for a broadcast if there are few, counted up to the bound only."""
    ids = materialize(ids)
    return F.broadcast(ids) if ids.limit(BROADCAST + 1).count() <= BROADCAST else ids


def touched_members(members: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, listings) that changed edges (publicacion_id, candidata_id) reach: the groups of their ends, and all of these groups' members with the ends."""
    ends = _few(changed.select("publicacion_id").union(changed.select("candidata_id")).distinct())
    groups = _few(members.join(ends, "publicacion_id", "left_semi").select("inmueble_id").distinct())
    inside = members.join(groups, "inmueble_id", "left_semi").select("publicacion_id")
    return groups, _few(inside.union(ends).distinct())


def touched_edges(edges: DataFrame, listings: DataFrame) -> DataFrame:
    """The confirmed edges that the touched groups are made of. An edge that was there joins two members of one group, a new one two ends, so one end tells."""
    return edges.where("estado = 'confirmada'").join(listings, "publicacion_id", "left_semi")


def maintain_groups(members: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """publicacion_id, inmueble_id after edges have changed: as a rebuild of all groups gives, from the touched ones alone.

    members: the groups before (each named by its smallest member); edges: all edges
    as they are now (publicacion_id, candidata_id, estado); changed: the pairs that
    are new, gone or in another state. A group that a discarded edge held together
    falls apart; listings that no confirmed edge joins leave.
    """
    groups, listings = touched_members(members, changed)
    anew = connected_components(touched_edges(edges, listings), few=FEW).toDF("publicacion_id", "inmueble_id")
    rest = members.select("publicacion_id", "inmueble_id").join(groups, "inmueble_id", "left_anti")
    return rest.select("publicacion_id", "inmueble_id").unionByName(anew)
