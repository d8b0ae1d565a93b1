"""Declarative operators over event logs: each returns a lazy DataFrame that Catalyst plans.

Results don't depend on the order in which events arrived, except where arrival is the question. Logs are shuffled
by entity once; filters on entities and instants reach the scan.
"""

from tidefold.operators.asof import at, at_many, dedup, timeline
from tidefold.operators.changes import capacity, reconciliations, snapshot_reconciliations
from tidefold.operators.lanes import Lanes
from tidefold.operators.marks import checkpoints, override_at, prune_at, retained, at_from_checkpoints
from tidefold.operators.routing import admit, fan_out, memory_usage, partition_counts

__all__ = [
    "Lanes", "admit", "at", "at_from_checkpoints", "at_many", "capacity", "checkpoints", "dedup", "fan_out", "memory_usage", "override_at",
    "partition_counts", "prune_at", "reconciliations", "retained", "snapshot_reconciliations", "timeline",
]
