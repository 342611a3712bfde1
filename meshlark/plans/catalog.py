"""Every query of the engine by name, with the SQL that it must agree with."""

from __future__ import annotations

from meshlark.plans import cycles, dynamics, fields, files, meshes, scoring  # noqa: F401  (they register themselves)
from meshlark.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "sensor_interval_obs"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
