"""Public-transport accessibility analytics as Spark DataFrame operations."""

from reachgrid.params import ScoreParams, check_code, check_slot, load_params
from reachgrid.session import build_session
from reachgrid.workspace import Workspace

__all__ = [
    "ScoreParams",
    "Workspace",
    "build_session",
    "check_code",
    "check_slot",
    "load_params",
]
