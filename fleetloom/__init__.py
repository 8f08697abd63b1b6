"""Set-based analytics over a fleet of managed interactive workspaces, on Spark DataFrames."""

from fleetloom.session import prepare_session

__all__ = ["prepare_session"]
