"""Written tables that cut lineage, in the folder all executors share."""

from viewloom.sources.shared import keep, shared_dir

__all__ = ["keep", "shared_dir"]
