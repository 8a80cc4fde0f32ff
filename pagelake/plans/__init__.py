"""Every query of the engine by name."""

from pagelake.plans import catalog, export, files, history, images, ordering, pages, runs, streams, text, values
from pagelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "export", "files", "history", "images", "ordering", "pages", "runs", "streams", "text", "values"]
