"""Registered queries: importing the package registers all of them with the catalog."""

from . import analysis, audits, bases, catalog, decoding, diagnosis, files, keyframes, packing, predicates, rendering, sampling, searches, shapes

__all__ = ["analysis", "audits", "bases", "catalog", "decoding", "diagnosis", "files", "keyframes", "packing", "predicates", "rendering", "sampling", "searches", "shapes"]
