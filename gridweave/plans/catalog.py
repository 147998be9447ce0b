"""Importing this module registers every query."""

from gridweave.plans import assembly, audits, corpus, files, images, knowledge, mapping, reviews, tilesets, variation  # noqa: F401
