"""Draft short descriptions for encyclopedia articles, as Spark jobs.

``plans.stage`` turns a target list plus page tables into a reviewable staging
table; ``plans.edit`` turns the reviewed table into page rewrites.
"""

from rankdraft.config import JobConfig

__all__ = ["JobConfig"]
