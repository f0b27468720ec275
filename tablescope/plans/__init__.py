"""Composed analyses: the inspect -> clean -> analyse sequence of the reference."""

from .analysis import Findings, analyse_table, clean_table, inspect_table, run

__all__ = ["Findings", "analyse_table", "clean_table", "inspect_table", "run"]
