"""Dependency-treebank pattern mining on Spark."""

from .api import mine, run, run_each
from .plans.spec import MineSpec, from_settings, parse_args, read_ini
from .sources.conllu import read_conllu

__all__ = ["MineSpec", "from_settings", "mine", "parse_args", "read_conllu", "read_ini", "run", "run_each"]
