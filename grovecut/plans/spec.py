"""What to mine: one record of all settings, from keyword arguments, an INI file or a command line."""

from __future__ import annotations

import argparse
import configparser
from dataclasses import dataclass, fields

from .query import FEATURES, QueryNode, Test, parse

NODE_TYPES = ("form", "lemma", "upos", "xpos", "deprel", "feats", "misc")
#: The bound on complete trees if none is given.
UNBOUNDED = 10_000_000


@dataclass
class MineSpec:
    """All settings. Sizes are (least, most); (0, 0) is not given."""

    input: str | None = None
    output: str | None = None
    size: tuple[int, int] = (0, 0)
    processing_size: tuple[int, int] | None = None
    node_type: str | None = "upos"
    labeled: bool = True
    label_subtypes: bool = False
    fixed: bool = True
    complete: bool = True
    greedy_counter: bool = True
    head: str | None = None
    ignored_labels: tuple[str, ...] = ()
    allowed_labels: tuple[str, ...] = ()
    query: str | None = None
    association_measures: bool = False
    compare: str | None = None
    example: bool = False
    grew_match: bool = False
    depsearch: bool = False
    node_info: bool = True
    head_info: bool = True
    nodes_number: bool = True
    frequency_threshold: float = 0
    max_lines: int = 0
    internal_saves: str | None = None
    continuation_processing: bool = False
    cpu_cores: int = 1
    sentence_count_file: str | None = None
    detailed_results_file: str | None = None
    annodoc_example_dir: str | None = None
    annodoc_detailed_dir: str | None = None
    codes_mapper: str | None = None

    def __post_init__(self) -> None:
        if self.query:
            self.size, self.processing_size = (0, 0), None
        elif self.size == (0, 0):
            raise ValueError("processing_size needs size" if self.processing_size else "give a size or a query")
        elif self.processing_size is None and not self.complete:
            raise ValueError("trees that aren't complete need a processing_size")
        for t in self.node_types:
            if t not in NODE_TYPES:
                raise ValueError(f"unknown node_type: {t}")
        self.query_tree, self.head_any_of

    @property
    def node_types(self) -> tuple[str, ...]:
        return tuple(self.node_type.split("+")) if self.node_type else ()

    @property
    def query_tree(self) -> QueryNode | None:
        return parse(self.query) if self.query else None

    @property
    def bounds(self) -> tuple[int, int]:
        """Sizes that are enumerated."""
        if self.query:
            n = self.query_tree.size()
            return n, n
        return self.processing_size or (1, UNBOUNDED)

    @property
    def head_any_of(self) -> tuple[tuple[Test, ...], ...]:
        return _head(self.head) if self.head else ()

    @property
    def width(self) -> int:
        """Node columns, if the query or the size tells: else 0."""
        if self.query:
            return int(len(self.query.split(" ")) / 2 + 1)
        return self.size[1]


def _head(text: str) -> tuple[tuple[Test, ...], ...]:
    names = {"form": "form", "lemma": "lemma", "L": "lemma", "upos": "upos", "xpos": "xpos", "deprel": "deprel", "misc": "misc", "feats": "feats_raw"}
    out = []
    for alternative in text.split("|"):
        tests = []
        for part in alternative.split("&"):
            part = part.strip()
            negated = part.startswith("!")
            name, _, value = part[negated:].partition("=")
            name, value = (name, value) if "=" in part else ("form", name)
            if name.startswith("!"):
                raise ValueError(f"unknown head restriction: {part}")
            tests.append(Test(names.get(name, f"feats.{name}"), value, negated))
        out.append(tuple(tests))
    return tuple(out)


def _range(text: str | None) -> tuple[int, int]:
    if not text or text == "0":
        return 0, 0
    a, _, b = str(text).partition("-")
    return int(a), int(b or a)


_SIZES = {"size", "processing_size"}
_LISTS = {"ignored_labels", "allowed_labels"}


def from_settings(settings: dict[str, str | None]) -> MineSpec:
    """A spec from texts, as INI files and command lines give them. Only yes is true; empty values are not given."""
    out: dict = {}
    kinds = {f.name: f.type for f in fields(MineSpec)}
    for name, value in settings.items():
        if name not in kinds or value in (None, ""):
            continue
        if name in _SIZES:
            out[name] = _range(value)
        elif name in _LISTS:
            out[name] = tuple(x.strip() for x in value.split("|") if x.strip())
        elif kinds[name] == "bool":
            out[name] = value == "yes"
        elif name in ("max_lines", "cpu_cores"):
            out[name] = int(float(value))
        elif name == "frequency_threshold":
            out[name] = float(value)
        else:
            out[name] = value
    if out.get("processing_size") == (0, 0):
        out.pop("processing_size")
    out.setdefault("node_type", None if "node_type" in settings else "upos")
    return MineSpec(**out)


def read_ini(path: str, overrides: dict[str, str | None] | None = None) -> MineSpec:
    """The [settings] of an INI file; given overrides that aren't empty win."""
    parser = configparser.ConfigParser(interpolation=None)
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    merged: dict[str, str | None] = dict(parser["settings"])
    merged.update({k: v for k, v in (overrides or {}).items() if v and v != "0"})
    return from_settings(merged)


def parse_args(args: list[str] | None = None) -> MineSpec:
    """A spec from a command line: --config_file and one option a setting."""
    parser = argparse.ArgumentParser("grovecut", description="Counts dependency trees in treebanks.")
    parser.add_argument("--config_file")
    for f in fields(MineSpec):
        parser.add_argument(f"--{f.name}")
    given = vars(parser.parse_args(args))
    config = given.pop("config_file")
    return read_ini(config, given) if config else from_settings({k: v for k, v in given.items() if v})


__all__ = ["FEATURES", "MineSpec", "from_settings", "parse_args", "read_ini"]
