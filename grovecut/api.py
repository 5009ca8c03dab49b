"""Running a spec from treebank files to a result: a DataFrame, rows or a TSV."""

from __future__ import annotations

import logging
import os
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .operators import mine as M
from .plans.spec import MineSpec
from .sources import paths, sinks
from .sources.conllu import read_conllu
from .streaming import resume

log = logging.getLogger("grovecut")


def load(spark: SparkSession, path: str, spec: MineSpec) -> DataFrame:
    """The sentences of a file or folder, by way of the cache if the spec names one and the path is a file."""
    if spec.internal_saves and not paths.is_folder(spark, path):
        return resume.cached(spark, path, f"{spec.internal_saves}/sentences")
    return read_conllu(spark, path)


def mine(spark: SparkSession, spec: MineSpec) -> DataFrame:
    """The ranked result of a spec, with raw numbers. With continuation_processing a folder's files that were counted before aren't counted again."""
    sentences = load(spark, spec.input, spec)
    other = load(spark, spec.compare, spec) if spec.compare else None
    if not (spec.continuation_processing and spec.internal_saves and paths.is_folder(spark, spec.input)):
        return M.mine(sentences, spec, other)
    counted, size = resume.resumed_counts(spark, spec.input, spec, f"{spec.internal_saves}/counts")
    second = ()
    if other is not None:
        again, _, tokens = M.surveyed(other, spec, ())
        second = (again, tokens)
    return M.ranked(spec, counted, M.unigrams(sentences, spec), size, *second)


def run(spark: SparkSession, spec: MineSpec) -> list[list[str]] | None:
    """Writes the side files and the TSV that the spec names; without an output the rows are returned, header first. Steps and their times are logged."""
    if not spec.input or not paths.exists(spark, spec.input):
        raise FileNotFoundError(spec.input)
    began = time.time()

    def step(what: str) -> None:
        log.info("%s after %.1f s", what, time.time() - began)

    sentences = load(spark, spec.input, spec)
    if spec.sentence_count_file:
        sinks.write_sentence_counts(sentences, spec, spec.sentence_count_file)
        step("sentence counts written")
    if spec.detailed_results_file:
        sinks.write_detailed(sentences, spec, spec.detailed_results_file)
        step("detailed results written")
    if spec.annodoc_example_dir and (spec.detailed_results_file or spec.example):
        sinks.write_examples(sentences, spec, spec.annodoc_example_dir)
        step("examples written")
    if spec.annodoc_detailed_dir and spec.detailed_results_file:
        sinks.write_places(sentences, spec, spec.annodoc_detailed_dir)
        step("places written")
    result = mine(spark, spec)
    step("mined")
    if spec.output:
        sinks.write_tsv(result, spec, spec.output, bool(spec.compare))
        step("result written")
        return None
    out = list(sinks.lines(result, spec, bool(spec.compare)))
    step("result collected")
    return out


def run_each(spark: SparkSession, spec: MineSpec, folder: str) -> list[str]:
    """One TSV for each file below the input, in the same place below folder; files that are there are left. Returns what was written."""
    done = []
    root = os.path.commonpath([f.rsplit("/", 1)[0] for f in resume.files_of(spark, spec.input)]) if paths.is_folder(spark, spec.input) else None
    for file in resume.files_of(spark, spec.input):
        name = os.path.splitext(os.path.relpath(file, root))[0] if root else os.path.splitext(os.path.basename(file))[0]
        target = os.path.join(folder, name + ".tsv")
        if not os.path.exists(target):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            run(spark, replace(spec, input=file, output=target + ".part"))
            os.replace(target + ".part", target)
            done.append(target)
    return done
