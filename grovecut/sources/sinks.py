"""Results as files: the ranked TSV, Grew patterns and links, side files. Text formatting is here, numbers elsewhere are raw."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import os
import urllib.parse
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.trees import label
from ..operators.mine import detailed, grew_tests, occurrences, sentence_counts
from ..plans.spec import MineSpec
from .corpora import corpus_name

GREW_URL = "http://universal.grew.fr/?corpus="
ASSOCIATION = (("MI", "mi"), ("MI3", "mi3"), ("Dice", "dice"), ("logDice", "log_dice"), ("t-score", "t_score"), ("simple-LL", "simple_ll"))
KEYNESS = (("Ratio", "ratio"), ("LL", "ll"), ("BIC", "bic"), ("Log ratio", "log_ratio"), ("OR", "odds_ratio"), ("%DIFF", "diff"))


def bare(key: str) -> str:
    """A key without the brackets around the whole."""
    return key[1:-1] if key.startswith("(") and key.endswith(")") else key


def two(x: float | None) -> str:
    return "NaN" if x is None or math.isnan(x) else f"{x:.2f}"


def grew(row, spec: MineSpec) -> str:
    """The pattern in Grew's language for a counted tree: nodes head first, links, order of each link if fixed, and no more dependents if complete.

    Nodes are called by their place in the key.
    """
    locs, before = list(row["exemplar"]["locs"]), list(row["grew_nodes"])
    if set(locs) != set(before):  # the exemplar is another match than the first; both have the same shape
        swap = dict(zip(sorted(locs), sorted(before)))
        locs = [swap[p] for p in locs]
    name = {p: label(k) for k, p in enumerate(locs)}
    words = dict(zip(locs, row["words"]))
    nodes, links, order = [], [], []
    for p in before:
        nodes.append(f"{name[p]} [{grew_tests(words[p], spec.node_types)}]")
    for edge, rel in zip(row["grew_links"], row["grew_rels"]):
        a, b = before[edge["a"]], before[edge["b"]]
        links.append(f"{name[a]} -[{rel}]-> {name[b]}" if spec.labeled else f"{name[a]} -> {name[b]}")
        order.append(f"{name[a]} {'<<' if a < b else '>>'} {name[b]}")
    text = "pattern {" + "; ".join([*nodes, *links, *(order if spec.fixed else ())]) + "}"
    if spec.complete:
        text += " " + " ".join(f"without {{{name[p]} -> X{k}}}" for k, p in enumerate(before))
    return text


def grew_url(corpus: str, pattern: str) -> str:
    return GREW_URL + corpus + "&request=" + urllib.parse.quote(pattern)


def header(spec: MineSpec, width: int, compare: bool, corpus: str | None = None) -> list[str]:
    out = ["Tree"]
    if spec.node_info:
        out += [f"Node {label(k)}-{t}" for k in range(width) for t in (spec.node_types or ("generic",))]
    out += ["Absolute frequency", "Relative frequency"]
    out += ["Order"] * spec.fixed + ["Grew-match query"] * spec.grew_match + ["Grew-match URL"] * (spec.grew_match and corpus is not None) + ["Depsearch tree query"] * (spec.fixed and spec.depsearch)
    out += ["Number of nodes"] * spec.nodes_number + ["Head node"] * spec.head_info + ["Example"] * spec.example
    out += ["Annodoc"] * annodocs(spec)
    out += [t for t, _ in ASSOCIATION] * spec.association_measures
    if compare:
        out += ["Absolute frequency in second treebank", "Relative frequency in second treebank", *(t for t, _ in KEYNESS)]
    return out


def result_width(result: DataFrame, spec: MineSpec) -> int:
    """Node columns of a result."""
    if spec.query or not spec.greedy_counter:
        return spec.width
    return min(spec.width, result.agg(F.max("n")).head()[0] or 0)


def cells(r: dict, spec: MineSpec, width: int, compare: bool, corpus: str | None) -> list[str]:
    """A row of the result file."""
    row = [bare(r["key_raw"])]
    if spec.node_info:
        words = [w for node in r["words"] for w in node]
        row += (words + [""] * (width * max(1, len(spec.node_types))))[: width * max(1, len(spec.node_types))]
    row += [str(r["number"]), f"{r['relative_frequency']:.1f}"]
    row += [r["order_letters"]] * spec.fixed
    pattern = grew(r, spec) if spec.grew_match else ""
    row += [pattern] * spec.grew_match
    row += [grew_url(corpus, pattern)] if spec.grew_match and corpus else []
    row += [r["key_sorted"]] if spec.fixed and spec.depsearch else []
    row += [str(r["n"])] * spec.nodes_number + [r["head_name"]] * spec.head_info
    row += [r["example"]] if spec.example else []
    row += [annodoc(r)] if annodocs(spec) else []
    row += [two(r[c]) for _, c in ASSOCIATION] if spec.association_measures else []
    if compare:
        row += [f"{r['number_2']:.0f}", f"{r['relative_frequency_2']:.1f}", *(two(r[c]) for _, c in KEYNESS)]
    return row


def corpus_of(spec: MineSpec) -> str | None:
    return corpus_name(spec.input, mapping=spec.codes_mapper) if spec.input else None


def formatted(result: DataFrame, spec: MineSpec, compare: bool = False, width: int | None = None) -> DataFrame:
    """(cells): the rows of the result file, in the order of result."""
    width = result_width(result, spec) if width is None else width
    corpus = corpus_of(spec)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([cells(r, spec, width, compare, corpus) for r in batch.to_pylist()], pa.list_(pa.string()))], ["cells"])

    return result.mapInArrow(run, "cells array<string>")


def lines(result: DataFrame, spec: MineSpec, compare: bool = False) -> Iterator[list[str]]:
    """The header and the rows of a mined result as texts, in its order."""
    result = result.persist()
    try:
        width = result_width(result, spec)
        yield header(spec, width, compare, corpus_of(spec))
        for r in formatted(result, spec, compare, width).toLocalIterator():
            yield list(r["cells"])
    finally:
        result.unpersist()


def tsv(rows: Iterable[list[str]]) -> str:
    """Rows as TSV text with CRLF line ends and minimal quoting."""
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="\r\n").writerows(rows)
    return out.getvalue()


def write_tsv(result: DataFrame, spec: MineSpec, path: str, compare: bool = False) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, delimiter="\t", lineterminator="\r\n")
        writer.writerows(lines(result, spec, compare))


def write_sentence_counts(sentences: DataFrame, spec: MineSpec, path: str) -> None:
    """Sentences by keys, keys in rank order. For wide results keep sentence_counts() instead."""
    counted = sentence_counts(sentences, spec).persist()
    keys = [r["key"] for r in counted.groupBy("key").agg(F.sum("number").alias("n")).orderBy(F.desc("n"), "key").collect()]
    wide = sentences.select("sent_key", "sent_id").join(counted.groupBy("sent_key").agg(F.map_from_entries(F.collect_list(F.struct("key", "number"))).alias("m")), "sent_key", "left").orderBy("sent_key")
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, delimiter="\t", lineterminator="\n")
        writer.writerow(["Sentence_id", *keys])
        for r in wide.toLocalIterator():
            m = r["m"] or {}
            writer.writerow([r["sent_id"], *(m.get(k, 0) for k in keys)])
    counted.unpersist()


def write_detailed(sentences: DataFrame, spec: MineSpec, path: str) -> None:
    """Key, sentence id and marked sentence of each match, in corpus order."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, delimiter="\t", lineterminator="\n")
        for r in detailed(sentences, spec).orderBy("sent_key", "ord").toLocalIterator():
            writer.writerow([r["key"], r["sent_id"], r["sentence"]])


def write_examples(sentences: DataFrame, spec: MineSpec, folder: str) -> None:
    """A CoNLL-U file for each sentence with a match, named by its id. The folder must be new."""
    os.makedirs(folder)
    found = sentences.join(occurrences(sentences, spec).select("sent_key").distinct(), "sent_key", "left_semi")
    for r in found.select("sent_key", "sent_id", "conllu").orderBy("sent_key").toLocalIterator():
        target = os.path.join(folder, f"{r['sent_id'] if r['sent_id'] is not None else r['sent_key']}.conllu".replace("/", "_"))
        if not os.path.exists(target):
            with open(target, "w", encoding="utf-8") as f:
                f.write(r["conllu"].strip("\n") + "\n\n")


def write_places(sentences: DataFrame, spec: MineSpec, folder: str) -> None:
    """For each key a file named by its hash, with the ids of sentences and the places of the nodes in them. The folder must be new."""
    os.makedirs(folder)
    found = occurrences(sentences, spec).join(sentences.select("sent_key", "sent_id"), "sent_key").orderBy("key", "sent_key", "ord")
    out, key = None, None
    try:
        for r in found.select("key", "sent_id", "locs").toLocalIterator():
            if r["key"] != key:
                if out:
                    out.close()
                key = r["key"]
                out = open(os.path.join(folder, hashlib.sha1(key.encode()).hexdigest()), "w", encoding="utf-8")
            out.write(f"{r['sent_id']}\t{json.dumps(sorted(p + 1 for p in r['locs']))}\n")
    finally:
        if out:
            out.close()


def annodocs(spec: MineSpec) -> bool:
    return bool(spec.annodoc_example_dir and (spec.detailed_results_file or spec.example))


def annodoc(row) -> str:
    """The JSON that names a key's example."""
    return json.dumps({"id": row["example_id"] if row["example_id"] is not None else row["exemplar"]["sent_key"], "positions": sorted(p + 1 for p in row["exemplar"]["locs"]), "subtree_hash": hashlib.sha1(row["key"].encode()).hexdigest()})
