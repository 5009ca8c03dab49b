import csv
import os

import pytest
from pyspark.sql import functions as F

from grovecut import MineSpec, mine, read_conllu, read_ini, run, run_each
from grovecut.functions import stats
from grovecut.operators import mine as M
from grovecut.sources import sinks
from grovecut.sources.corpora import corpus_name
from grovecut.streaming import resume

ONE = """# sent_id = t1
1-2\toldtown\t_\t_\t_\t_\t_\t_\t_\t_
1\told\told\tADJ\tJJ\tDegree=Pos\t2\tamod\t_\t_
2\ttown\ttown\tNOUN\tNN\tCase=Nom|Number=Sing\t3\tnsubj:pass\t_\t_
3\tsleeps\tsleep\tVERB\tVBZ\tTense=Pres\t0\troot\t_\t_
4\tsoundly\tsoundly\tADV\tRB\t_\t3\tadvmod\t_\tSpaceAfter=No
5\t.\t.\tPUNCT\t.\t_\t3\tpunct\t_\t_

"""
TWO = """# sent_id = t2
1\tcats\tcat\tNOUN\tNN\tCase=Nom,Acc\t2\tnsubj\t_\tb=1|A=2
2\tsleep\tsleep\tVERB\tVB\t_\t0\troot\t_\t_
3\tlost\tlost\tADJ\tJJ\t_\t_\tdep\t_\t_
4\ttail\ttail\tNOUN\tNN\t_\t2\tobj\t_\t_

"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "b.conllu").write_text(TWO)
    (tmp_path / "in" / "deep" / "a.conllu").write_text(ONE + ONE.replace("t1", "t3"))
    return tmp_path


def test_reader(spark, folder):
    s = read_conllu(spark, str(folder / "in")).orderBy("sent_key").collect()
    assert [r["sent_id"] for r in s] == ["t2", "t1", "t3"]
    assert [t["form"] for t in s[1]["toks"]] == ["old", "town", "sleeps", "soundly", "."]
    assert s[0]["toks"][0]["feats"] == {"Case": "Acc"} and s[0]["toks"][0]["misc"] == "A=2|b=1" and s[0]["toks"][2]["head"] is None
    assert [t["space_after"] for t in s[1]["toks"]] == [True, True, True, False, True]


@pytest.mark.parametrize("change", [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n\n", "\n \t\n\n"), lambda t: t.replace("\n\n", "\n  \n").replace("\n", "\r\n"), lambda t: "\ufeff\n\n" + t])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_line_ends_and_blank_lines(spark, folder, change, scheme):
    whole = ONE + TWO + ONE.replace("t1", "t3")
    (folder / "x.conllu").write_bytes(change(whole).encode())
    (folder / "plain.conllu").write_bytes(whole.encode())
    spec = MineSpec(size=(1, 5), node_type="form+misc")
    counts_ = lambda f: {r["key"]: r["number"] for r in M.counts(read_conllu(spark, f"{scheme}{folder}/{f}"), spec).collect()}
    assert [r["sent_id"] for r in read_conllu(spark, f"{scheme}{folder}/x.conllu").orderBy("sent_key").collect()] == ["t1", "t2", "t3"]
    assert counts_("x.conllu") == counts_("plain.conllu")
    assert run(spark, MineSpec(input=f"{scheme}{folder}/x.conllu", size=(2, 2)))[1][:2] == ["ADJ <amod NOUN", "ADJ"]


def test_keys_are_in_corpus_order_whatever_the_splits(spark, tmp_path):
    sentences = [f"# sent_id = {k}\n1\tw{k}\t_\tX\t_\t_\t0\troot\t_\t_" for k in range(400)]
    (tmp_path / "a.conllu").write_text("\n\n".join(sentences[:250]) + "\n")
    (tmp_path / "b.conllu").write_text("\r\n\r\n".join(x.replace("\n", "\r\n") for x in sentences[250:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_conllu(spark, str(tmp_path)).orderBy("sent_key").select("sent_id", "sent_key").collect()
            assert [r["sent_id"] for r in rows] == [str(k) for k in range(400)] and len({r["sent_key"] for r in rows}) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rendered_trees_and_missing_heads(spark, folder):
    s = read_conllu(spark, str(folder / "in"))
    got = {r["key"]: (r["number"], r["n"]) for r in M.counts(s, MineSpec(size=(1, 9), ignored_labels=("punct",))).collect()}
    assert got["((ADJ <amod NOUN) <nsubj VERB >advmod ADV)ABCD"] == (2, 4)
    assert got["(ADJ <amod NOUN)AB"] == (2, 2) and got["(NOUN <nsubj VERB)AB"] == (1, 2)
    assert not any("obj" in k for k in got)  # from a token without a head on, nothing is attached
    assert s.agg(M.corpus_size(s)).head()[0] == 14
    kept = {r["key"] for r in M.counts(s, MineSpec(size=(2, 9), label_subtypes=True)).collect()}
    assert "((ADJ <amod NOUN) <nsubj:pass VERB >advmod ADV >punct PUNCT)ABCDE" in kept


def test_size_counts_before_and_after_ignoring(spark, folder):
    s = read_conllu(spark, str(folder / "in"))
    got = {r["key"] for r in M.counts(s, MineSpec(size=(2, 4), ignored_labels=("punct",))).collect()}
    assert not any("VERB" in k and "ADV" in k for k in got)  # five nodes before punct goes


def test_example_and_tsv(spark, folder):
    spec = MineSpec(input=str(folder / "in"), output=str(folder / "out.tsv"), size=(2, 2), example=True, grew_match=True, depsearch=True, association_measures=True)
    assert run(spark, spec) is None
    text = (folder / "out.tsv").read_bytes().decode()
    assert text.count("\r\n") == text.count("\n") == 3
    table = list(csv.reader(text.splitlines(), delimiter="\t"))
    assert table[0] == "Tree|Node A-upos|Node B-upos|Absolute frequency|Relative frequency|Order|Grew-match query|Depsearch tree query|Number of nodes|Head node|Example|MI|MI3|Dice|logDice|t-score|simple-LL".split("|")
    assert table[1][:6] == ["ADJ <amod NOUN", "ADJ", "NOUN", "2", "142857.1", "AB"]
    assert table[1][6] == "pattern {B [upos=NOUN]; A [upos=ADJ]; B -[amod]-> A; B >> A} without {B -> X0} without {A -> X1}"
    assert table[1][7:11] == ["NOUN >amod ADJ", "2", "NOUN", "A[old] B[town] sleeps soundly. "]


def test_compare_and_side_files(spark, folder):
    spec = MineSpec(input=str(folder / "in" / "deep" / "a.conllu"), compare=str(folder / "in" / "b.conllu"), size=(1, 2), internal_saves=str(folder / "kept"), sentence_count_file=str(folder / "s.tsv"), detailed_results_file=str(folder / "d.tsv"), annodoc_example_dir=str(folder / "e"), annodoc_detailed_dir=str(folder / "f"))
    rows = run(spark, spec)
    assert rows[0][-8:] == ["Absolute frequency in second treebank", "Relative frequency in second treebank", "Ratio", "LL", "BIC", "Log ratio", "OR", "%DIFF"]
    by = {r[0]: r for r in rows[1:]}
    assert by["ADJ <amod NOUN"][-8] == "0" and by["ADJ <amod NOUN"][-6] == "NaN"
    assert (folder / "s.tsv").read_text().splitlines()[1].startswith("t1\t") and len((folder / "d.tsv").read_text().splitlines()) == 2 * 4
    assert sorted(os.listdir(folder / "e")) == ["t1.conllu", "t3.conllu"]
    assert (folder / "s.tsv").read_text().splitlines()[0].startswith("Sentence_id\t") and len((folder / "s.tsv").read_text().splitlines()) == 3
    places = {f.name: f.read_text() for f in (folder / "f").iterdir()}
    import hashlib

    assert places[hashlib.sha1(b"(ADJ <amod NOUN)AB").hexdigest()] == "t1\t[1, 2]\nt3\t[1, 2]\n"
    assert '"id": "t1", "positions": [1, 2]' in rows[1 + [r[0] for r in rows[1:]].index("ADJ <amod NOUN")][rows[0].index("Annodoc")]
    with pytest.raises(FileExistsError):
        run(spark, spec)


def test_resume_and_batch(spark, folder):
    spec = MineSpec(input=str(folder / "in"), size=(1, 4), internal_saves=str(folder / "kept"), continuation_processing=True)
    whole = {r["key"]: r["number"] for r in mine(spark, MineSpec(input=spec.input, size=(1, 4))).collect()}
    for _ in range(2):
        assert {r["key"]: r["number"] for r in mine(spark, spec).collect()} == whole
    (folder / "in" / "c.conllu").write_text(TWO)
    assert {r["key"]: r["number"] for r in mine(spark, spec).collect()}["(NOUN <nsubj VERB)AB"] == 2
    written = run_each(spark, MineSpec(input=spec.input, size=(1, 4)), str(folder / "each"))
    example = MineSpec(input=spec.input, size=(1, 4), example=True, grew_match=True, depsearch=True, internal_saves=str(folder / "kept2"), continuation_processing=True)
    plain = MineSpec(input=spec.input, size=(1, 4), example=True, grew_match=True, depsearch=True)
    assert run(spark, example) == run(spark, plain)
    (folder / "in" / "a.conllu").write_text(ONE.replace("t1", "t0"))
    assert run(spark, example) == run(spark, plain)
    (folder / "in" / "a.conllu").unlink()
    assert len(written) == 3 and os.path.exists(folder / "each" / "deep" / "a.tsv")
    assert run_each(spark, MineSpec(input=spec.input, size=(1, 4)), str(folder / "each")) == []
    assert len(resume.files_of(spark, spec.input)) == 3


def test_ini(tmp_path):
    (tmp_path / "c.ini").write_text("[settings]\ninput = x\nsize = 2-3\nfixed = no\nfrequency_threshold = 2\nhead = upos=NOUN&Case=Nom|!form=a\n")
    s = read_ini(str(tmp_path / "c.ini"), {"size": "4", "fixed": ""})
    assert s.size == (4, 4) and not s.fixed and s.frequency_threshold == 2 and len(s.head_any_of) == 2


def test_association_formulas(spark):
    n = {"ADJ": 2919, "ADP": 2535, "NOUN": 5790}
    for tree, o, want in ((["ADP", "NOUN"], 441, (-0.33, 17.24, 0.11, 10.76, -5.37, 138.45)), (["ADP", "ADJ", "NOUN"], 298, (2.29, 18.73, 0.08, 10.35, 13.73, -63.45))):
        df = spark.createDataFrame([(float(o), len(tree), [n[t] for t in tree])], "number double, n int, u array<long>")
        got = df.select(*[c.alias(k) for k, c in stats.association(F.col("number"), F.col("n"), F.col("u"), 26500).items()]).head()
        assert tuple(round(x, 2) for x in got) == want
    big = spark.createDataFrame([(1.0, 11, [1] * 11)], "number double, n int, u array<long>")
    assert big.select(*stats.association(F.col("number"), F.col("n"), F.col("u"), 9).values()).head() == (None,) * 6


def test_keyness_formulas(spark):
    df = spark.createDataFrame([(437.0, 165.0), (86.0, 0.0)], "a double, b double")
    got = df.select(*[c.alias(k) for k, c in stats.keyness(F.col("a"), F.col("b"), 26500.0, 25149.0).items()]).collect()
    one = got[0].asDict()
    assert [round(one[k], 2) for k in ("ratio", "ll", "bic", "log_ratio", "odds_ratio", "diff")] == [2.51, 113.64, 102.79, 1.33, 2.54, 151.35]
    two = got[1].asDict()
    assert two["ratio"] != two["ratio"] and [round(two[k], 2) for k in ("ll", "bic", "log_ratio")] == [114.78, 103.93, 66.15]


def test_corpus_names(tmp_path):
    assert corpus_name("x/fr_gsd-ud-dev.conllu", "2.14") == "UD_French-GSD@2.14" and corpus_name("notes.conllu") is None
    names = {"fr_partut-ud-dev": "UD_French-ParTUT", "en_lines-ud-train": "UD_English-LinES", "es_ancora-ud-test": "UD_Spanish-AnCora", "cop_scriptorium-ud-dev": "UD_Coptic-Scriptorium", "sl_ssj-ud-dev": "UD_Slovenian-SSJ", "fr_unknown-ud-dev": None, "xx_gsd-ud-dev": None}
    assert {k: corpus_name(f"hdfs://h/{k}.conllu") for k in names} == names
    (tmp_path / "m.json").write_text('{"xx": {"gsd": "UD_X-GSD"}}')
    assert corpus_name("xx_gsd-ud-dev.conllu", mapping=str(tmp_path / "m.json")) == "UD_X-GSD" and "Grew-match URL" in sinks.header(MineSpec(size=(1, 2), grew_match=True), 2, False, "UD_X-GSD")


def test_wide_grew_patterns_have_every_link(spark):
    from grovecut.plans import queries as Q

    rows = Q.grew_patterns_wide(spark, "/root/testdata/sf0.001").limit(3000).collect()
    for r in rows:
        key = r["key"][: -sum(c.isalpha() and c.isupper() for c in r["key"].rsplit(")", 1)[-1])]
        n = key.count("&")
        tests, places = r["pattern"].split("pattern {")[1][:-1].split("; "), []
        nodes, edges, order = tests[:n], tests[n : 2 * n - 1], tests[2 * n - 1 :]
        assert len(order) == n - 1 and all(x.count("[upos=") == 1 and ", xpos=" in x for x in nodes) and "without" not in r["pattern"]
        places = [x.split(" ")[0] for x in nodes]
        assert sorted(places) == [chr(65 + k) for k in range(n)] and {e.split("]-> ")[1] for e in edges} == set(places[1:])
        assert sorted(e.split("-[")[1].split("]")[0] for e in edges) == sorted(x.split(" ")[0] for x in key.replace("<", ">").split(">")[1:])
