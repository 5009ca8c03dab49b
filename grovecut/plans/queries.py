"""The registered queries on derived treebanks, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mine as M
from ..sources import derived, sinks
from .spec import MineSpec

HEIGHT = derived.HEIGHT


def bank(spark: SparkSession, sf_dir: str, where: str = "TRUE") -> derived.Derived:
    """The sentences of all documents, or of those that meet a condition."""
    return derived.Derived(spark.read.parquet(f"{sf_dir}/documents.parquet").where(where))


def tree_sql(name: str = "upos", fixed: bool = True, labeled: bool = True, ignored: str = "FALSE", allowed: str = "TRUE", tok: str = "tok", at: str = "k", height: int = HEIGHT, by: str = "key, deprel, id") -> str:
    """WITH parts k0, k1, ...: for each token the tree below it. key, nodes in its order, n nodes (n0 with ignored ones), ok if all edges are allowed."""
    rel = "deprel" if labeled else "''"
    if fixed:
        left = f"string_agg(key || ' <' || {rel} || ' ', '' ORDER BY id) FILTER (WHERE NOT drop AND id < head)"
        right = f"string_agg(' >' || {rel} || ' ' || key, '' ORDER BY id) FILTER (WHERE NOT drop AND id > head)"
        before, after = "list(nodes ORDER BY id) FILTER (WHERE NOT drop AND id < head)", "list(nodes ORDER BY id) FILTER (WHERE NOT drop AND id > head)"
    else:
        left, right = "''", f"string_agg(' >' || {rel} || ' ' || key, '' ORDER BY {by}) FILTER (WHERE NOT drop)"
        before, after = "CAST([] AS INT[][])", f"list(nodes ORDER BY {by}) FILTER (WHERE NOT drop)"
    out = [f"{at}0 AS (SELECT sent_key, id, head, deprel, kase, n_tok, name, ({ignored}) AS drop, name AS key, [id] AS nodes, 1 AS n, 1 AS n0, TRUE AS ok FROM (SELECT *, {name} AS name, n AS n_tok FROM {tok}))"]
    for i in range(height):
        out.append(f"""{at}{i + 1} AS (
  SELECT t.sent_key, t.id, t.head, t.deprel, t.kase, t.n_tok, t.name, t.drop,
    CASE WHEN coalesce(c.kept, 0) = 0 THEN t.name ELSE '(' || coalesce(c.l, '') || t.name || coalesce(c.r, '') || ')' END AS key,
    flatten(coalesce(c.a, CAST([] AS INT[][]))) || [t.id] || flatten(coalesce(c.b, CAST([] AS INT[][]))) AS nodes,
    1 + CAST(coalesce(c.n, 0) AS INT) AS n, 1 + CAST(coalesce(c.n0, 0) AS INT) AS n0, coalesce(c.ok, TRUE) AS ok
  FROM {at}0 t LEFT JOIN (
    SELECT sent_key, head, {left} AS l, {right} AS r, {before} AS a, {after} AS b, count(*) FILTER (WHERE NOT drop) AS kept,
      sum(n) FILTER (WHERE NOT drop) AS n, sum(n0) AS n0, bool_and(ok AND ({allowed})) AS ok
    FROM {at}{i} WHERE head > 0 GROUP BY sent_key, head) c ON c.sent_key = t.sent_key AND c.head = t.id)""")
    order = "array_to_string(list_transform(nodes, lambda x: chr(CAST(65 + len(list_filter(nodes, lambda y: y < x)) % 26 AS INT))), '')"
    out.append(f"{at} AS (SELECT *, {order} AS order_letters, key{' || ' + order if fixed else ''} AS full_key FROM {at}{height})")
    return ",\n".join(out)


def counts_sql(where: str = "n0 BETWEEN 2 AND 3", **how: str | bool) -> str:
    return f"WITH {derived.SQL},\n{tree_sql(**how)}\nSELECT full_key AS key, count(*) AS number, CAST(any_value(n) AS INT) AS n, any_value(name) AS head_name FROM k WHERE {where} GROUP BY full_key"


def sets_sql(sets: str, where: str = "TRUE", size: int = 3) -> str:
    """Counts of rendered node sets of at most size nodes; sets are parts that end in one named sets: sent_key, head_id, nodes (a sorted list)."""
    return f"""WITH {derived.SQL},
{sets},
one AS (SELECT mid, sent_key, head_id, unnest(nodes) AS id FROM (SELECT row_number() OVER () AS mid, * FROM (SELECT DISTINCT sent_key, head_id, nodes FROM sets))),
mt AS (SELECT o.mid AS sent_key, t.n, t.id, t.upos, t.deprel, t.kase, CASE WHEN t.id = o.head_id THEN 0 ELSE t.head END AS head FROM one o JOIN tok t ON t.sent_key = o.sent_key AND t.id = o.id),
{tree_sql(tok="mt", height=size - 1)}
SELECT full_key AS key, count(*) AS number, CAST(any_value(n) AS INT) AS n, any_value(name) AS head_name FROM k WHERE head = 0 AND {where} GROUP BY full_key"""


def spec(**settings) -> MineSpec:
    return MineSpec(**{"size": (2, 3), **settings})


_OUT = ("key", "number", "n", "head_name")


def counted(**settings) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: M.counts(bank(spark, sf_dir), spec(**settings), ()).select(*_OUT)


_COMPLETE: dict[str, tuple[dict, str]] = {
    "complete_size23_fixed": ({}, counts_sql()),
    "complete_size23_free": ({"fixed": False}, counts_sql(fixed=False)),
    "complete_size23_unlabeled": ({"labeled": False}, counts_sql(labeled=False)),
    "complete_size23_generic": ({"node_type": None}, counts_sql(name="'_'")),
    "complete_size23_lemma": ({"node_type": "lemma"}, counts_sql(name="lemma")),
    "complete_size23_deprel_form": ({"node_type": "deprel+form"}, counts_sql(name="deprel || '&' || form")),
    "complete_size23_feats": ({"node_type": "feats"}, counts_sql(name="'Case=' || kase || '|Number=' || num")),
    "complete_size23_xpos_misc": ({"node_type": "xpos+misc"}, counts_sql(name="xpos || '&' || misc")),
    "complete_all_fixed": ({"size": (1, 100)}, counts_sql("TRUE")),
    "complete_all_free_unlabeled": ({"size": (1, 100), "fixed": False, "labeled": False}, counts_sql("TRUE", fixed=False, labeled=False)),
    "processing_size_within_size": ({"size": (1, 5), "processing_size": (2, 3)}, counts_sql()),
    "head_filter": ({"size": (1, 4), "head": "upos=NOUN&Case=Nom|!deprel=obj&upos=VERB"}, counts_sql("n0 BETWEEN 1 AND 4 AND ((name = 'NOUN' AND kase = 'Nom') OR (deprel <> 'obj' AND name = 'VERB'))")),
    "allowed_labels": ({"size": (1, 4), "allowed_labels": ("nsubj", "obj", "case")}, counts_sql("n0 BETWEEN 1 AND 4 AND ok", allowed="deprel IN ('nsubj', 'obj', 'case')")),
    "ignored_labels": ({"size": (2, 4), "ignored_labels": ("case", "punct")}, counts_sql("n0 BETWEEN 2 AND 4 AND n BETWEEN 2 AND 4", ignored="deprel IN ('case', 'punct')")),
    "label_subtypes": ({"label_subtypes": True}, counts_sql(tok="(SELECT * REPLACE (deprel || CASE WHEN l % 2 = 0 THEN ':x' ELSE '' END AS deprel) FROM tok)")),
}

_QUERIES: dict[str, tuple[str, bool, str]] = {
    "query_fields": ("xpos=X1&!L=the|form=de > Number=Plur", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id WHERE ((h.xpos = 'X1' AND h.lemma <> 'the') OR h.form = 'de') AND c.num = 'Plur')"),
    "query_bare_word": ("the <nsubj|<obj !de", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id WHERE h.form <> 'de' AND c.form = 'the' AND c.deprel IN ('nsubj', 'obj'))"),
    "query_edge": ("upos=NOUN&Case=Nom > _", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id WHERE h.upos = 'NOUN' AND h.kase = 'Nom')"),
    "query_label_left": ("upos=DET <amod|<case upos=NOUN", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id WHERE h.upos = 'NOUN' AND c.upos = 'DET' AND c.deprel IN ('amod', 'case'))"),
    "query_chain": ("upos=NOUN > (upos=VERB >!obj _)", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id, d.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id JOIN tok d ON d.sent_key = c.sent_key AND d.head = c.id WHERE h.upos = 'NOUN' AND c.upos = 'VERB' AND d.deprel <> 'obj')"),
    "query_siblings": ("_ > upos=NOUN|upos=VERB > upos=VERB", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id, d.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id JOIN tok d ON d.sent_key = h.sent_key AND d.head = h.id AND d.id <> c.id WHERE c.upos IN ('NOUN', 'VERB') AND d.upos = 'VERB')"),
    "query_or_not": ("!upos=NOUN&!upos=VERB > Case=Acc|upos=DET", False, "sets AS (SELECT h.sent_key, h.id AS head_id, list_sort([h.id, c.id]) AS nodes FROM tok h JOIN tok c ON c.sent_key = h.sent_key AND c.head = h.id WHERE h.upos NOT IN ('NOUN', 'VERB') AND (c.kase = 'Acc' OR c.upos = 'DET'))"),
    "query_complete": ("upos=NOUN > _ > _", True, "kids AS (SELECT sent_key, head, count(*) AS m, list(id) AS ids FROM tok GROUP BY ALL), sets AS (SELECT h.sent_key, h.id AS head_id, list_sort(list_append(k.ids, h.id)) AS nodes FROM tok h JOIN kids k ON k.sent_key = h.sent_key AND k.head = h.id WHERE h.upos = 'NOUN' AND k.m = 2 AND NOT EXISTS (SELECT 1 FROM kids x WHERE x.sent_key = h.sent_key AND list_contains(k.ids, x.head)))"),
}


def _partial_sql(most: int, edge: str = "TRUE") -> str:
    parts = ["s1 AS (SELECT sent_key, id AS head_id, [id] AS nodes FROM tok)"]
    for i in range(2, most + 1):
        parts.append(f"s{i} AS (SELECT DISTINCT s.sent_key, head_id, list_sort(list_append(nodes, c.id)) AS nodes FROM s{i - 1} s JOIN tok c ON c.sent_key = s.sent_key AND list_contains(s.nodes, c.head) AND NOT list_contains(s.nodes, c.id) WHERE {edge.format('c.deprel')})")
    parts.append("sets AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(2, most + 1)) + ")")
    return sets_sql(",\n".join(parts), size=most)


_PARTIAL: dict[str, tuple[dict, str]] = {
    "partial_size3": ({"complete": False, "processing_size": (2, 3)}, _partial_sql(3)),
    "partial_size4": ({"complete": False, "size": (2, 4), "processing_size": (2, 4)}, _partial_sql(4)),
    "partial_allowed_labels": ({"complete": False, "processing_size": (2, 3), "allowed_labels": ("nsubj", "amod")}, _partial_sql(3, "{} IN ('nsubj', 'amod')")),
}


def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).frame().groupBy("path").agg(F.sum(F.size("toks")).cast("long").alias("tokens"), F.count("*").alias("sentences")).withColumnRenamed("path", "lang")


def parent_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag governs each, by label: parents are looked up in the sentence's own array, without a join."""
    tags = bank(spark, sf_dir).frame().select(F.col("toks.upos").alias("tags"), F.explode(F.arrays_zip(F.col("toks.head").alias("head"), F.col("toks.upos").alias("upos"), F.col("toks.deprel_full").alias("rel"))).alias("t")).where("t.head > 0")
    return tags.groupBy(F.element_at("tags", F.col("t.head")).alias("parent"), F.col("t.upos").alias("child"), F.substring_index("t.rel", ":", 1).alias("deprel")).agg(F.count("*").alias("number"))


def forest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by their numbers of roots and of tokens without a head."""
    head = F.col("toks.head")
    return bank(spark, sf_dir).frame().groupBy(F.size(F.filter(head, lambda h: h == 0)).alias("roots"), F.size(F.filter(head, lambda h: h.isNull())).alias("unattached")).agg(F.count("*").alias("sentences"))


def closure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a node and one above it or itself, by the edges between them, and those in which the upper one is a root."""
    depths = M.depths(bank(spark, sf_dir)).select("number", F.posexplode(F.sequence(F.lit(0), "depth")).alias("depth", "d"), F.col("depth").alias("own"))
    return depths.groupBy("depth").agg(F.sum("number").alias("pairs"), F.sum(F.when(F.col("own") == F.col("depth"), F.col("number")).otherwise(0)).alias("below_a_root"))


def _unigrams(**settings) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: M.unigrams(bank(spark, sf_dir), spec(**settings))


def order_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of nodes of all complete trees of 3 to 5; those that don't rise aren't projective."""
    return M.counts(bank(spark, sf_dir), spec(size=(3, 5)), ()).groupBy("order_letters").agg(F.sum("number").alias("number"))


_SIX = ("mi", "mi3", "dice", "log_dice", "t_score", "simple_ll")


def association(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.mine(bank(spark, sf_dir), spec(size=(2, 4), association_measures=True), parts=["words"])
    return out.select("key", "number", *[F.round(c, 6).alias(c) for c in _SIX])


ASSOCIATION_SQL = f"""WITH {derived.SQL},
{tree_sql()},
u AS (SELECT upos, count(*) AS c FROM tok GROUP BY upos), size AS (SELECT CAST(count(*) AS DOUBLE) AS s FROM every),
g AS (SELECT full_key AS key, CAST(count(*) AS DOUBLE) AS o, any_value(n) AS n, min(struct_pack(s := sent_key, nodes := nodes)) AS one FROM k WHERE n0 BETWEEN 2 AND 4 GROUP BY full_key),
w AS (SELECT key, o, n, one.s AS s, unnest(one.nodes) AS id FROM g),
p AS (SELECT key, any_value(o) AS o, any_value(w.n) AS n, product(c) / power((SELECT s FROM size), any_value(w.n) - 1) AS e, sum(c) AS t FROM w JOIN tok ON tok.sent_key = w.s AND tok.id = w.id JOIN u USING (upos) GROUP BY key)
SELECT key, CAST(o AS BIGINT) AS number, round(log2(o / e), 6) AS mi, round(log2(o * o * o / e), 6) AS mi3, round(n * o / t, 6) AS dice, round(14 + log2(n * o / t), 6) AS log_dice, round((o - e) / sqrt(o), 6) AS t_score, round(2 * (o * log10(o / e) - (o - e)), 6) AS simple_ll FROM p"""


def association_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of trees of 9 to 12 nodes: those of more than 10 have none."""
    out = M.mine(bank(spark, sf_dir), spec(size=(9, 12), association_measures=True), parts=["words"])
    return out.groupBy("n").agg(F.count("*").alias("keys"), F.count("mi").alias("with_mi"), F.count("simple_ll").alias("with_ll"))


WIDE_SQL = f"WITH {derived.SQL},\n{tree_sql()},\ng AS (SELECT full_key, CAST(any_value(n) AS INT) AS n FROM k WHERE n0 BETWEEN 9 AND 12 GROUP BY full_key)\nSELECT n, count(*) AS keys, count(*) FILTER (WHERE n <= 10) AS with_mi, count(*) FILTER (WHERE n <= 10) AS with_ll FROM g GROUP BY n"


def keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.mine(bank(spark, sf_dir, "lang = 'fr'"), spec(), bank(spark, sf_dir, "lang <> 'fr'"), parts=())
    names = ("relative_frequency_2", "ratio", "ll", "bic", "log_ratio", "odds_ratio", "diff")
    # Where the second corpus has none of a tree, two measures are set by the stand-in for zero: in units of 10**12, for they are compared to 4 places.
    part = lambda c: F.col(c) / F.when(F.abs(c) > 1e12, 1e12).otherwise(1.0)
    return out.select("key", "number", "number_2", *[F.round(F.when(F.isnan(c), None).otherwise(part(c)), 4).alias(c) for c in names])


KEYNESS_SQL = f"""WITH {derived.SQL},
{tree_sql()},
g AS (SELECT full_key AS key, count(*) FILTER (WHERE lang = 'fr') AS a, count(*) FILTER (WHERE lang <> 'fr') AS b FROM k JOIN (SELECT DISTINCT sent_key, lang FROM tok) USING (sent_key) WHERE n0 BETWEEN 2 AND 3 GROUP BY full_key),
z AS (SELECT CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE lang <> 'fr') AS DOUBLE) AS d FROM every),
p AS (SELECT *, CASE WHEN b = 0 THEN 1e-18 ELSE CAST(b AS DOUBLE) END AS p FROM g, z WHERE a > 0),
q AS (SELECT *, 2 * (a * ln(a / (c * (a + p) / (c + d))) + p * ln(p / (d * (a + p) / (c + d)))) AS ll FROM p)
SELECT key, a AS number, b AS number_2, round(b * 1e6 / d, 4) AS relative_frequency_2, CASE WHEN b > 0 THEN round((a / c) / (b / d), 4) END AS ratio, round(ll, 4) AS ll, round(ll - ln(c + d), 4) AS bic,
  round(log2((a / c) / (p / d)), 4) AS log_ratio, CASE WHEN a <> c AND p <> d THEN round(CASE WHEN oddsr > 1e12 THEN oddsr / 1e12 ELSE oddsr END, 4) END AS odds_ratio, round(CASE WHEN dif > 1e12 THEN dif / 1e12 ELSE dif END, 4) AS diff
FROM (SELECT *, (a / (c - a)) / (p / (d - p)) AS oddsr, (a / c * 1e6 - p / d * 1e6) * 100 / (p / d * 1e6) AS dif FROM q)"""


def ranked_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mine(bank(spark, sf_dir), spec(max_lines=100), parts=()).select("key", "number", F.round("relative_frequency", 6).alias("relative_frequency"))


RANKED_SQL = f"WITH {derived.SQL},\n{tree_sql()}\nSELECT full_key AS key, count(*) AS number, round(count(*) * 1e6 / (SELECT count(*) FROM every), 6) AS relative_frequency FROM k WHERE n0 BETWEEN 2 AND 3 GROUP BY full_key ORDER BY number DESC, key LIMIT 100"


def frequency_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mine(bank(spark, sf_dir), spec(frequency_threshold=5), parts=()).select(*_OUT)


def exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key with its example: the first match in a sentence of fewer than 15 words, else the first in a shortest one."""
    return M.mine(bank(spark, sf_dir), spec(example=True), parts=["example"]).select("key", "number", "example")


_MARK = "string_agg(CASE WHEN list_contains(nodes, t.id) THEN chr(CAST(64 + list_position(nodes, t.id) AS INT)) || '[' || t.form || ']' ELSE t.form END || CASE WHEN t.space_after THEN ' ' ELSE '' END, '' ORDER BY t.id)"


def _post_sql() -> str:
    """The path of each token from the root down, which sorts heads after what is below them."""
    parts = ["a0 AS (SELECT sent_key, id, head, [id, 999] AS p FROM tok)"]
    for i in range(HEIGHT):
        parts.append(f"a{i + 1} AS (SELECT a.sent_key, a.id, coalesce(t.head, 0) AS head, CASE WHEN t.id IS NULL THEN a.p ELSE list_prepend(t.id, a.p) END AS p FROM a{i} a LEFT JOIN tok t ON t.sent_key = a.sent_key AND t.id = a.head)")
    parts.append(f"post AS (SELECT sent_key, id, p FROM a{HEIGHT})")
    return ",\n".join(parts)


EXEMPLAR_SQL = f"""WITH {derived.SQL},
{tree_sql()},
{_post_sql()},
r AS (SELECT full_key AS key, sent_key, nodes, count(*) OVER (PARTITION BY full_key) AS number, row_number() OVER (PARTITION BY full_key ORDER BY CASE WHEN n_tok < 15 THEN 0 ELSE n_tok END, sent_key, p) AS rn FROM k JOIN post USING (sent_key, id) WHERE n0 BETWEEN 2 AND 3)
SELECT r.key, r.number, {_MARK} AS example FROM r JOIN every t USING (sent_key) WHERE rn = 1 GROUP BY r.key, r.number, nodes"""


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sentence_counts(bank(spark, sf_dir), spec()).select("sent_id", "key", "number")


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.detailed(bank(spark, sf_dir), spec()).select("key", "sent_id", "sentence")


DETAILED_SQL = f"""WITH {derived.SQL},
{tree_sql()}
SELECT k.full_key AS key, 's' || k.sent_key AS sent_id, {_MARK} AS sentence FROM k JOIN every t USING (sent_key) WHERE n0 BETWEEN 2 AND 3 GROUP BY k.full_key, k.sent_key, k.id, nodes"""


def subtree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(bank(spark, sf_dir), spec(), ()).select("key", F.sha1("key").alias("subtree_hash"), "number")


def _grew(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return M.counts(bank(spark, sf_dir), spec(grew_match=True, **settings), ["pattern"]).select("key", "pattern", "number")


def grew_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grew patterns of trees of two nodes."""
    return _grew(spark, sf_dir, size=(2, 2))


def grew_patterns_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grew patterns of partial trees of two to four nodes with both kinds of tags."""
    return _grew(spark, sf_dir, size=(2, 4), processing_size=(2, 4), complete=False, node_type="upos+xpos")


GREW_SQL = f"""WITH {derived.SQL},
{tree_sql()}
SELECT k.full_key AS key, any_value(CASE WHEN k.id < t.id
    THEN 'pattern {{A [upos=' || k.name || ']; B [upos=' || t.upos || ']; A -[' || t.deprel || ']-> B; A << B}} without {{A -> X0}} without {{B -> X1}}'
    ELSE 'pattern {{B [upos=' || k.name || ']; A [upos=' || t.upos || ']; B -[' || t.deprel || ']-> A; B >> A}} without {{B -> X0}} without {{A -> X1}}' END) AS pattern, count(*) AS number
FROM k JOIN tok t ON t.sent_key = k.sent_key AND t.head = k.id WHERE n0 = 2 GROUP BY k.full_key"""


def depsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads-first keys of complete trees of two to four nodes."""
    return M.counts(bank(spark, sf_dir), spec(size=(2, 4)), ["sorted"]).select("key", "key_sorted", "number")


DEPSEARCH_SQL = f"""WITH {derived.SQL},
{tree_sql()},
{tree_sql(at="h", fixed=False, by="name, id")},
{_post_sql()}
SELECT k.full_key AS key, arg_min(substr(h.key, 2, length(h.key) - 2), k.sent_key * 4096 + k.id) AS key_sorted, count(*) AS number FROM k JOIN h USING (sent_key, id) WHERE k.n0 BETWEEN 2 AND 4 GROUP BY k.full_key"""


def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the result file, as it formats them."""
    how = spec(size=(2, 4), frequency_threshold=3)
    return sinks.formatted(M.mine(bank(spark, sf_dir), how), how).select(F.array_join("cells", "|").alias("line"))


TSV_SQL = f"""WITH {derived.SQL},
{tree_sql()},
g AS (SELECT full_key, any_value(key) AS key, any_value(order_letters) AS ord, any_value(n) AS n, any_value(name) AS head, count(*) AS number, min(struct_pack(s := sent_key, nodes := nodes)) AS one FROM k WHERE n0 BETWEEN 2 AND 4 GROUP BY full_key HAVING count(*) >= 3),
w AS (SELECT full_key, one.s AS s, unnest(one.nodes) AS id, unnest(range(len(one.nodes))) AS spot FROM g),
x AS (SELECT full_key, string_agg(upos, '|' ORDER BY spot) AS words FROM w JOIN tok ON tok.sent_key = w.s AND tok.id = w.id GROUP BY full_key)
SELECT substr(key, 2, length(key) - 2) || '|' || words || repeat('|', CAST(least(4, (SELECT max(n) FROM g)) - n AS INT)) || '|' || number || '|' || printf('%.1f', number * 1000000.0 / (SELECT count(*) FROM every)) || '|' || ord || '|' || n || '|' || head AS line FROM g JOIN x USING (full_key)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_size": corpus_size,
    "parent_link": parent_link,
    "closure_stats": closure_stats,
    "forest_shapes": forest_shapes,
    "unigrams_upos": _unigrams(),
    "unigrams_composite": _unigrams(node_type="upos+lemma"),
    **{name: counted(**settings) for name, (settings, _) in _COMPLETE.items()},
    "order_letters": order_letters,
    **{name: counted(query=q, complete=c) for name, (q, c, _) in _QUERIES.items()},
    **{name: counted(**settings) for name, (settings, _) in _PARTIAL.items()},
    "association_measures": association,
    "association_wide": association_wide,
    "keyness_compare": keyness,
    "ranked_top100": ranked_top100,
    "frequency_threshold": frequency_threshold,
    "exemplar_sentence": exemplar,
    "sentence_counts": sentence_counts,
    "detailed_results": detailed,
    "subtree_hash": subtree_hash,
    "grew_patterns": grew_patterns,
    "grew_patterns_wide": grew_patterns_wide,
    "tsv_rows": tsv_rows,
    "depsearch_sorted": depsearch,
}

SQL: dict[str, str] = {
    "corpus_size": f"WITH {derived.SQL} SELECT lang, count(*) AS tokens, count(DISTINCT sent_key) AS sentences FROM every GROUP BY lang",
    "parent_link": f"WITH {derived.SQL} SELECT p.upos AS parent, c.upos AS child, c.deprel, count(*) AS number FROM tok c JOIN tok p ON p.sent_key = c.sent_key AND p.id = c.head GROUP BY ALL",
    "closure_stats": f"WITH RECURSIVE {derived.SQL}, up AS (SELECT sent_key, id AS at_, id, 0 AS depth FROM tok UNION ALL SELECT u.sent_key, t.head, u.id, depth + 1 FROM up u JOIN tok t ON t.sent_key = u.sent_key AND t.id = u.at_ WHERE t.head > 0) SELECT depth, count(*) AS pairs, count(*) FILTER (WHERE head = 0) AS below_a_root FROM up u JOIN tok t ON t.sent_key = u.sent_key AND t.id = u.at_ GROUP BY depth",
    "forest_shapes": f"WITH {derived.SQL}, s AS (SELECT CAST(count(*) FILTER (WHERE head = 0) AS INT) AS roots, CAST(count(*) FILTER (WHERE head IS NULL) AS INT) AS unattached FROM every GROUP BY sent_key) SELECT roots, unattached, count(*) AS sentences FROM s GROUP BY ALL",
    "unigrams_upos": f"WITH {derived.SQL} SELECT upos AS name, count(*) AS c FROM tok GROUP BY upos",
    "unigrams_composite": f"WITH {derived.SQL} SELECT upos || '&' || lemma AS name, count(*) AS c FROM tok GROUP BY ALL",
    **{name: sql for name, (_, sql) in _COMPLETE.items()},
    "order_letters": f"WITH {derived.SQL},\n{tree_sql()}\nSELECT order_letters, count(*) AS number FROM k WHERE n0 BETWEEN 3 AND 5 GROUP BY order_letters",
    **{name: sets_sql(sql) for name, (_, _, sql) in _QUERIES.items()},
    **{name: sql for name, (_, sql) in _PARTIAL.items()},
    "association_measures": ASSOCIATION_SQL,
    "association_wide": WIDE_SQL,
    "tsv_rows": TSV_SQL,
    "keyness_compare": KEYNESS_SQL,
    "ranked_top100": RANKED_SQL,
    "frequency_threshold": counts_sql() + " HAVING count(*) >= 5",
    "exemplar_sentence": EXEMPLAR_SQL,
    "sentence_counts": f"WITH {derived.SQL},\n{tree_sql()}\nSELECT 's' || sent_key AS sent_id, full_key AS key, count(*) AS number FROM k WHERE n0 BETWEEN 2 AND 3 GROUP BY ALL",
    "detailed_results": DETAILED_SQL,
    "subtree_hash": f"WITH {derived.SQL},\n{tree_sql()}\nSELECT full_key AS key, sha1(full_key) AS subtree_hash, count(*) AS number FROM k WHERE n0 BETWEEN 2 AND 3 GROUP BY full_key",
    "grew_patterns": GREW_SQL,
    "depsearch_sorted": DEPSEARCH_SQL,
}
