"""CoNLL-U files as sentences: one row a sentence, its tokens in an array, in corpus order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths

#: Bits of a place within a file; the bits above number the files.
PLACE_BITS = 40
TOKEN = "struct<id:int,form:string,lemma:string,upos:string,xpos:string,feats:map<string,string>,feats_raw:string,head:int,deprel_full:string,misc:string,space_after:boolean>"


def _or_blank(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "_").otherwise(c)


def _token(line: Column) -> Column:
    at = lambda i: F.get(F.split(line, "\t"), F.lit(i))
    given = lambda i: (at(i) != "_") & (at(i) != "")
    pairs = F.filter(F.split(at(5), r"\|"), lambda p: p.contains("="))
    features = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.array_min(F.split(F.substring_index(p, "=", -1), ",")).alias("value")))))
    misc = F.array_join(F.transform(F.array_sort(F.transform(F.split(at(9), r"\|"), lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), p.alias("p")))), lambda x: x["p"]), "|")
    return F.struct(
        at(0).cast("int").alias("id"),
        _or_blank(at(1)).alias("form"),
        _or_blank(at(2)).alias("lemma"),
        _or_blank(at(3)).alias("upos"),
        _or_blank(at(4)).alias("xpos"),
        F.when(F.coalesce(given(5), F.lit(False)), features).otherwise(F.expr("cast(map() as map<string,string>)")).alias("feats"),
        _or_blank(at(5)).alias("feats_raw"),
        F.when(at(6).rlike("^[0-9]+$"), at(6).cast("int")).alias("head"),
        _or_blank(at(7)).alias("deprel_full"),
        _or_blank(misc).alias("misc"),
        (~F.coalesce(F.array_contains(F.split(at(9), r"\|"), "SpaceAfter=No"), F.lit(False))).alias("space_after"),
    )


def read_conllu(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """(path, sent_key, sent_id, toks, conllu) of the sentences of files or of all *.conllu files below a folder.

    Lines end in LF or CRLF; a line of blanks is blank too. Files are cut at blank lines and so can be split. line_sep: the
    two line ends at which they are split, by default those of the first file; other blank lines are found all the same.

    sent_key rises with the path and the place in the file: a sentence's place is where its split begins and its number
    there, which is less than the split's bytes.
    """
    listed = [path] if isinstance(path, str) else path
    files = [f for p in listed for f, _ in paths.treebanks(spark, p)]
    if not files:
        raise FileNotFoundError(f"no *.conllu in {path}")
    if line_sep is None:
        line_sep = "\r\n\r\n" if "\r\n" in paths.head(spark, files[0]) else "\n\n"
    raw = spark.read.option("lineSep", line_sep).text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "block", F.explode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n(?:[ \t]*\r?\n)+")).alias("value"))
    raw = raw.select("*", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    known = spark.createDataFrame([(k, f) for k, f in enumerate(files)], "file_rank long, path string")
    raw = raw.join(known, "path")
    key = F.col("file_rank") * F.lit(1 << PLACE_BITS) + F.col("block") + F.col("row")
    text = F.regexp_replace("value", "\r(?=\n|$)", "")
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike("^[0-9]+\t"))
    kept = raw.withColumn("value", text).select("path", key.alias("sent_key"), F.regexp_extract("value", r"(?m)^#\s*sent_id\s*=\s*(.*?)\s*$", 1).alias("sent_id"), lines.alias("lines"), F.col("value").alias("conllu"))
    return kept.where(F.size("lines") > 0).select("path", "sent_key", F.when(F.col("sent_id") != "", F.col("sent_id")).alias("sent_id"), F.transform("lines", _token).alias("toks"), "conllu")


def tokens(sentences: DataFrame) -> DataFrame:
    """One row a token, with sent_key and the label without its subtype."""
    one = sentences.select("sent_key", F.explode("toks").alias("t")).select("sent_key", "t.*")
    return one.withColumn("deprel", F.substring_index("deprel_full", ":", 1))
