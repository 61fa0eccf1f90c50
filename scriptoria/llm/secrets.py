"""Secret scanning: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of at least 16 characters of [A-Za-z0-9+/_-], with the = that pad it, or what is assigned to a name for secrets, from 8 characters on. Its features: length, transitions between classes of
characters (lower, upper, digit, other), shares of digits, capitals and hexadecimal characters, distinct characters, coverage by a dictionary, a path-like shape, how far the words beside it are in the dictionary, and
whether one of them, but for a name that it is assigned to, names a secret. The dictionary is the corpus's own: words of three letters or more that occur in `DOCUMENTS` texts outside the held-out fold.

The forest is trained on labelled findings, candidates outside the held-out fold, at most `sample` of either label, those with the smallest hashes. No findings are labelled in the tables, so labels come from evidence
that the forest doesn't see: a finding that is assigned, in quotes, to a name for secrets is a secret; one that stands in running text, assigned to nothing and with no such name in the forty characters before it, is
none; all others have no label. The forest decides on the features of every candidate.

The corpus is scanned once for candidates, which are written, and once for its words.

Defined results: a null text counts as empty and has no candidate. Rows that repeat are scanned each. Candidates of equal features get equal probabilities. Without labelled findings of both kinds no forest can be
grown: every candidate gets the share of secrets among the labelled ones, 0 if there are none. A text of any length is scanned whole. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fold_of, texts

#: Names that secrets are given.
NAMES = "secret|token|passwo?r?d?|api_?key|access_?key|private_?key|credential|auth"
CANDIDATE = rf"(?i)[A-Za-z0-9+/_\-]{{16,}}={{0,2}}|(?<=[=:] {{0,2}}[\"'`]?)(?<=(?:{NAMES})[\"']? {{0,2}}[=:] {{0,2}}[\"'`]?)[^\s\"'`]{{8,}}"
RUN = "([A-Z]?[a-z]+|[A-Z]+)"
#: Texts that a word of the dictionary stands in, at least.
DOCUMENTS = 5
FEATURES = ("length", "transitions", "digits", "capitals", "hex", "distinct", "words", "path", "beside", "named")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, finding (its number in the text), candidate, and the text before and after it, for every candidate."""
    found = texts(docs).select("doc_id", F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)).alias("c"), F.split("text", CANDIDATE, -1).alias("gap")).filter(F.size("c") > 0)
    each = F.transform("c", lambda x, i: F.struct(x.alias("candidate"), F.substring(F.get("gap", i), -40, 40).alias("before"), F.substring(F.get("gap", i + 1), 1, 20).alias("after")))
    return found.select("doc_id", F.posexplode(each).alias("finding", "x")).select("doc_id", "finding", "x.*")


def _count(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")


def _words(text: Column) -> Column:
    """The distinct words of three letters or more of a text, in lower case, camel case taken apart."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)), F.lower), lambda w: F.length(w) >= 3))


def _bare(before: Column) -> Column:
    """What stands before a finding, without the name that it is assigned to."""
    return F.regexp_replace(before, r"\S*\s*[=:]\s*[\"'`]?$", "")


def dictionary(docs: DataFrame, asked: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """The words among asked that stand in at least so many texts."""
    words = texts(docs).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).filter(F.length("word") >= 3)
    # counted before the join: what a task has seen of a word is one row
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("word").join(asked, "word", "left_semi")


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """The features of candidates (with a number, row) beside their columns; known: the dictionary."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    beside = F.concat_ws(" ", _bare(F.col("before")), "after")
    asked = found.select("row", F.explode(F.concat(F.transform(_words(c), lambda w: F.struct(w.alias("word"), F.lit(True).alias("own"))), F.transform(_words(beside), lambda w: F.struct(w.alias("word"), F.lit(False).alias("own"))))).alias("x")).select("row", "x.*")
    length = F.length("word").cast("double")
    cover = asked.join(known, "word").groupBy("row").agg(F.sum(F.when(F.col("own"), length)).alias("own"), F.sum(F.when(~F.col("own"), length)).alias("by"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "$1")).cast("double")
    return found.join(cover, "row", "left").withColumns({
        "length": n, "transitions": (runs - 1) / n, "digits": _count(c, "[0-9]") / n, "capitals": _count(c, "[A-Z]") / n, "hex": _count(c, "[0-9a-fA-F]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n, "words": F.coalesce(F.col("own"), F.lit(0.0)) / n, "path": _count(c, "[/_-]") / n,
        "beside": F.coalesce(F.col("by"), F.lit(0.0)) / F.greatest(F.length(beside), F.lit(1)), "named": F.lower(beside).rlike(NAMES).cast("double"),
    }).drop("own", "by")


def evidence() -> Column:
    """1 or 0 where what stands around a finding labels it, null elsewhere."""
    secret = F.lower("before").rlike(rf"({NAMES})[\"']?\s*[=:]\s*[\"'`]$") & F.col("after").rlike("^[\"'`]")
    plain = ~F.col("before").rlike(r"[=:]\s*[\"'`]?$") & ~F.lower("before").rlike(NAMES)
    return F.when(secret, 1.0).when(plain, 0.0)


def classify(docs: DataFrame, sample: int = 5000, folds: int = 3, held_out: int = 1, trees: int = 20, cut: float = 0.5) -> DataFrame:
    """doc_id, finding, candidate, label (by evidence; may be null), probability and is_secret of every candidate."""
    found = checkpointed(candidates(docs).withColumn("row", F.monotonically_increasing_id()))
    asked = found.select(F.explode(F.array_union(_words(F.col("candidate")), _words(F.concat_ws(" ", _bare(F.col("before")), "after")))).alias("word")).distinct()
    known = dictionary(docs.filter(fold_of(F.col("doc_id"), folds) != held_out), asked)
    rows = checkpointed(with_features(found, known).withColumn("label", evidence()))
    own = rows.filter(F.col("label").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out)).select("label", *FEATURES, F.xxhash64(F.lit(13), "doc_id", "finding").alias("h"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if len(counts) == 2:
        # a bound on the hash that about twice as many pass as are wanted
        bound = {y: min(2**63 - 1, int(-(2**63) + min(1.0, 2 * sample / n) * 2**64)) for y, n in counts.items()}
        passed = own.filter(F.col("h") <= F.when(F.col("label") == 1, F.lit(bound[1.0])).otherwise(F.lit(bound[0.0])))
        first = Window.partitionBy("label").orderBy("h", *FEATURES)
        fitted = passed.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=17, featureSubsetStrategy="sqrt").fit(vectors.transform(fitted))
        p = forest.transform(vectors.transform(rows)).withColumn("probability", vector_to_array("probability")[1])
    else:
        p = rows.withColumn("probability", F.lit(1.0 if 1.0 in counts else 0.0))
    return p.select("doc_id", "finding", "candidate", F.col("label").cast("int").alias("label"), "probability", (F.col("probability") >= cut).alias("is_secret"))
