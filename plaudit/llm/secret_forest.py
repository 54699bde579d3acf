"""Secret scan: a random forest removes false positives among candidate strings.

Only DataFrame and SQL functions and Spark's own forest are used.

Candidates are all runs of 10 or more characters of ``[A-Za-z0-9+/_.@~-]`` that have a
digit, any number of them in a word (words are split at white space). Behind a key that
names a credential the value has any characters and needs no digit: up to the closing
quote, in a URL parameter up to ``&`` or ``#``, else up to a quote, ``<``, ``>``, ``,``
or ``;``. The key before ``=`` or ``:`` in the same word
is kept apart. Features: length, shares of character kinds, distinct characters,
changes of character kind, mean log probability of the value's character transitions
(learned from the words around all candidates), the share of the value covered by
dictionary words (words found around at least two candidates), the path (the
document's source: whether it names tests or examples), and the neighbouring words
(credential names, assignment signs, quotes, placeholder words).

The forest learns from labelled findings: a frame ``(value, label)`` that the caller
has, or ``seed_labels``, which labels the findings whose form settles the matter
(issuers' key formats and credential assignments against addresses, numbers, mail and
dictionary words). At most ``train_rows`` findings (by hash) train it.
Without findings of both labels a finding's own seed label is its score (0.5: none).

Null or empty texts have no candidates. A finding is reported for every occurrence;
repeated rows give repeated findings, null ids are kept.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import hashed_sample, written

#: fixed values: names that stand before a credential, words that mark a made-up one
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test)"
#: fixed values: key formats of issuers
ISSUED = (r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|"
          r"^AIza[A-Za-z0-9_-]{35}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.")
HARMLESS = (r"^\d{1,3}(\.\d{1,3}){3}(/\d+)?$|^[\d.+/_-]+$|^[^@]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$|"
            r"^(www\.|https?)|\.(com|org|net|html?|php)(/|$)")
_RUN, _QUOTE, _KEY = r"A-Za-z0-9+/_.@~\-", r"[\x22\x27\x60]", r"[A-Za-z0-9_.\-]"
_NAMED = rf"{_KEY}*?{CREDENTIAL}{_KEY}*+"
#: fixed values: a value with the key before it (credential in a URL parameter, in quotes,
#: bare; any run of value characters), a run that ends a value, the key and its value
FOUND = (rf"(?<![{_RUN}])(?:(?<=[?&]){_NAMED}=[^&#\s\x22\x27\x60<>]{{10,}}+|{_NAMED}{_QUOTE}?[=:]{_QUOTE}[^\s\x22\x27\x60]{{10,}}+|"
         rf"{_NAMED}{_QUOTE}?[=:][^\s\x22\x27\x60<>,;]{{10,}}+|(?:[A-Za-z]{_KEY}*+{_QUOTE}?[=:]{_QUOTE}?)?[{_RUN}]{{10,}}+={{0,2}})")
RUN_ONLY = rf"^([{_RUN}]{{10,}}+={{0,2}})[;,.)\]}}>]*$"
KEYED = rf"^([A-Za-z0-9_.\-]+){_QUOTE}?[=:]{_QUOTE}?([^\x22\x27\x60]{{10,}})$"
FEATURES = ("length", "digits", "upper", "lower", "distinct", "changes", "transitions", "dictionary", "path_test",
            "near_credential", "own_key", "assigned", "quoted", "near_placeholder")
AROUND = 6


def candidates(docs: DataFrame, text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, word_no, value, key, word, path, around (words near it)."""
    place = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    near = f"slice(_words, greatest(i + 1 - {AROUND}, 1), least(i, {AROUND})) "
    after = f"slice(_words, i + 2, {AROUND})"
    has = f"length(w) >= 10 and (w rlike '[0-9]' or w rlike r'{CREDENTIAL}{_KEY}*+{_QUOTE}?[=:]')"
    rows = (docs.select("doc_id", place.alias("path"), F.col(text).alias("_text"))
            .where(F.col("_text").rlike("[0-9]") | F.col("_text").rlike(CREDENTIAL))
            .select("doc_id", "path", F.split("_text", r"[\x20\x09-\x0D]+").alias("_words"))
            .selectExpr("doc_id", "path", f"""explode(filter(transform(_words, (w, i) ->
                if({has}, named_struct('word_no', i, 'w', w, 'before', {near}, 'after', {after}), null)),
                x -> x is not null)) as c""")
            .select("doc_id", "path", "c", F.explode(F.regexp_extract_all("c.w", F.lit(FOUND), F.lit(0))).alias("_f"))
            .select("*", F.regexp_extract("_f", KEYED, 1).alias("key"), F.regexp_extract("_f", KEYED, 2).alias("_v"))
            .withColumn("_v", F.when(F.col("key") == "", F.col("_f")).otherwise(F.col("_v")))
            .withColumn("_r", F.regexp_extract("_v", RUN_ONLY, 1))
            .withColumn("value", F.when(F.col("_r") == "", F.col("_v")).otherwise(F.col("_r"))))
    return (rows.where(F.col("value").rlike("[0-9]") | F.col("key").rlike(CREDENTIAL))
            .select("doc_id", F.col("c.word_no").alias("word_no"), "value", "key", F.col("c.w").alias("word"), "path",
                    F.col("c.before").alias("before"), F.col("c.after").alias("after")))


def with_features(found: DataFrame) -> DataFrame:
    """Findings with a feature column each; ``finding`` names the finding."""
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    size = F.length("value")
    share = lambda p: F.regexp_count("value", F.lit(p)) / size
    base = (found.withColumn("length", size.cast("double"))
            .withColumn("digits", share("[0-9]")).withColumn("upper", share("[A-Z]")).withColumn("lower", share("[a-z]"))
            .withColumn("distinct", F.size(F.array_distinct(F.split("value", ""))) / size)
            .withColumn("changes", (F.length(F.regexp_replace(kind, r"(.)\1+", "$1")) - 1) / size)
            .withColumn("path_test", F.coalesce(F.col("path").rlike(PLACEHOLDER), F.lit(False)).cast("double"))
            .withColumn("near_credential", F.when(F.size("before") > 0, F.concat_ws(" ", F.expr(
                "slice(before, greatest(size(before) - 2, 1), 3)"))).otherwise("").rlike(CREDENTIAL).cast("double"))
            .withColumn("own_key", F.col("key").rlike(CREDENTIAL).cast("double"))
            .withColumn("assigned", (F.coalesce(F.expr("try_element_at(before, -1)"), F.lit("")).rlike("[=:]$")
                                     | (F.col("key") != "")).cast("double"))
            .withColumn("quoted", F.col("word").rlike("[\"'`]").cast("double"))
            .withColumn("near_placeholder", F.concat_ws(" ", "before", "after").rlike(PLACEHOLDER).cast("double")))
    around = found.select(F.explode(F.concat("before", "after")).alias("w")) \
        .select(F.lower(F.regexp_extract("w", r"^\W*([^\W\d_]+)\W*$", 1)).alias("w")).where("length(w) > 1")
    words = around.groupBy("w").agg(F.count("*").alias("n"))
    # transitions: pairs of neighbouring characters among those words, add-one over 64 followers
    pairs = words.select("n", F.explode(F.expr(
        "transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("p")) \
        .groupBy("p").agg(F.sum("n").alias("n"))
    firsts = pairs.groupBy(F.substring("p", 1, 1).alias("a")).agg(F.sum("n").alias("total"))
    known = pairs.join(firsts, F.substring("p", 1, 1) == F.col("a")) \
        .select("p", F.log((F.col("n") + 1.0) / (F.col("total") + 64.0)).alias("lp"))
    values = base.select("value").distinct()
    trans = (values.select("value", F.explode(F.expr(
        "transform(sequence(1, length(value) - 1), i -> lower(substring(value, i, 2)))")).alias("p"))
        .join(known, "p", "left").groupBy("value")
        .agg(F.avg(F.coalesce("lp", F.lit(-8.0))).alias("transitions")))
    dictionary = words.where("n >= 2 and length(w) >= 3").select("w")
    cover = (values.select("value", F.explode(F.regexp_extract_all("value", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("r"))
             .select("value", F.lower("r").alias("w")).join(dictionary, "w")
             .groupBy("value").agg(F.sum(F.length("w")).alias("covered")))
    per = values.join(trans, "value", "left").join(cover, "value", "left").select(
        "value", F.coalesce("transitions", F.lit(-8.0)).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("dictionary"))
    return base.join(per, "value")


def seed_labels() -> F.Column:
    """1.0: secret by its form, 0.0: harmless by its form, null: undecided."""
    v = F.col("value")
    named = (F.col("own_key") > 0) | ((F.col("near_credential") > 0) & (F.col("assigned") > 0))
    random = (F.col("length") >= 14) & (F.col("digits") > 0.15) & (F.col("dictionary") < 0.3)
    return (F.when(v.rlike(HARMLESS) | (F.col("dictionary") > 0.6), 0.0)
            .when(v.rlike(ISSUED) | (named & random), 1.0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, train_rows: int = 20_000, trees: int = 30,
         depth: int = 6, threshold: float = 0.5, text: str = "text", path: str | None = "source") -> DataFrame:
    """Findings doc_id, word_no, value, key, score, is_secret."""
    found = written(candidates(docs, text, path), "secret_candidates")
    seen = with_features(found)
    seen = (seen.join(labelled.select("value", F.col("label").cast("double").alias("label")).dropDuplicates(["value"]),
                      "value", "left") if labelled is not None else seen.withColumn("label", seed_labels()))
    seen = written(seen, "secret_features")
    known = seen.where("label is not null")
    train = written(hashed_sample(known.select("label", *FEATURES, "value"), F.xxhash64("value"), train_rows,
                                  known.count()).dropDuplicates(["value"])
                    .repartition(1).sortWithinPartitions("value"), "secret_training")  # at most train_rows rows
    both = train.agg(F.countDistinct("label")).first()[0]
    cols = ["doc_id", "word_no", "value", "key"]
    if both < 2:
        scored = seen.withColumn("score", F.coalesce("label", F.lit(0.5)))
    else:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featuresCol="features",
                                        labelCol="label", subsamplingRate=0.8)
        model = forest.fit(assembler.transform(train.coalesce(1)))  # one bounded part: the same forest every time
        scored = model.transform(assembler.transform(seen)) \
            .withColumn("score", vector_to_array("probability")[1])
    return scored.select(*cols, "score", (F.col("score") > threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every value found to be a secret replaced in its document's text
    (longest first); n_chars, where there is one, follows. Columns stay as they are."""
    values = findings.where("is_secret").groupBy(F.col("doc_id").alias("_finding_doc")) \
        .agg(F.collect_set("value").alias("_values"))
    ordered = F.expr("array_sort(_values, (a, b) -> case when length(a) <> length(b) then length(b) - length(a) "
                     "when a < b then -1 when a > b then 1 else 0 end)")
    out = docs.join(values.withColumn("_values", ordered), F.col("doc_id").eqNullSafe(F.col("_finding_doc")), "left")
    text = F.when(F.col("_values").isNull(), F.col("text")).otherwise(
        F.aggregate("_values", F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark))))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_values").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
