"""Quality rules: base counts, and divergence of a text from the references of its language.

Everything is DataFrame expressions. Each text is read once: its counts, class shares and short words
are stored, and references and verdicts come from these narrow facts. A language reference has the mean histogram of character
classes and the frequencies of the language's commonest short words, both over all documents of
at least ``MIN_WORDS`` words. A document is compared with it by the Jensen-Shannon distance (square
root of the divergence in bits: 0 equal, 1 disjoint). Short texts have noisy histograms, so words
are compared from ``MIN_WORDS_FOR_WORDS`` words on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logspark.llm.common import prepare, stored

MIN_WORDS = 50
MIN_WORDS_FOR_WORDS = 100
#: Distances above which a document is rejected.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.40
#: Commonest words of a language, among words of at most so many characters.
COMMON, SHORT = 12, 5

SPACE = " \t\n\x0b\f\r"
CLASSES = ("lower", "upper", "digit", "symbol", "space", "rest")


def words_of(text: Column) -> Column:
    """Words between ASCII white space, of a text without nulls."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _only(text: str, pattern: str) -> Column:
    """Characters of the class whose complement is ``pattern``."""
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds ``words`` and the counts of words, characters, symbols and character classes."""
    out = docs.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    chars = F.char_length("text").cast("long")
    word_chars = F.char_length(F.array_join("words", "")).cast("long")
    out = out.withColumns({"_chars": chars, "word_chars": word_chars, "n_symbols": chars - _only("text", "[#*$%&|<>]+")})
    lower, upper, digit = _only("text", "\\P{Ll}+"), _only("text", "\\P{Lu}+"), _only("text", "\\P{Nd}+")
    out = out.withColumns({"_lower": lower, "_upper": upper, "_digit": digit})
    rest = F.col("word_chars") - F.col("_lower") - F.col("_upper") - F.col("_digit") - F.col("n_symbols")
    parts = [F.col("_lower"), F.col("_upper"), F.col("_digit"), F.col("n_symbols"), F.col("_chars") - F.col("word_chars"), rest]
    shares = F.array(*[(p / F.greatest("_chars", F.lit(1))).cast("double") for p in parts])
    return out.withColumn("classes", shares).drop("_chars", "_lower", "_upper", "_digit")


def repeated_lines(text: str) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in 3-word windows found at least twice in the text.

    Windows are sorted by hash with their place; equal neighbours repeat, and the places, sorted,
    are merged into covered words. Each step is a column of its own, so nothing is computed twice.
    """
    w = F.col("words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = df.withColumn("_w3", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window))).otherwise(none))
    near = lambda x, i, d: F.coalesce(x["h"] == F.get("_w3", i + d)["h"], F.lit(False))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_w3", lambda x, i: near(x, i, -1) | near(x, i, 1)), lambda x: x["i"])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
    return out.withColumn("n_repeat_words", F.aggregate("_at", zero, step)["n"]).drop("_w3", "_at")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, each of sum 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0)) + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def text_facts(rows: DataFrame) -> DataFrame:
    """``rows`` without their text (which isn't null), with base counts, class shares and, in long ones, the short words."""
    out = with_repeat_words(base_counts(rows)).withColumn("n_dup_lines", repeated_lines("text"))
    short = F.when(F.col("n_words") >= MIN_WORDS, F.filter("words", lambda w: F.char_length(w) <= SHORT))
    return out.withColumn("short", short).drop("text", "words")


def references(facts: DataFrame) -> DataFrame:
    """A row per language (lang null: all languages together): classes, common words, their shares. Each is of fixed size."""
    whole = facts.filter(F.col("n_words") >= MIN_WORDS)
    per_lang = whole.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)], F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("tokens"))
    counted = whole.select("lang", F.explode("short").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    per_lang, counted = stored(per_lang, "class-sums"), stored(counted, "short-words")

    none = F.lit(None).cast("string").alias("lang")
    pooled = per_lang.agg(*[F.sum(c).alias(c) for c in (*CLASSES, "n", "tokens")]).filter("n IS NOT NULL").select(none, *CLASSES, "n", "tokens")
    sums = per_lang.filter("lang IS NOT NULL").select("lang", *CLASSES, "n", "tokens").union(pooled)
    words = counted.filter("lang IS NOT NULL").union(counted.groupBy("word").agg(F.sum("c").alias("c")).select(none, "word", "c"))
    first = Window.partitionBy("lang").orderBy(F.desc("c"), "word")
    top = words.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= COMMON)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "c"))).alias("t"))
    sums = sums.withColumnRenamed("lang", "ref_lang")
    out = sums.join(top, sums["ref_lang"].eqNullSafe(top["lang"]), "left")
    shares = F.transform("t", lambda x: x["c"] / F.col("tokens"))
    shares = F.coalesce(shares, F.array().cast("array<double>"))
    return out.select(
        "ref_lang", F.array(*[F.col(c) / F.col("n") for c in CLASSES]).alias("ref_classes"),
        F.coalesce(F.transform("t", lambda x: x["word"]), F.array().cast("array<string>")).alias("ref_words"),
        F.concat(shares, F.array(1 - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x))).alias("ref_shares"),
    )


def judge(rows: DataFrame) -> DataFrame:
    """``rows`` (text without nulls, lang, and columns to keep) with the base counts, distances and verdict, without the text.

    Languages join the narrow facts, so a language with most documents moves no text, and a heavy one is split by Spark.
    """
    facts = stored(text_facts(rows), "quality-facts")
    refs = stored(references(facts), "references")
    pooled = F.broadcast(refs.filter("ref_lang IS NULL").select(*[F.col(c).alias(f"all_{c}") for c in refs.columns]).limit(1))
    out = facts.join(refs.filter("ref_lang IS NOT NULL"), F.col("lang") == F.col("ref_lang"), "left")
    out = out.withColumn("_one", F.lit(1)).join(pooled.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    for c in ("ref_classes", "ref_words", "ref_shares"):
        out = out.withColumn(c, F.coalesce(c, f"all_{c}"))
    out = out.withColumn("_common", F.filter("short", lambda w: F.array_contains("ref_words", w)))
    counts = F.transform("ref_words", lambda t: F.size(F.filter("_common", lambda w: w == t)) / F.greatest("n_words", F.lit(1)))
    other = (F.col("n_words") - F.size("_common")) / F.greatest("n_words", F.lit(1))
    out = out.withColumn("_shares", F.concat(counts, F.array(other)))
    out = out.withColumns({"class_distance": js_distance(F.col("classes"), F.col("ref_classes")), "word_distance": js_distance(F.col("_shares"), F.col("ref_shares"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.col("class_distance") > MAX_CLASS_DISTANCE) | ((F.col("n_words") >= MIN_WORDS_FOR_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, base counts, ``base_failed``, ``kept``, ``class_distance``, ``word_distance``.

    Null and empty texts have no words and fail the base rule. A null language, and a language
    without a document long enough for a reference, use the pooled reference. Without any document long
    enough for a reference, only the base rule decides. Rows are judged one by one: repeated rows
    and null ids are kept as rows. Other columns are neither read nor returned.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # Stored, so that a filter of the caller reads verdicts and isn't worked into the steps that lead to them.
    out = stored(judge(rows).select("doc_id", *COUNTS, "base_failed", "kept", "class_distance", "word_distance"), "quality")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    # an optimiser that moved a filter below the projections would compute them again for every use
    good = judge(rows).select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return good.filter("_row IS NOT NULL").select("_row.*")
