"""Line-first cleaning with built-in functions only: judge lines, drop the failing ones, then judge what is left.

Each line with a word is held against three rules: a sentence ends in it and symbols are a tenth of its word characters at
most (punctuation), it isn't a list of links (navigation), and it has no standing phrase of web pages (boilerplate). Lines that fail one are removed; a
document that loses more than ``most_lost`` of its word characters that way, or that fails the base measures, is
rejected. The base measures hold for the whole text: few words, or many words in repeated three-word windows.

Scale. One scan, no shuffle, no Python: everything is an expression over the row's own text. Repeated windows are found
by sorting the hashes of a text's windows; only texts that have any pay for finding their places, by a look-up among
the repeated hashes where those are few and by sorting (hash, place) pairs where they are many. Both ways count the same.

Edge cases. Null and empty texts have no words, all measures 0, and fail the base. A very long text is judged whole, and so is a
very long line. Measures that equal a bound pass: they must be below ``least_words``, or above the others, to fail. Repeated rows are judged each;
other columns are never read; an empty table gives an empty result. A text without a terminal mark anywhere, in
any line, is judged by the other two rules only: scripts and layouts without them aren't junk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
#: Marks that end a sentence, marks between links, phrases of page furniture.
TERMINAL = r"[.!?:;…。！？]['\"”»)\]]*([\x20\x09-\x0D]|\z)"
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = r"[|»›•·]|>>|::"
NAVIGATION = r"(?i)^(home|menu|next|previous|prev|back|top|login|log in|sign in|sign up|register|search|share|print|skip to [a-z ]+|read more|click here|contact us|about us|sitemap)([^a-z][^\n]{0,20})?\z"
BOILERPLATE = r"(?i)(^|[^a-z])(cookies? (policy|settings|notice)|we use cookies|enable javascript|javascript is (disabled|required)|privacy policy|terms (of|and) (use|service|conditions)|all rights reserved|lorem ipsum|licensed under the|subscribe to our newsletter|powered by)([^a-z]|\z)|©"
FEW = 64


def _trigram_measures(words: Column) -> Column:
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column) -> Column:
    """Words in the three-word windows that begin at these ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_lost: float = 0.5) -> DataFrame:
    """Measures, verdict and cleaned text of every row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_punctuation,
    lines_navigation, lines_boilerplate (lines that fail each), lost (share of word characters), kept, clean_text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", SPACE + "+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.withColumn("grams", _trigram_measures(F.col("words")))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array("grams")))
    rows = rows.withColumn("again", F.array_distinct(F.filter("sorted", lambda h, k: (k > 0) & (h == F.col("sorted")[F.greatest(k - 1, F.lit(0))]))))
    found = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains(F.col("again"), F.col("grams")[i]))
    rows = rows.withColumn("pairs", F.when(F.size("again") > FEW, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("pairs") - 1
    many = F.sort_array(
        F.transform(
            F.filter("pairs", lambda p, k: ((k > 0) & (p["h"] == F.col("pairs")[F.greatest(k - 1, F.lit(0))]["h"])) | ((k < last) & (p["h"] == F.col("pairs")[F.least(k + 1, last)]["h"]))),
            lambda p: p["i"],
        )
    )
    rows = rows.withColumn("places", F.when(F.col("again").isNull(), F.array().cast("array<int>")).when(F.size("again") <= FEW, found).otherwise(many))
    ends = F.exists("lines", lambda x: x.rlike(TERMINAL))
    rows = rows.withColumn("ends", ends)
    judged = F.transform(
        "lines",
        lambda x: F.struct(
            x.alias("line"),
            ((F.col("ends") & ~x.rlike(TERMINAL)) | (10 * F.regexp_count(x, F.lit(SYMBOLS)) > F.length(F.regexp_replace(x, SPACE, "")))).alias("punctuation"),
            (x.rlike(NAVIGATION) | (F.regexp_count(x, F.lit(SEPARATOR)) >= 3)).alias("navigation"),
            x.rlike(BOILERPLATE).alias("boilerplate"),
            F.length(F.regexp_replace(x, SPACE, "")).alias("chars"),
        ),
    )
    rows = rows.withColumn("judged", judged)
    rows = rows.withColumn("good", F.filter("judged", lambda x: ~(x["punctuation"] | x["navigation"] | x["boilerplate"])))

    def failing(rule: str) -> Column:
        return F.size(F.filter("judged", lambda x: x[rule])).cast("long").alias(f"lines_{rule}")

    def chars(of: str) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda acc, x: acc + x["chars"])

    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        failing("punctuation"),
        failing("navigation"),
        failing("boilerplate"),
        chars("good").alias("left"),
        F.array_join(F.transform("good", lambda x: x["line"]), "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("left") / F.col("word_chars")).otherwise(0.0)
    rows = rows.select("*", base.alias("base_failed"), lost.alias("lost"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_punctuation", "lines_navigation", "lines_boilerplate", "lost", (~F.col("base_failed") & (F.col("lost") <= most_lost)).alias("kept"), "clean_text")
