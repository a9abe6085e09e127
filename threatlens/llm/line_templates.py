"""Line dedup by a tree of line templates, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sent, settle, unused

SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a variable field.
FIELD = "<*>"
#: Leading words that place a line in the tree, below its number of words.
DEPTH = 3
#: Fewest words of a line whose words may become fields, documents that make a template a recurring one, and words
#: from which a line is too long to be the same in two documents by chance.
MIN_WORDS, MIN_DOCS, LONG_WORDS = 5, 5, 10
#: A word is constant at its place if at least these tenths of the leaf's different lines have it there; a line's other
#: words become fields if at least this share of its words is constant.
CONSTANT_TENTHS, CONSTANT = 3, 0.7
#: With fewer different lines in a leaf every word of them is constant.
MIN_LINES = 10 // CONSTANT_TENTHS + 1


def _masked(line: Column) -> Column:
    """The line's words between single spaces; words with a digit are fields."""
    words = F.trim(F.regexp_replace(line, SPACE, " "))
    return F.when(words.rlike("[0-9]"), F.regexp_replace(words, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(words)


def _count(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines with a word, stored: place, masked text, hash of it, leaf, whether long, whether it may have fields."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("lines"))
    lines = rows.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line"))
    lines = lines.select("doc_id", "text_key", "line_no", _masked(F.col("line")).alias("masked")).filter("masked <> ''")
    n_words = _count(F.col("masked"), " ") + 1
    leaf = F.xxhash64(n_words, F.substring_index("masked", " ", DEPTH))
    return settle(lines.select(
        "doc_id", "text_key", "line_no", "masked", F.xxhash64("masked").alias("line_key"), leaf.alias("leaf"),
        (n_words - _count(F.col("masked"), FIELD) >= LONG_WORDS).alias("is_long"), (n_words >= MIN_WORDS).alias("may_vary"),
    ), "lines")


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` in at least MIN_DOCS documents, and the first document: counted per document first."""
    per_doc = rows.filter("doc_id is not null").select(key, "doc_id").dropDuplicates()
    counts = per_doc.groupBy(key).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
    return counts.filter(F.col("docs") >= MIN_DOCS).select(key, "first_doc")


def _recurring_lines(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(line_key, first_doc) of whole lines to drop: long ones in two documents, others in MIN_DOCS.

    Lines of one document only leave first, by the smallest and largest id that has them.
    """
    shared = settle(patterns.filter("first_doc < last_doc").select("line_key", "is_long", "first_doc"), "line-shared")
    some = shared.filter("not is_long").select("line_key")
    known = lines.select("line_key", "doc_id").join(sent(some), "line_key", "left_semi")
    return shared.filter("is_long").select("line_key", "first_doc").unionByName(_recurring(known, "line_key"))


def _templates(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(line_key, template) of the lines in which words become fields.

    Counted over the different lines of a leaf, so a line that is repeated counts once, and by shares, so a template
    is the same in a table of any size. Only leaves of MIN_LINES different lines or more are looked into.
    """
    varied = patterns.filter("may_vary").groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines"))
    varied = settle(varied.filter(F.col("n_lines") >= MIN_LINES), "line-leaves")
    texts = lines.filter("may_vary").select("leaf", "line_key", "masked").join(
        sent(varied.select("leaf")), "leaf", "left_semi"
    )
    texts = settle(texts.groupBy("leaf", "line_key").agg(F.min("masked").alias("masked")), "line-patterns")
    words = texts.select("leaf", "line_key", F.posexplode(F.split("masked", " ")).alias("place", "word")).select(
        "leaf", "line_key", "place", F.xxhash64("word").alias("word_key")
    )
    usual = words.filter(F.col("place") >= DEPTH).groupBy("leaf", "place", "word_key").agg(F.count(F.lit(1)).alias("n"))
    usual = usual.join(varied, "leaf").filter(10 * F.col("n") >= CONSTANT_TENTHS * F.col("n_lines"))
    usual = usual.select("leaf", "place", "word_key", F.lit(True).alias("usual"))
    constant = (F.col("place") < DEPTH) | F.col("usual")
    seen = words.join(usual, ["leaf", "place", "word_key"], "left").filter(~F.coalesce(constant, F.lit(False)))
    fields = seen.groupBy("leaf", "line_key").agg(F.collect_set("place").alias("fields"))
    found = texts.join(fields, ["leaf", "line_key"]).withColumn("words", F.split("masked", " "))
    found = found.filter(F.size("words") - F.size("fields") >= CONSTANT * F.size("words"))
    template = F.transform("words", lambda word, i: F.when(F.array_contains("fields", i), FIELD).otherwise(word))
    return settle(found.select("line_key", F.array_join(template, " ").alias("template")), "line-templates")


def _dropped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The dropped lines, and the templates of those lines that have fields."""
    lines = _lines(docs, id_col, text_col)
    patterns = settle(lines.groupBy("line_key", "leaf", "is_long", "may_vary").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    ), "line-counts")
    whole = settle(_recurring_lines(lines, patterns), "line-recurring")
    templates = _templates(lines, patterns)
    places = lines.select("doc_id", "text_key", "line_no", "line_key")
    keyed = templates.select("line_key", F.xxhash64("template").alias("template_key"))
    placed = settle(places.join(sent(keyed), "line_key"), "line-places")
    dropped = [
        rows.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .select("doc_id", "text_key", "line_no", F.col(key).alias("template_key"))
        for rows, key in (
            (places.join(sent(whole), "line_key"), "line_key"),
            (placed.join(_recurring(placed, "template_key"), "template_key"), "template_key"),
        )
    ]
    return settle(dropped[0].unionByName(dropped[1]), "line-dropped"), templates


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no, template_key) of the lines that are dropped; ``text_key`` tells texts of one id apart.

    The tree's first levels are a line's number of words and its first DEPTH words, words with a digit counting as
    equal. A line is dropped if its template recurs in MIN_DOCS documents, or if the line as a whole does, or if it
    has LONG_WORDS words without digits and stands in two documents; but not in the document of the smallest id
    that has it. A line may be listed twice, once for each reason. Keys are hashes of the template or the masked line.
    """
    return _dropped(docs, id_col, text_col)[0]


def recurring_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(template, n_lines, n_docs) of the templates with fields beyond words with digits, and what they drop."""
    dropped, templates = _dropped(docs, id_col, text_col)
    named = templates.select("template", F.xxhash64("template").alias("template_key")).distinct()
    return dropped.join(named, "template_key").groupBy("template").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs")
    )


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "clean_text"
) -> DataFrame:
    """The documents with the text that remains in ``out_col`` and the numbers of lines before and dropped
    (``n_lines``, ``n_dropped``), instead of any columns of those names.

    A null text is empty: one empty line. Lines without a word always stay. Rows without id take part as
    documents that are never first and do not count towards recurrence. Rows that repeat id and text are
    treated alike; each keeps its row. An empty table gives no rows. Other columns may have any names. A document's
    dropped lines meet as one list of numbers, which is no longer than its text. Hashes of lines and those lists are
    sent to all executors while their counted rows allow, so texts are not exchanged; beyond, they are joined.
    """
    key, text_key, drop, lines, flags = unused(docs, "_id", "_key", "_drop", "_lines", "_flags")
    text = F.coalesce(docs[text_col], F.lit(""))
    # a string of 0 and 1 per line up to the last dropped one, built in one pass over the numbers
    gaps = F.transform(
        F.col(drop), lambda n, i: F.lpad(F.lit("1"), (n - F.when(i > 0, F.get(F.col(drop), i - 1)).otherwise(-1)).cast("int"), "0"),
    )
    drops = dropped_lines(docs, id_col, text_col).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set("line_no")).alias(drop)
    )
    drops = settle(drops.select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key), drop), "line-drops")
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(text_key))
    names = [c for c in docs.columns if c not in (out_col, "n_lines", "n_dropped")]
    joined = docs.join(sent(drops, 4), same, "left").select(
        *[docs[c] for c in names], F.split(text, "\n").alias(lines), F.split(F.array_join(gaps, ""), "").alias(flags),
        F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped"),
    )
    kept = F.filter(F.col(lines), lambda line, i: F.coalesce(F.get(F.col(flags), i), F.lit("0")) != "1")
    return joined.select(
        *names, F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.array_join(lines, "\n")).alias(out_col),
        F.size(lines).alias("n_lines"), "n_dropped",
    )
