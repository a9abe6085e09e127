"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sent, settle, unused

SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select(
        "doc_id", "norm", F.octet_length("norm").alias("n_bytes"),
        F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"),
    )


def _hashed(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """Narrow rows with full hash; ``shared`` marks those that left the first two levels together."""
    keyed = _keyed(docs, id_col, text_col)
    # counted as pairs, so that a length that very many texts have is spread; a pair held twice has such a length
    groups = settle(
        keyed.groupBy("n_bytes", "prefix").count().filter("count > 1")
        .select("n_bytes", "prefix", F.lit(True).alias("shared")), "dedup-prefixes",
    )
    digest = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest")
    if digest_all:  # the digest is asked for anyway: no text goes into the join
        rows = keyed.select("doc_id", "n_bytes", "prefix", digest).join(groups, ["n_bytes", "prefix"], "left")
    else:
        rows = keyed.join(groups, ["n_bytes", "prefix"]).select("doc_id", "n_bytes", "prefix", digest, "shared")
    return settle(rows, "dedup-hashes")


def _copies(hashed: DataFrame) -> DataFrame:
    """One row per distinct (id, text) of a surviving group, with its verdict and its number of rows."""
    key = ["n_bytes", "prefix", "digest"]
    rows = settle(
        hashed.filter("shared").groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("rows")), "dedup-rows"
    )
    groups = rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    return rows.join(groups, key)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = True
) -> DataFrame:
    """Verdict per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of white space became one space. Lengths held
    by one row only leave at once, then prefixes held by one row; only what is left meets by full hash.
    With ``digest_all`` false, full content is hashed for those rows alone and only they are returned.

    Null texts count as empty. Rows that repeat id and text are one document: they give one verdict, and
    ``group_size`` counts each row. A null id is larger than any other; rows that differ in text under one
    id are separate documents. Of equal texts the smallest id stays. An empty table gives no rows; other
    columns, whatever their names, are not looked at. Copies are counted before they are exchanged, so a
    group of any size costs one row per task.
    """
    hashed = _hashed(docs, id_col, text_col, digest_all)
    copies = _copies(hashed).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    single = hashed.filter("shared is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return single.unionByName(copies)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; null and repeated rows as in ``exact_dedup``.

    Of rows that repeat id and text one stays, whichever its other columns are. The verdicts on what does not
    stay as it is are sent to all executors while their counted rows allow; beyond, texts are joined by digest.
    """
    hashed = _hashed(docs, id_col, text_col, digest_all=False)
    key, full, is_kept, n_rows = unused(docs, "_id", "_digest", "_kept", "_rows")
    verdict = settle(
        _copies(hashed).filter("rows > 1 or not doc_id <=> keep_id").select(
            F.col("doc_id").alias(key), F.col("digest").alias(full),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(is_kept), F.col("rows").alias(n_rows),
        ), "dedup-verdict",
    )
    digest = F.unhex(F.sha2(normalised(docs[text_col]).cast("binary"), 256))
    same = docs[id_col].eqNullSafe(F.col(key)) & (digest == F.col(full))
    once = docs.join(sent(verdict), same, "left_anti")
    repeated = settle(verdict.filter(F.col(is_kept)), "dedup-repeated")
    if repeated.isEmpty():
        return once
    again = docs.join(sent(repeated), same).dropDuplicates([key, full])
    return once.unionByName(again.select(*[docs[c] for c in docs.columns]))
