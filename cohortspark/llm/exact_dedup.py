"""Exact duplicates through content-defined chunk recipes, with DataFrame functions only.

A text is cut at content-defined places into chunks. Every chunk gets an identifier, the
identifiers are verified (no two different chunks may share one), and texts are equal when
their ordered identifier lists are. Texts travel once, as chunks and after a map-side distinct;
everything later moves lists of 16-byte identifiers.

Defined cases:

* NULL text counts as the empty text; its recipe is the empty list.
* NULL ``doc_id`` is smaller than any id; it stays only in a group without other ids.
* Rows that repeat both id and text: exactly one of them stays.
* An empty table gives an empty result. Columns other than the id and the text are not read by
  ``exact_groups``; ``drop_exact_copies`` hands all of them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import kept_rows
from cohortspark.session import materialize

#: A chunk ends at white space before one of a few letters, found at 384 characters or later; where there is
#: none within 4096 characters, it ends there.
CHUNK = r"(?s).{384,4096}?(?:\s(?=[a-eA-E])|\z)|.{1,4096}"

Identifier = Callable[[Column], Column]

#: From short to long; the next is taken when verification finds two chunks behind one identifier.
IDENTIFIERS: tuple[Identifier, ...] = (
    lambda c: F.concat(F.hex(F.xxhash64(c)), F.lit("."), F.hex(F.xxhash64(F.lit("second"), c))),
    lambda c: F.sha2(c, 256),
)


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def ambiguous(texts: DataFrame, identifier: Identifier) -> bool:
    """Whether two different chunks of the column ``text`` share an identifier."""
    pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    known = pieces.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    return not known.groupBy("id").count().filter("count > 1").isEmpty()


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    identifiers: Sequence[Identifier] = IDENTIFIERS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    texts = docs.select(
        docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text")
    )
    identifier = next((f for f in identifiers if not ambiguous(texts, f)), None)
    if identifier is None:
        raise ValueError("two different chunks share even their longest identifier")
    recipes = materialize(
        texts.select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.concat_ws(",", F.transform(chunks(F.col("text")), identifier)).alias("recipe"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "recipes",
    )
    groups = (
        recipes.groupBy("recipe")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    # Written, so that the join below is one of two tables, whose hot keys AQE can split.
    groups = materialize(groups, "copies")
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns and one row for each distinct text."""
    groups = materialize(exact_groups(docs, id_column, text_column), "exact_groups")
    sha = F.sha2(F.coalesce(docs[text_column], F.lit("")), 256)
    return kept_rows(docs, id_column, sha, groups.withColumnRenamed("text_sha256", "tag"))
