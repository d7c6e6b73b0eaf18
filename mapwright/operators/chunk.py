"""Cutting long texts into overlapping chunks of tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS = 8000
OVERLAP_TOKENS = 500


def tokens(text: Column) -> Column:
    """Words with the white space before them, and what white space is left at the end; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(r"\s*\S+|\s+"), F.lit(0))


def n_chunks(n_tokens: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    if overlap >= size:
        many = F.raise_error(F.lit("the overlap must be smaller than a chunk")).cast("long")
    else:
        many = 1 + F.ceil((n_tokens - size) / (size - overlap))
    return F.when(n_tokens <= size, F.lit(1).cast("long")).otherwise(many)


def chunk(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``id, chunk, first_token, n_tokens, text``: one row per chunk; a text that fits is one chunk."""
    t = docs.select(F.col(id_col), tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))
    count = n_chunks(F.size("tokens"), size, overlap)
    rows = t.select(id_col, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk"))
    first = F.col("chunk") * (size - overlap)
    piece = F.slice("tokens", (first + 1).cast("int"), F.lit(size))
    return rows.select(id_col, "chunk", first.alias("first_token"), F.size(piece).alias("n_tokens"), F.array_join(piece, "").alias("text"))
