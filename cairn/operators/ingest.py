"""The whole way of a document into an index: embeds, cleaning, sections, chunks, metadata, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import clean
from ..sources import corpus, work
from . import chunking


def chunks_of(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", expanded: bool = False) -> DataFrame:
    """key, section_no, chunk_no, text, h1, h2, h3, section, source, style, boss of (key, name, text); codes and repeats in ``expanded`` texts stay."""
    docs = docs.select(key, "name", F.coalesce("text", F.lit("")).alias("text"))
    if settings.preprocess_guide:
        docs = clean.preprocess(docs, settings.emoji_mode, settings.enrage_bands, expanded=expanded)
    # the name goes with the text through the splitter
    named = docs.withColumn("own", F.struct(F.col(key).alias("key"), "name")).select("own", "text")
    parts = chunking.sections(named, "own").select(F.col("own.key").alias(key), F.col("own.name").alias("name"), "section_no", "text", "h1", "h2", "h3")
    cut = chunking.chunk_recursive(parts, key, settings.chunk_size, settings.chunk_overlap)
    cut = cut.withColumn("section", corpus.section_of(F.col("h1"), F.col("h2"), F.col("h3")))
    out = chunking.with_metadata(cut, F.regexp_extract("name", r"([^/]*)$", 1), corpus.style_of(F.col("name")), corpus.boss_of(F.col("name")))
    return out.select(key, "section_no", "chunk_no", "text", "h1", "h2", "h3", "section", "source", "style", "boss")


def ingest(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", expanded: bool = False) -> DataFrame:
    """Chunks numbered from 0, by document, section and place; texts are cleaned and cut once, and numbered from what was written."""
    cut = work.written(chunks_of(docs, settings, key, expanded), "chunks")
    return corpus.number_rows(cut, [key, "section_no", "chunk_no"], "chunk_id").select("chunk_id", *cut.columns)
