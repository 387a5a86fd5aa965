"""Schemas of stored tables, of hits and of the property graph, and the labels that the graph knows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA = "map<string,string>"
TABLE_DATA = "struct<headers:array<string>,rows:array<array<string>>>"

DOCUMENTS = f"id string, created_at timestamp, updated_at timestamp, source_path string, filename string, document_type string, extracted_text string, metadata {METADATA}"
CHUNKS = f"id string, created_at timestamp, document_id string, chunk_text string, chunk_index int, chunk_type string, table_data {TABLE_DATA}, image_path string, image_caption string, embedding_type string, metadata {METADATA}"
IMAGES = f"id string, created_at timestamp, document_id string, chunk_id string, image_path string, image_type string, extracted_text string, caption string, metadata {METADATA}"
TABLES = f"id string, created_at timestamp, document_id string, chunk_id string, table_data {TABLE_DATA}, table_markdown string, table_text string, metadata {METADATA}"
VECTORS = f"collection string, chunk_id string, document_id string, vector array<float>, payload {METADATA}"
HITS = f"query_id string, source string, rank int, chunk_id string, document_id string, score double, chunk_text string, chunk_type string, filename string, document_type string, source_path string, table_markdown string, image_path string, caption string, metadata {METADATA}"

#: Labels, edge types and the kinds that nodes may have.
NODE_LABELS = ("Document", "Section", "Chunk", "Entity", "Media", "Topic")
EDGE_TYPES = ("HAS_SECTION", "HAS_CHUNK", "NEXT_CHUNK", "MENTIONS", "ABOUT", "RELATED_TO", "HAS_MEDIA", "DESCRIBES", "HAS_TOPIC", "ASSOCIATED_WITH")
CHUNK_TYPES = ("text", "table", "image", "mixed")
MEDIA_TYPES = ("IMAGE", "TABLE", "CHART", "DIAGRAM")
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "LOC", "DATE", "TIME", "MONEY", "PERCENT", "PRODUCT", "EVENT", "LAW", "WORK_OF_ART", "CONCEPT")

#: Node tables by label: key and columns.
NODES = {
    "Document": ("document_id", "document_id string, title string, source_path string, document_type string"),
    "Section": ("section_id", "section_id string, document_id string, title string, section_index int"),
    "Chunk": ("chunk_id", "chunk_id string, document_id string, content string, chunk_index int, chunk_type string"),
    "Entity": ("normalized_name", "normalized_name string, entity_id string, entity_name string, entity_type string, entity_value string, confidence double"),
    "Media": ("media_id", "media_id string, media_type string, media_url string, caption string, alt_text string, metadata string"),
    "Topic": ("normalized_name", "normalized_name string, topic_id string, topic_name string, keywords array<string>, description string"),
}


def known(value: Column, kinds: tuple[str, ...]) -> Column:
    """Membership test for labels, edge types and kinds."""
    return value.isin(*kinds)


def deterministic_id(*parts: Column) -> Column:
    """An id from what a row is about, so that runs compare."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256).substr(1, 32)
