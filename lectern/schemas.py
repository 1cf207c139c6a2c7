"""Schemas of the engine's tables, as DDL."""

METADATA = "map<string,string>"  # values are JSON, so 1, "1" and true differ
DOCUMENTS = "path string, format string, chunk_count int, size bigint, indexed_at bigint, metadata map<string,string>"
CHUNKS = "chunk_id string, document_path string, document_format string, content string, chunk_index int, heading string, metadata map<string,string>"
EMBEDDINGS = "chunk_id string, embedding array<float>"
VERSIONS = "path string, version int, content string, ts bigint"
POSTINGS = "term string, chunk_id string, tf bigint, dl bigint"
EXTRACTED = "path string, format string, content string, metadata map<string,string>, error string"


def names(ddl: str) -> list[str]:
    return [field.split(" ")[0] for field in ddl.split(", ")]
