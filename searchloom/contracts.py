"""Constants of the contracts that stored tables and results keep."""

# Fixed values.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN = 512, 64, 300
TOP_K_MAX, RRF_K, CANDIDATES, RERANKED = 10, 60, 40, 20
CHUNKING_VERSION, METADATA_VERSION, LEXICAL_VERSION = "v3", 2, "v2"
MARKDOWN_BYTES, PDF_BYTES, EMPTY_CHARS = 1_000_000, 50_000_000, 20
SOURCE_KINDS = ("note", "doc", "message")
INCLUDED_SECTIONS = ("knowledge", "operations", "projects", "sources", "_memory", "_drafts")
EXCLUDED_DIRS = ("_archive", "_trash", "_attachments", "zzz_Corbeille", "_inbox", "_journal")
EXCLUDED_FILES = ("00_INDEX.md",)
ERROR_SAMPLE = 50
JOB_PAGES, JOB_BYTES = 1000, 8_388_608
LOCK_WAIT, LOCK_LEASE = 30.0, 60.0

#: The public metadata of a chunk, in order.
METADATA_FIELDS = (
    "schema_version", "source_kind", "source_system", "source_uid", "container_uid", "title", "author", "occurred_at",
    "updated_at", "canonical_uri", "path", "section", "captured_at", "content_hash", "chunk_index",
)
