"""Constants of the container format and of the identifiers made with it.

The layout is an interchange format; the names in it are this library's own.  Files and identifiers of another writer
of the same layout differ in its names only: give them in a JSON file, whose path is in TIDEMARK_NAMES, or to use(),
before anything is built or read:

    {"magic": "4 characters", "chunk_tag": "...", "citation_scheme": "...://", "source_scheme": "...://"}
"""

from __future__ import annotations

import json
import os

#: What chunk identifiers are hashed with, what citations and source URIs begin with, what a container begins with.
CHUNK_TAG = b"tidemark:chunk_id:v1\n"
CITATION_SCHEME = "tidemark://"
SOURCE_SCHEME = "tidemark-source://"
MAGIC = b"TDMK"
VERSION = (1, 0)
FORMAT_VERSION = SCHEMA_VERSION = 1
HEADER_SIZE, ENTRY_SIZE, FOOTER_SIZE, ALIGNMENT = 128, 32, 40, 64
RAW, ZSTD, FLOAT16, INT8 = range(4)
ENCODINGS = {RAW: "raw", ZSTD: "zstd", FLOAT16: "float16", INT8: "int8"}
SECTIONS = {
    1: "chunk_ids", 2: "chunks_canonical", 3: "chunks_original_spans", 4: "embeddings", 5: "provenance", 6: "search_contract",
    7: "hnsw_index", 8: "bm25_index",
}
REQUIRED = tuple(range(1, 7))
EMBEDDINGS = 4
PLACEHOLDER_HASH = "sha256:" + "0" * 64
REPRODUCIBLE_CREATED = "1970-01-01T00:00:00Z"


def names() -> dict[str, str]:
    """The names in use, as use() takes them."""
    return {"magic": MAGIC.decode("latin-1"), "chunk_tag": CHUNK_TAG.decode(), "citation_scheme": CITATION_SCHEME, "source_scheme": SOURCE_SCHEME}


def use(magic: str | None = None, chunk_tag: str | None = None, citation_scheme: str | None = None, source_scheme: str | None = None) -> None:
    """Read and write with other names from here on; tasks get those of the driver."""
    global MAGIC, CHUNK_TAG, CITATION_SCHEME, SOURCE_SCHEME
    if magic is not None:
        if len(magic.encode("latin-1")) != 4:
            raise ValueError("a magic number has four bytes")
        MAGIC = magic.encode("latin-1")
    CHUNK_TAG = CHUNK_TAG if chunk_tag is None else chunk_tag.encode()
    CITATION_SCHEME = CITATION_SCHEME if citation_scheme is None else citation_scheme
    SOURCE_SCHEME = SOURCE_SCHEME if source_scheme is None else source_scheme


if os.environ.get("TIDEMARK_NAMES"):
    with open(os.environ["TIDEMARK_NAMES"], encoding="utf-8") as f:
        use(**json.load(f))
