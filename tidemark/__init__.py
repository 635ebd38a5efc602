"""tidemark: retrieval and corpus analytics as Spark DataFrame plans.

    corpus = tidemark.build(chunks, path, embedding_model=..., ...)
    hits = tidemark.open(spark, path).search(queries, k=10)
"""

__version__ = "0.1.0"

_HOME = {
    "build": "corpus", "Corpus": "corpus", "BuildConfig": "pipeline", "Pipeline": "pipeline", "EmbeddingCache": "pipeline",
    "chunk_id": "sources.container", "Container": "sources.container", "CorpusError": "errors", "Manifest": "manifest",
}


def open(spark, path):
    """The corpus at path, a bundle's folder or a container file."""
    from .corpus import Corpus

    return Corpus.open(spark, path)


def __getattr__(name):
    if name not in _HOME:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_HOME[name]}", __name__), name)
