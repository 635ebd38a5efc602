"""Every way a corpus, a query or a build can be refused, as an exception of its own."""

from __future__ import annotations


class CorpusError(ValueError):
    """Base of all; callers that only know ValueError catch these, too."""


#: Class name -> message; named fields are the exception's arguments and attributes.
_KINDS = {
    "Io": "input or output failed: {detail}",
    "MagicMismatch": "not a corpus file: it begins with {got!r}",
    "UnsupportedVersion": "container version {major}.{minor} is not supported",
    "UnsupportedFormatVersion": "format_version {version} is newer than this reader",
    "UnsupportedSchemaVersion": "schema_version {version} is newer than this reader",
    "InvalidHeaderChecksum": "the header's checksum is wrong",
    "SectionOffsetOutOfBounds": "section {section_id} lies outside the file at {offset}",
    "SectionChecksumMismatch": "the checksum of section {section_id} is wrong",
    "SectionNotFound": "there is no section {section_id}",
    "UnsupportedSectionVersion": "section {section_id} has payload version {version}",
    "UnsupportedSectionEncoding": "section {section_id} can't have encoding {encoding}",
    "SectionMisaligned": "section {section_id} begins at {offset}, not at a multiple of {alignment}",
    "MalformedSectionPayload": "section {section_id} can't be read: {reason}",
    "FooterHashMismatch": "the footer's hash is not that of the body",
    "FileSizeMismatch": "the header says {expected} bytes, the file has {got}",
    "FileTruncated": "the file ends too early",
    "ManifestInvalid": "the manifest is invalid: {detail}",
    "MissingRequiredSection": "required section {name} is missing",
    "EmbeddingSizeMismatch": "embeddings take {got} bytes instead of {expected}",
    "SectionCountMismatch": "section {section_id} holds {got} rows instead of {expected}",
    "UnsupportedDType": "dtype {value!r} is not supported",
    "UnsupportedMetric": "metric {value!r} is not supported",
    "UnsupportedScoreType": "score_type {value!r} is not supported",
    "UnsupportedNormalize": "normalize {value!r} is not supported",
    "UnsupportedIndexType": "index_type {value!r} is not supported",
    "UnsupportedRerankPolicy": "rerank_policy {value!r} is not supported",
    "InvalidModelHash": "model_hash is invalid: {detail}",
    "InvalidEmbeddingValue": "an embedding holds NaN or infinity",
    "Json": "JSON can't be read: {detail}",
    "QueryValidation": "the query is invalid: {detail}",
    "DimensionMismatch": "dim mismatch: expected {expected}, got {got}",
    "InvalidK": "k must be positive, not {k}",
    "EmptyQuery": "the query is empty",
    "ZeroNormQuery": "the query has norm zero",
    "FileNotFound": "no such corpus: {path}",
    "UnexpectedEof": "the payload ends too early",
    "UnsupportedFeature": "not supported: {detail}",
    "InvalidInput": "invalid input: {detail}",
    "InvalidQueryValue": "the query holds NaN or infinity",
}


def _make(name: str, message: str) -> type[CorpusError]:
    import string

    fields = [f for _, f, _, _ in string.Formatter().parse(message) if f]

    def __init__(self, *args, **named):
        values = dict(zip(fields, args)) | named
        for k, v in values.items():
            setattr(self, k, v)
        CorpusError.__init__(self, message.format(**{f: values.get(f, "?") for f in fields}))

    return type(name, (CorpusError,), {"__init__": __init__, "fields": tuple(fields), "__module__": __name__})


ERRORS = {name: _make(name, message) for name, message in _KINDS.items()}
globals().update(ERRORS)
__all__ = ["CorpusError", "ERRORS", *ERRORS]
