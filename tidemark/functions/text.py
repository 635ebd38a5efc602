"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CorpusError
from .binding import let


def squash(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def join_parts(*parts: Column) -> Column:
    """The parts that aren't empty, squashed, with a blank between."""
    return F.concat_ws(" ", *(F.nullif(squash(p), F.lit("")) for p in parts))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers of two code points or more, in order, repeats kept.

    The text is cut before it is lower-cased, so that folding a capital can't join or part tokens.
    """
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(F.transform(parts, lambda t: F.lower(t)), lambda t: F.char_length(t) >= 2)


def check_window(max_chars: int, overlap: int) -> None:
    if max_chars <= 0:
        raise CorpusError("max_chars must be positive")
    if not 0 <= overlap < max_chars:
        raise CorpusError("overlap must be at least 0 and below max_chars")


#: Windows that start in one part of a text.
PART_WINDOWS = 64


def windows(text: Column, max_chars: int = 512, overlap: int = 0) -> Column:
    """An array of structs (piece, byte_start, byte_end): windows over code points with their UTF-8 byte spans.

    An empty text has no window, and the last window ends with the text.  The text is cut into parts of some windows
    first, so that no window is looked for from the start of the text: the work follows its length.
    """
    check_window(max_chars, overlap)
    step, length = max_chars - overlap, F.char_length(text)
    per_part = max(PART_WINDOWS, -(-max_chars // step))
    total = F.when(length > 0, F.greatest(F.lit(0), F.ceil((length - max_chars) / step)) + 1).otherwise(0).cast("int")
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{per_part * step}}}"), F.lit(0))

    def of_text(whole: Column) -> Column:
        parts = whole["parts"]

        def of_part(part: Column, b: Column) -> Column:
            base = F.aggregate(F.slice(whole["sizes"], F.lit(1), b), F.lit(0).cast("long"), lambda x, y: x + y)
            longer = F.concat(part, F.left(F.coalesce(F.get(parts, b + 1), F.lit("")), F.lit(overlap)))
            count = F.least(F.lit(per_part), whole["total"] - b * per_part)
            indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

            def window(own: Column, j: Column) -> Column:
                start = own["base"] + F.octet_length(F.substring(part, F.lit(1), j * step))
                return let(F.substring(own["longer"], j * step + 1, F.lit(max_chars)), lambda piece: F.struct(piece.alias("piece"), start.alias("byte_start"), (start + F.octet_length(piece)).alias("byte_end")))

            return let(F.struct(base.alias("base"), longer.alias("longer")), lambda own: F.transform(indexes, lambda j: window(own, j)))

        return F.flatten(F.transform(parts, of_part))

    known = let(cut, lambda parts: F.struct(parts.alias("parts"), F.transform(parts, lambda p: F.octet_length(p).cast("long")).alias("sizes"), total.alias("total")))
    return F.when(text.isNotNull(), let(known, of_text))


def label_of(value: Column, mapping: dict[str, str]) -> Column:
    """The mapped label, matched without regard to case; other values pass through as strings."""
    text = F.trim(value.cast("string"))
    out = text
    for key, label in mapping.items():
        out = F.when(F.lower(text) == key, F.lit(label)).otherwise(out)
    return out


def rating_label(rating: Column) -> Column:
    """'False' up to 2 and 'True' above; null and 3, which are ambiguous, become null."""
    whole = F.coalesce(rating.cast("double"), F.lit(3.0)).cast("int")
    return F.when(whole == 3, None).when(whole <= 2, "False").otherwise("True")
