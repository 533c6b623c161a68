"""Diagnostics turned into a sentence for a reader.  Ladders are tested top down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import arabic_letters, latin_letters, matches


def _ladder(text: Column, rungs: list[tuple[str, str]], start: Column | None = None) -> Column:
    out = start
    for pattern, sentence in rungs:
        hit = matches(text, pattern)
        out = F.when(hit, F.lit(sentence)) if out is None else out.when(hit, F.lit(sentence))
    return out


def fetch_error(raw: Column) -> Column:
    """Why a page could not be read.  Text already mostly Arabic is left as it is."""
    out = F.when(arabic_letters(raw) > latin_letters(raw), raw)
    out = _ladder(raw, L.FETCH_ERRORS, out)
    code = F.regexp_extract(raw, "(?i)HTTP\\s*([0-9]{3})", 1).try_cast("int")
    for exact in (403, 404, 410):
        out = out.when(code == exact, F.lit(L.HTTP_ERRORS[exact]))
    out = out.when(code >= 500, F.lit(L.HTTP_ERRORS["5xx"]))
    out = out.when(code.isNotNull(), F.lit(L.HTTP_ERRORS["other"]))
    return _ladder(raw, L.FETCH_ERRORS_AFTER_HTTP, out).otherwise(F.lit(L.FETCH_ERROR_OTHER))


def verdict_failure(reason: Column) -> Column:
    """Why a page was not judged, and that it will be."""
    return _ladder(F.lower(reason), L.VERDICT_FAILURES).otherwise(F.lit(L.VERDICT_FAILURE_OTHER))


def unwatchable_reason(n_sources: Column, notes: Column) -> Column:
    """Why nothing of an organisation can be watched."""
    out = F.when(n_sources == 0, F.lit(L.UNWATCHABLE_NO_LINK))
    return _ladder(notes, L.UNWATCHABLE, out).otherwise(F.lit(L.UNWATCHABLE_OTHER))
