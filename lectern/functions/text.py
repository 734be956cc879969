"""Text, version and naming functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def tokens(text: Column) -> Column:
    """Lower-cased query tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words of the lexical index: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.WORD), F.lit(0))


def firmware(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, K.FIRMWARE, 1), F.lit(""))


def error_codes(text: Column) -> Column:
    """Codes such as E60 or E-60, upper-cased and without hyphen, in order."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(K.ERROR_CODE), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(K.ERROR_CODE), F.lit(2)).alias("b"))
    return F.transform(found, lambda x: F.upper(F.concat(x["a"], x["b"])))


def codes_in_context(text: Column) -> Column:
    """After a word for error or code: structs of letter (empty if not said) and digits."""
    pattern = F.lit(K.ERROR_CODE_IN_CONTEXT)
    return F.arrays_zip(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.upper).alias("letter"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("digits"))


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def version_parts(version: Column) -> Column:
    """A version as numbers, which compare in order: the digits of each part between dots or hyphens; [0] without any."""
    parts = F.filter(F.transform(F.split(F.replace(F.coalesce(version, F.lit("")), F.lit("-"), F.lit(".")), r"\."), lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(parts, lambda p: F.try_to_number(p, F.lit("999999999")).cast("int"))).otherwise(F.array(F.lit(0)))


def slug(version: Column) -> Column:
    """Lower case, anything but letters and digits as single hyphens, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(version, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def chunk_id(doc_id: Column, version: Column, n: Column) -> Column:
    return F.format_string("%s_%s_c%04d", doc_id, slug(version), n)


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))


def compact_key(model: Column) -> Column:
    return F.array_join(tokens(model), "")


def dotted(line: Column) -> Column:
    return line.rlike("[.]{4,}")


def looks_like_contents(text: Column, ratio: float = 0.35, least_lines: int = 4) -> Column:
    """A page of contents: enough lines, and a share of them with dotted leaders."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= least_lines) & (F.size(F.filter(lines, dotted)) >= ratio * F.size(lines))


def clean_title(title: Column) -> Column:
    """A title that can become a question, without its number; null if it can't."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), K.LEADING_NUMBER, ""), r"^[ .:\-–\t]+|[ .:\-–\t]+$", "")
    t = F.regexp_replace(t, r"(?U)\s{2,}", " ")
    fits = F.length(t).between(*K.TITLE_CHARS) & ~t.rlike(K.NON_PROCEDURAL) & t.rlike(r"\p{L}")
    return F.when(fits, t)


def as_question(title: Column) -> Column:
    """Known acronyms keep their case, other words are lowered."""
    keep = lambda w: F.upper(F.regexp_replace(w, r"^[()\[\]]+|[()\[\]]+$", "")).isin(*K.ACRONYMS)
    said = F.transform(F.filter(F.split(title, r"(?U)\s+"), lambda w: w != ""), lambda w: F.when(keep(w), w).otherwise(F.lower(w)))
    return F.concat(F.lit("Come si esegue: "), F.array_join(said, " "), F.lit("?"))


def preview_name(ids: Column) -> Column:
    return F.substring(F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 8)


def decode_ids(text: Column) -> Column:
    """A JSON list of identifiers; empty if it isn't one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def snippet(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def floor4(x: Column) -> Column:
    return F.floor(x * 10000) / 10000


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def clip(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 4.0) -> Column:
    """A figure's rectangle with a margin, within its page."""
    return F.struct(F.greatest(F.lit(0.0), x0 - margin).alias("x0"), F.greatest(F.lit(0.0), y0 - margin).alias("y0"), F.least(width, x1 + margin).alias("x1"), F.least(height, y1 + margin).alias("y1"))


def prefixed(text: Column, kind: str, model: str) -> Column:
    """Embedding models of the e5 family want `query: ` or `passage: ` ahead of a text."""
    return F.concat(F.lit(f"{kind}: "), text) if "e5" in model.lower() else text


def request_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def is_reply(text: Column) -> Column:
    """Whether an input answers a pending question: a few words, no question mark, no interrogative first."""
    said = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    first = F.regexp_replace(F.lower(F.get(said, F.lit(0))), r"^[,;:]+|[,;:]+$", "")
    return (F.size(said) > 0) & ~text.contains("?") & (F.size(said) <= K.MOST_REPLY_WORDS) & ~first.isin(*K.INTERROGATIVES)


def compose(pending: Column, text: Column) -> Column:
    """The query to ask: the pending question goes ahead of a reply to it."""
    said = F.trim(text)
    return F.when(pending.isNotNull() & (pending != "") & is_reply(said), F.concat(F.regexp_replace(pending, r"[ ?]+$", ""), F.lit(" — "), said)).otherwise(said)


def provenance(doc_id: Column, version: Column, page: Column, section: Column) -> Column:
    """Where a citation comes from, in one line: document, version, page, section; what is null or empty is left out."""
    some = lambda c, ahead: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(ahead), c)).otherwise("")
    return F.concat(doc_id, some(version, " "), F.lit(" · p."), page.cast("string"), some(section, " · "))


def box_label(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle in whole points, halves to the even one."""
    whole = lambda c: F.bround(c).cast("long").cast("string")
    return F.concat(F.lit("bbox ("), whole(x0), F.lit(", "), whole(y0), F.lit(") – ("), whole(x1), F.lit(", "), whole(y1), F.lit(") pt"))
