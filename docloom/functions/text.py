"""Column functions for text: white space, folding, tokens, stable hashes and windows. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import rules

SEPARATOR = "\x1f"
_SPACES = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"


def _accents() -> tuple[str, str]:
    """Letters with marks that decompose to one base letter, and the base letters; built from Unicode, not listed."""
    import unicodedata

    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source) + "đĐ", "".join(target) + "dD"


ACCENTED, PLAIN = _accents()


def strip_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, and both ends are stripped."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def normalize(c: Column) -> Column:
    """Lower case with single spaces; a null counts as empty."""
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def strip_accents(c: Column) -> Column:
    """Letter by letter, so lengths and offsets stay."""
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    return strip_accents(normalize(c))


def fold_place(c: Column) -> Column:
    """Folded, with punctuation as spaces, and with the unit words mended that a space splits."""
    out = squeeze(F.regexp_replace(fold(c), r"(?U)[^\w\s]", " "))
    for split, unit in rules.SPLIT_UNITS.items():
        out = F.regexp_replace(out, rf"(?U)(?<!\w){split}(?!\w)", unit)
    return out


def blank(c: Column) -> Column:
    return F.nullif(strip_space(c.cast("string")), F.lit(""))


def first_present(*columns: Column, default: str | None = None) -> Column:
    """The first that is neither null nor blank, stripped."""
    return F.coalesce(*[blank(c) for c in columns], F.lit(default).cast("string"))


def tokens(c: Column) -> Column:
    """Words of the normalized text, hyphens being spaces."""
    return F.filter(F.split(normalize(F.regexp_replace(c, "-", " ")), " "), lambda x: x != "")


def words(c: Column) -> Column:
    """Word characters in runs, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"(?U)(\w+)"), 1)


def marker_family(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+$", "")


def number_suffix(c: Column) -> Column:
    """Trailing digits as text, or null."""
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit(""))


def numeric_suffix(c: Column) -> Column:
    """Trailing digits as a number; exact to 38 digits and null beyond."""
    return number_suffix(c).try_cast("decimal(38,0)")


def initial_letter(c: Column) -> Column:
    """The first letter, upper case and without marks; Đ stays."""
    first = F.upper(F.regexp_extract(c, r"(\p{L})", 1))
    return F.when(first == "Đ", first).otherwise(strip_accents(first))


def marker_value(c: Column) -> Column:
    """A marker without white space, or null if it does not follow the grammar."""
    bare = F.regexp_replace(c, _SPACES, "")
    ordinal = r"([1-9]\d*)?"
    grammar = rf"^(NLQ\d+|NLC\d+|([A-ZĐ]\.){{1,5}}[A-ZĐ]{ordinal}|[IVX]{{2,6}}|(Th|Ph|Tr|Ng|Ch|Kh|Nh){ordinal}|[A-ZĐ]{ordinal})$"
    return F.when(bare.rlike(grammar), bare)


def stable_hash(seed: str | Column, *parts: Column) -> Column:
    """Hex SHA-256 of the seed and the parts, joined by unit separators."""
    first = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    return F.sha2(F.concat_ws(SEPARATOR, first, *[p.cast("string") for p in parts]), 256)


def stable_u64(seed: str | Column, *parts: Column) -> Column:
    """The first eight bytes of the stable hash, as a decimal(20,0)."""
    return F.conv(F.substring(stable_hash(seed, *parts), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_slot(size: int, seed: str | Column, *parts: Column) -> Column:
    return (stable_u64(seed, *parts) % F.lit(size)).cast("int")


def below_ratio(u64: Column, ratio: float) -> Column:
    """Whether u64 / 2^64 < ratio, compared as whole numbers."""
    from fractions import Fraction
    from math import ceil

    return u64 < F.lit(str(ceil(Fraction(str(ratio)) * 2**64))).cast("decimal(20,0)")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def left_of(text: Column, start: Column, most: int) -> Column:
    """Up to ``most`` characters before ``start``, which counts code points from 0."""
    return F.substring(text, F.greatest(start - most, F.lit(0)) + 1, F.least(start, F.lit(most)))


def right_of(text: Column, end: Column, most: int) -> Column:
    return F.substring(text, end + 1, F.lit(most))


def marked_context(text: Column, start: Column, end: Column, window: int = 160) -> Column:
    """The mention in tags with up to ``window`` characters on either side."""
    return F.concat(left_of(text, start, window), F.lit("[MENTION]"), F.substring(text, start + 1, end - start), F.lit("[/MENTION]"), right_of(text, end, window))


def paragraph_context(text: Column, start: Column, end: Column, most: int = 900) -> Column:
    """The mention in tags with its paragraph, up to ``most`` characters in all beside it."""
    left = F.element_at(F.split(left_of(text, start, most // 2), "\n", -1), -1)
    right = F.element_at(F.split(right_of(text, end, most // 2), "\n", -1), 1)
    return F.concat(left, F.lit("[MENTION]"), F.substring(text, start + 1, end - start), F.lit("[/MENTION]"), right)


def split_context(context: Column) -> Column:
    """(left, mention, right) of a context with tags."""
    left = F.split_part(context, F.lit("[MENTION]"), F.lit(1))
    rest = F.split_part(context, F.lit("[MENTION]"), F.lit(2))
    return F.struct(left.alias("left"), F.split_part(rest, F.lit("[/MENTION]"), F.lit(1)).alias("mention"), F.split_part(rest, F.lit("[/MENTION]"), F.lit(2)).alias("right"))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def highlight(context: Column) -> Column:
    """A context with tags as HTML that marks the mention."""
    return F.replace(F.replace(escape_html(context), F.lit("[MENTION]"), F.lit("<mark>")), F.lit("[/MENTION]"), F.lit("</mark>"))


def text_only(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return squeeze(F.regexp_replace(bare, r"<[^>]*>", " "))
