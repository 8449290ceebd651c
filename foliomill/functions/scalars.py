"""Scalar rules as column expressions: predicates and functions over boxes, text and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the format -------------------------------------------------------------------------------------
#: Months of a dated stamp.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Signs that make a text look mathematical.
MATH_SIGNS = "[0-9=+−<>√Σ∆δφϕηµενπτ|⌊⌋]"
#: Greek signs that extraction joins with a Latin letter after them.
JOINED_GREEK = "[∆δφϕηνµε]"
#: Units that extraction joins with a letter after them.
JOINED_UNITS = "ns|ms|km|Hz"
JOINED_UNIT = rf"(?U)\b({JOINED_UNITS})(?=[A-Za-z])"
#: Namespace of package ids.
PACKAGE_NAMESPACE = "6d4d259c-105b-5fee-a87a-efd4ad4d9bf8"
PREPRINT_ISSN = "2331-8422"
DPI = 300
# ----------------------------------------------------------------------------------------------------------------------


def width() -> Column:
    return F.col("x1") - F.col("x0")


def height() -> Column:
    return F.col("y1") - F.col("y0")


def is_page_number(text: Column | str = "text") -> Column:
    """Near the foot and nothing but one to four digits (F1)."""
    return (F.col("y0") > 0.74) & F.trim(text).rlike(r"(?U)^\d{1,4}$")


def is_stamp(text: Column | str = "text") -> Column:
    """A long text on its side in a margin (F2)."""
    return ((F.col("x0") < 0.12) | (F.col("x1") > 0.88)) & (F.length(text) >= 12) & ((height() > 2.5 * width()) | (width() < 0.08))


def is_title_candidate() -> Column:
    """F3."""
    signs = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]"))
    return ~is_stamp() & (width() >= 0.18) & (width() >= 2.5 * height()) & (signs >= 3)


def is_full_width() -> Column:
    return (width() >= 0.58) | ((F.col("x0") < 0.46) & (F.col("x1") > 0.46))


def is_wide_prose() -> Column:
    return width() >= 0.45


def is_left() -> Column:
    return (F.col("x0") + F.col("x1")) / 2 < 0.5


def natural_words(text: Column | str = "text") -> Column:
    """Words of three Latin letters or more (H8)."""
    return F.regexp_count(text, F.lit(r"[A-Za-z]{3,}"))


def math_signals(text: Column | str = "text") -> Column:
    return F.regexp_count(text, F.lit(MATH_SIGNS))


def is_math_seed() -> Column:
    """F11."""
    return F.contains("text", F.lit("=")) & (natural_words() <= 2) & (math_signals() >= 3) & (width() >= 0.1)


def _short_tokens(text: Column | str) -> Column:
    """Two letter runs or more; only asked where no run has three letters."""
    return F.regexp_count(text, F.lit("[A-Za-z]+")) >= 2


def is_formula_fragment(text: str = "text") -> Column:
    """No word, no year in brackets, and signs, short tokens or no letter and digit at all."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (natural_words(text) == 0) & ~t.rlike(r"(?U)\(\d{4}\)") & ((math_signals(text) > 0) | _short_tokens(text) | t.rlike(r"^[^A-Za-z0-9]+$"))


def is_quality_fragment(text: str = "text") -> Column:
    """The quality report's variant: no exception for years, no branch for signs alone."""
    return (natural_words(text) == 0) & ((math_signals(text) > 0) | _short_tokens(text))


def heading_level(median: Column) -> Column:
    """0: none, 1 or 2."""
    head = (F.length("text") <= 140) & (F.col("font_size") >= 1.15 * median) & F.col("text").rlike("[A-Za-z]")
    return F.when(~head, 0).when(F.col("text").rlike(r"^[A-Z][0-9]+\."), 2).otherwise(1)


def is_reference_start(text: str = "text") -> Column:
    return F.col(text).rlike(r"^\[[0-9]+\]")


def bbox_is_valid(*at: Column) -> Column:
    x0, y0, x1, y1 = at
    inside = [(c >= 0) & (c <= 1) & ~F.isnan(c) for c in at]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & (x0 < x1) & (y0 < y1), F.lit(False))


def clamped(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area that two boxes share (H7)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def needs_space(left: Column, right: Column) -> Column:
    """Whether two touching runs of a line are parted (H1): only at a capital after a small letter, at a change between Latin and
    other letters, and between a digit and a word of two characters or more."""
    a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    case = a.rlike(r"^\p{Ll}$") & b.rlike(r"^\p{Lu}$")
    script = a.rlike(r"^\p{L}$") & b.rlike(r"^\p{L}$") & (a.rlike("^[A-Za-z]$") != b.rlike("^[A-Za-z]$"))
    digit = a.rlike(r"^[\p{Nd}⁰¹²³⁴-⁹₀-₉]$") & b.rlike(r"^\p{L}$") & (F.length(right) > 1)
    return ~a.rlike(r"^[(\[{]$") & (a != "") & (b != "") & (case | script | digit)


def repaired_spacing(text: Column) -> Column:
    """Spaces that extraction lost (H2), without a lexicon: `aAB`, Greek before Latin, a unit before a letter."""
    t = F.regexp_replace(text, "(?<=[a-z])(?=[A-Z][A-Z])", " ")
    t = F.regexp_replace(t, f"(?<={JOINED_GREEK})(?=[A-Za-z])", " ")
    return F.regexp_replace(t, JOINED_UNIT, "$1 ")


def has_joined_unit(text: Column) -> Column:
    """Whether repaired_spacing would part more: of units in a row it parts one each time."""
    return text.rlike(JOINED_UNIT)


def joined_lines(text: Column, following: Column) -> Column:
    """Two lines as one text (H3), without a lexicon: no hyphen is soft."""
    word = F.lower(F.regexp_extract(following, r"(?U)^\s*(\S+)", 1))
    hyphen = text.endswith("-")
    whole = F.when(text == "", "").when(hyphen & word.isin("and", "or"), " ").when(hyphen & word.rlike("^(and|or)-"), "").when(hyphen & following.rlike(r"^\p{Ll}"), "").otherwise(" ")
    return repaired_spacing(F.trim(F.regexp_replace(F.concat(text, whole, following), r"(?U)\s+", " ")))


def name_parts(name: Column) -> tuple[Column, Column]:
    """(given names, surname): the last token is the surname."""
    t = F.trim(name)
    surname = F.regexp_extract(t, r"([^\s]+)$", 1)
    return F.trim(F.regexp_replace(t, r"[^\s]+$", "")), surname


def labelled(text: Column, kind: str) -> tuple[Column, Column]:
    """(label, rest) of affiliations and references."""
    pattern = {"affiliation": r"^([0-9]+)\s*(.*)$", "reference": r"^\[([0-9]+)\]\s*(.*)$"}[kind]
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def stamp_date(text: Column) -> Column:
    """(day, month, year) of the first date of a stamp as one text without padding; null if there is none."""
    pattern = r"(?U)\b(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(F.regexp_extract(text, pattern, 2)))
    day, year = (F.regexp_extract(text, pattern, i).try_cast("int").cast("string") for i in (1, 3))
    return F.when(month > 0, F.concat(day, month.cast("string"), year))


def preprint_id(text: Column) -> Column:
    """H13."""
    found = F.regexp_extract(text, r"(?:arXiv:)?([0-9]{4}\.[0-9]{4,5}v[0-9]+)", 1)
    return F.when(found != "", found)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5, from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3) + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit values differ."""
    return F.bit_count(a.bitwiseXOR(b))


def page_image(source: Column, page: Column) -> Column:
    """H23."""
    return F.concat(F.lit("assets/evidence/pages/"), source, F.lit("/page-"), F.lpad(page.cast("string"), 6, "0"), F.lit(".png"))


def logical_page(page: Column) -> Column:
    return F.concat(F.lit("lp-"), F.lpad(page.cast("string"), 6, "0"))


def pixels_match(pt: Column, px: Column, dpi: int = DPI) -> Column:
    """Within one pixel."""
    return F.abs(pt * dpi / 72 - px) <= 1


def is_safe_path(path: Column) -> Column:
    """F18."""
    return (path != "") & ~F.contains(path, F.lit("\\")) & ~path.startswith("/") & ~F.concat(F.lit("/"), path, F.lit("/")).contains("/../")


def is_package_path(path: Column) -> Column:
    return path.rlike(r"^[a-z0-9._-]+(/[a-z0-9._-]+)*$") & is_safe_path(path)


#: Media types by file ending.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "pdf": "application/pdf", "xml": "application/xml", "json": "application/json", "html": "text/html", "txt": "text/plain", "mp4": "video/mp4", "mp3": "audio/mpeg", "wav": "audio/x-wav"}


def mime_of(path: Column) -> Column:
    """H24; null for endings that are not known."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ending)


def is_public_url(url: Column) -> Column:
    """http or https, a host without credentials, not localhost and no address that is not global."""
    m = r"^(https?)://([^/?#]*)"
    scheme, at = F.regexp_extract(url, m, 1), F.regexp_extract(url, m, 2)
    host = F.lower(F.regexp_replace(at, r":[0-9]*$", ""))
    named = (host != "") & ~F.contains(at, F.lit("@")) & (host != "localhost") & ~host.endswith(".localhost")
    octet = [F.regexp_extract(host, r"^([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", i).try_cast("int") for i in range(1, 5)]
    a, b, c, _ = octet
    local = (a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
             | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))
    six = F.regexp_extract(host, r"^\[([0-9a-f:.]+)\]$", 1)
    global_six = six.rlike("^[23]") & ~six.startswith("2001:db8") & ~six.rlike("^2001:0?:") & ~six.startswith("2002:")
    ok = F.when(six != "", global_six).otherwise(~F.coalesce(local, F.lit(False)) & ~host.startswith("["))
    return F.coalesce((scheme != "") & named & ok, F.lit(False))


def toc_level(depth: Column) -> Column:
    """At most four."""
    return F.least(depth + 1, F.lit(4))


def report_tone(valid: Column, statuses: Column) -> Column:
    """Good, bad or warn."""
    return F.when(valid, "good").when(F.exists(statuses, lambda s: s == "failed"), "bad").otherwise("warn")
