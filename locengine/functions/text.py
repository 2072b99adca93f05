"""Predicates, trimming, splitting and width of text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression class.
WS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


@dataclass(frozen=True)
class Profile:
    """Source script, as the insides of regular-expression classes.

    ``script``: characters that make a text translatable. ``token``: characters of a
    diagram token. ``leak``: characters that must not remain in a translation.
    ``ends``: sentence ends.
    """

    name: str
    script: str
    token: str
    leak: str
    ends: str


# Unicode ranges. `script` leaves out U+30FB and U+30FC, which are kept in
# translations as visual marks; the other marks (circles, squares, stars, U+3007,
# U+3000) are outside the ranges anyway.
PROFILES = {
    "ja": Profile(
        name="ja",
        script=r"\x{3040}-\x{309F}\x{30A0}-\x{30FA}\x{30FD}-\x{30FF}\x{4E00}-\x{9FFF}"
        r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF5A}\x{FF65}-\x{FF9F}",
        token=r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}"
        r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF5A}\x{FF65}-\x{FF9F}",
        leak=r"\x{3040}-\x{309F}\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}\x{4E00}-\x{9FFF}"
        r"\x{3400}-\x{4DBF}",
        ends="。！？",
    ),
    "accent": Profile(
        name="accent",
        script="À-ÖØ-öø-ÿ",
        token="À-ÖØ-öø-ÿ",
        leak="À-ÖØ-öø-ÿ",
        ends=".!?",
    ),
}


def profile(p: str | Profile) -> Profile:
    return p if isinstance(p, Profile) else PROFILES[p]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def is_ascii(c: Column) -> Column:
    """All script and letter classes below lie outside ASCII, and comparing two lengths is
    far cheaper than a search that finds nothing."""
    return F.octet_length(c) == F.length(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def has_script(c: Column, p: str | Profile = "ja") -> Column:
    return F.coalesce(~is_ascii(c) & c.rlike(f"[{profile(p).script}]"), F.lit(False))


def has_leak(c: Column, p: str | Profile = "ja") -> Column:
    return F.coalesce(~is_ascii(c) & c.rlike(f"[{profile(p).leak}]"), F.lit(False))


# How texts begin that are addresses or formulas, and the characters of texts that
# are only numbers. Digits and word characters are the Unicode ones.
ADDRESSES = ("https?://", "[a-zA-Z0-9._%+-]+@")
FORMULA = r"=[\p{L}\p{N}_]+\("
NUMERIC = rf"\p{{Nd}}{WS}.,:%/+\-×÷()"
_SKIP = rf"^[{WS}]*+(?:{'|'.join(ADDRESSES)}|{FORMULA}|[{NUMERIC}]+$)"


def is_translatable(c: Column, p: str | Profile = "ja") -> Column:
    """Whitespace around the text does not matter: it is in no script, and passed over before
    what is skipped, which is cheaper than trimming the text for each test."""
    return has_script(c, p) & ~F.coalesce(c.rlike(_SKIP), F.lit(False))


def token_pattern(p: str | Profile = "ja") -> str:
    t = profile(p).token
    return rf"[{t}]+(?:[{WS}]*[{t}]+)*"


# ---- tags -----------------------------------------------------------------------------

TAG = r"</?tag[0-9]+>"
TAG_ANY = r"</?tag[0-9]+/?>"


def strip_tags(c: Column, self_closing: bool = False) -> Column:
    return F.regexp_replace(c, TAG_ANY if self_closing else TAG, "")


def tag_list(c: Column, self_closing: bool = False) -> Column:
    pattern = TAG_ANY if self_closing else TAG
    return F.array_sort(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def tags_match(source: Column, target: Column, self_closing: bool = False) -> Column:
    return F.coalesce(
        tag_list(source, self_closing) == tag_list(target, self_closing), F.lit(False)
    )


# ---- splitting ------------------------------------------------------------------------


def line_array(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    unix = F.when(c.contains("\r"), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)
    body = F.when(unix.endswith("\n"), F.left(unix, F.length(unix) - 1)).otherwise(unix)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def sentence_pieces(c: Column, max_chars: int, p: str | Profile = "ja") -> Column:
    """Whole sentences packed greedily into pieces of at most ``max_chars``.

    Whitespace after a sentence end is dropped. One regular expression does the packing:
    the longest prefix within the limit that stops at a sentence end, or else one
    over-long sentence.
    """
    ends = profile(p).ends
    joined = F.regexp_replace(c, rf"(?<=[{ends}])[{WS}]+", "")
    pieces = F.regexp_extract_all(
        joined,
        F.lit(rf"(?s).{{1,{max_chars}}}(?:(?<=[{ends}])|\z)|.+?(?:[{ends}]|\z)"),
        F.lit(0),
    )
    return F.when(F.length(c) <= max_chars, F.array(c)).otherwise(
        F.transform(pieces, strip_ws)
    )


def chunk_text(c: Column, max_chars: int = 3000, p: str | Profile = "ja") -> Column:
    """Lossless chunks of at most ``max_chars``, cut after the last sentence end or
    newline of the window, or hard at the limit when there is none."""
    ends = profile(p).ends
    before = f".{{0,{max_chars - 1}}}"
    pattern = (
        rf"(?s).{{1,{max_chars}}}\z|{before}[{ends}\n]|.{{{max_chars}}}"
    )
    return F.coalesce(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")
    )


# ---- locations ------------------------------------------------------------------------

_LOCATION = r"^(?:(.*):)?(line|p|si|is|sheet)\[([0-9]+)\](?:\[p([0-9]+)\])?$"


def line_location(idx: Column) -> Column:
    return F.concat(F.lit("line["), idx.cast("string"), F.lit("]"))


def parse_location(c: Column) -> Column:
    """``part``, ``kind``, ``ordinal`` and ``piece`` of a location; null when absent."""

    def group(n: int) -> Column:
        value = F.regexp_extract(c, _LOCATION, n)
        return F.when(value == "", F.lit(None)).otherwise(value)

    return F.struct(
        group(1).alias("part"),
        group(2).alias("kind"),
        group(3).cast("int").alias("ordinal"),
        group(4).cast("int").alias("piece"),
    )


# ---- width ----------------------------------------------------------------------------

ZERO_CLASS = (
    r"\x{00}-\x{1F}\x{7F}-\x{9F}\p{Mn}\p{Me}\p{Mc}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}"
    r"\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
    r"\x{FFF9}-\x{FFFB}\x{1160}-\x{11FF}\x{D7B0}-\x{D7FF}"
)


def _wide_class() -> str:
    """Ranges of the code points whose East Asian width is wide or fullwidth."""
    ranges: list[list[int]] = []
    for cp in range(0x1100, 0x40000):
        ch = chr(cp)
        if unicodedata.east_asian_width(ch) not in ("W", "F"):
            continue
        if unicodedata.category(ch) in ("Mn", "Me", "Mc"):
            continue
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    # Largest ranges first: a class is tested range by range.
    ranges.sort(key=lambda r: r[0] - r[1])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


WIDE_CLASS = _wide_class()
# Characters of width one that make up most Latin text; only the others are classified.
_PLAIN = r"[\x20-\x7E\x{A0}-\x{2FF}]+"


def visual_width(c: Column) -> Column:
    rest = F.regexp_replace(c, _PLAIN, "")
    return (
        F.length(c)
        + F.regexp_count(rest, F.lit(f"[{WIDE_CLASS}]"))
        - F.regexp_count(rest, F.lit(f"[{ZERO_CLASS}]"))
    )


def truncate_width(c: Column, n: int) -> Column:
    """Longest prefix that is at most ``n`` columns wide."""

    def step(acc: Column, ch: Column) -> Column:
        width = (
            F.when(ch.rlike(_PLAIN), 1)
            .when(ch.rlike(f"[{WIDE_CLASS}]"), 2)
            .when(ch.rlike(f"[{ZERO_CLASS}]"), 0)
            .otherwise(1)
        )
        fits = acc["open"] & (acc["used"] + width <= n)
        return F.struct(
            F.when(fits, acc["used"] + width).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["kept"] + 1).otherwise(acc["kept"]).alias("kept"),
            fits.alias("open"),
        )

    # No more than n characters that take room can be kept, so only that prefix is measured.
    head = F.regexp_extract(
        c, f"^[{ZERO_CLASS}]*+(?:[^{ZERO_CLASS}][{ZERO_CLASS}]*+){{0,{n}}}+", 0
    )
    kept = F.aggregate(
        F.split(head, ""),
        F.struct(
            F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open")
        ),
        step,
        lambda acc: acc["kept"],
    )
    plain = c.substr(F.lit(1), F.lit(n + 1)).rlike(rf"^{_PLAIN}\z")
    return F.when(plain, c.substr(F.lit(1), F.lit(n))).otherwise(c.substr(F.lit(1), kept))


# ---- spacing and line prefixes --------------------------------------------------------

_FOREIGN = r"[\p{L}&&[^\x00-\x7F]]"
# Every boundary is before a capital or digit; that is looked at first.
_BOUNDARY = (
    r"(?=[\p{IsUppercase}0-9])(?:"
    # accented word, then an ASCII capital or digit
    rf"(?=[A-Z0-9])(?<=\p{{IsLowercase}})(?<={_FOREIGN}.{{0,2}})"
    # ASCII word, then an accented capital
    r"|(?<=[A-Za-z])(?=[\p{IsUppercase}&&[^\x00-\x7F]])"
    # ASCII capital in an ASCII word, then a capitalised word with an accent near its start
    rf"|(?<=[A-Z])(?<!{_FOREIGN}.{{0,3}})(?=[A-Z].{{0,2}}{_FOREIGN}))"
)


# Fixed value: what follows the capital that begins a word, in ASCII and accented.
_WORD_GOES_ON = "a-zà-ỹ"


def split_abbreviation(c: Column) -> Column:
    """A space where an abbreviation of two or more capitals runs into a capitalised word."""
    return F.regexp_replace(c, f"(?<=[A-Z]{{2}})(?=[A-Z][{_WORD_GOES_ON}])", " ")


def fix_spacing(c: Column) -> Column:
    """Insert the missing space between accented and ASCII words."""
    return F.when(is_ascii(c), split_abbreviation(c)).otherwise(
        F.regexp_replace(split_abbreviation(c), f"(?s){_BOUNDARY}", " ")
    )


# Markdown prefixes that a line keeps.
MD_PREFIX = r"^(?:### |## |# |- |\* |> )"
MD_HEADING = "^(?:### |## |# )"


def clean_translation(translated: Column, prefix: Column) -> Column:
    """Remove pipes and markdown prefixes that the model added to a line.

    One prefix is removed in any case. After that a line with a prefix loses a repetition
    of it and one further prefix, and a line without loses one further heading mark.
    """
    no_tail = F.regexp_replace(translated, rf"[{WS}]*\|\z", "")
    no_head = F.regexp_replace(no_tail, rf"^\|[{WS}]*", "")

    def again(once: Column) -> Column:
        repeated = F.regexp_replace(once, f"{MD_PREFIX}(?:{MD_PREFIX[1:]})?", "")
        return (
            F.when(prefix == "", F.regexp_replace(once, MD_HEADING, ""))
            .when(once.startswith(prefix), repeated)
            .otherwise(F.regexp_replace(once, MD_PREFIX, ""))
        )

    return let(F.regexp_replace(no_head, MD_PREFIX, ""), again)


def rebuild_line(raw: Column, translated: Column) -> Column:
    """Translated line with the indent and markdown prefix of the original line."""

    def line(left: Column, prefix: Column) -> Column:
        indent = F.repeat(F.lit(" "), F.length(raw) - F.length(left))
        return F.concat(
            indent, prefix, let(clean_translation(translated, prefix), fix_spacing)
        )

    return let(
        F.ltrim(raw, F.lit(WHITESPACE)),
        lambda left: let(F.regexp_extract(left, MD_PREFIX, 0), lambda p: line(left, p)),
    )
