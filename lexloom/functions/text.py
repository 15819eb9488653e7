"""Text functions as expressions that stay in the JVM.

``W`` is the word class used everywhere: letters and numbers of any script and the underscore. Spark's ``\\w`` is
ASCII only, and ``(?U)\\w`` differs from it at the edges.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from html.entities import name2codepoint
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

W = "[\\p{L}\\p{N}_]"
TOKEN = f"{W}+(?:[-.'’]{W}+)*"


def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose to one ASCII letter and marks, and those letters: built from the rule."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if ch == ch.lower() and len(base) == 1 and base != ch and base.isascii():
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()

#: Private-use code points of symbol fonts, and what they show.
SYMBOL_FONT = {
    "\uf020": " ", "\uf0b7": "•", "\uf09f": "•", "\uf0a7": "▪", "\uf0ae": "→", "\uf0ac": "←",
    "\uf0b3": "≥", "\uf0a3": "≤", "\uf0b9": "≠", "\uf0b4": "×", "\uf0b8": "÷", "\uf0de": "⇒",
    "\uf0db": "⇔", "\uf0b1": "±", "\uf0a5": "∞", "\uf0d6": "√", "\uf0e5": "∑", "\uf0ce": "∈",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def where(test: Callable[[Column], Column], c: Column, change: Callable[[Column], Column]) -> Column:
    """``c``, changed where the test holds: what the cheap test of a text rules out needs no regular expression."""
    return F.get(F.transform(F.array(c), lambda t: F.when(test(t), change(t)).otherwise(t)), F.lit(0))


def holds_any(c: Column, parts: Iterable[str]) -> Column:
    """Whether one of the parts is in a text, as it stands."""
    return reduce(or_, [F.contains(c, F.lit(x)) for x in parts])


def norm(c: Column | str) -> Column:
    """Lower case, accents and combining marks removed; ordinal signs stay."""
    return F.regexp_replace(F.translate(F.lower(col(c)), ACCENTED, PLAIN), "\\p{Mn}", "")


def squash(c: Column | str) -> Column:
    """Normalised, only word characters."""
    return F.regexp_replace(norm(c), "[^\\p{L}\\p{N}_]+", "")


def ascii_tokens(c: Column | str) -> Column:
    """Set of ASCII letter-digit tokens of the normalised text."""
    return F.array_distinct(F.regexp_extract_all(norm(c), F.lit("[a-z0-9]+"), F.lit(0)))


def tokens(c: Column | str) -> Column:
    """Tokens with inner hyphens, dots and apostrophes."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def words(c: Column | str) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(col(c), F.lit(f"{W}+"), F.lit(0))


def symbols(c: Column | str) -> Column:
    """Private-use symbols to Unicode."""
    return F.translate(col(c), "".join(SYMBOL_FONT), "".join(SYMBOL_FONT.values()))


def fold_lines(lines: Column | str) -> Column:
    """Join lines by blanks; a hyphen at a line's end disappears if the next line goes on in lower case."""
    whole = F.regexp_replace(F.array_join(col(lines), "\n"), "^\n+", "")
    joined = where(lambda t: F.contains(t, F.lit("-\n")), whole, lambda t: F.regexp_replace(t, "(^|[^ \n])-\n(?=\\p{Ll})", "$1"))
    # single blanks are no matches, as they stay what they are
    return F.trim(F.regexp_replace(joined, "[^\\S ]\\s*| \\s+", " "))


def without_footer(c: Column | str) -> Column:
    """A folded text without the page footer and the loose bullets that conversion leaves at its end."""
    foot = "(\\s*[±•▪]\\s*)*(?<![\\p{L}\\p{N}_])Tipo\\s*[0-9]\\s*[–-]\\s*Branca(?![\\p{L}\\p{N}_]).*$"
    out = where(lambda t: F.contains(t, F.lit("Branca")), col(c), lambda t: F.regexp_replace(t, foot, ""))
    return where(lambda t: holds_any(t, "•▪±·"), out, lambda t: F.regexp_replace(t, "(\\s[•▪±·])+$", ""))


def preview(c: Column | str, n: int = 120) -> Column:
    return F.substring(col(c), 1, n)


def is_acronym(c: Column | str) -> Column:
    """Upper case, with a letter, two characters or more."""
    c = col(c)
    return (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) >= 2)


def is_digits(c: Column | str) -> Column:
    return F.regexp_like(col(c), F.lit("^[0-9]+$"))


def answer(c: Column | str) -> Column:
    """A to E, or ANULADA for any other accepted mark."""
    c = F.upper(col(c))
    return F.when(c.isin(*"ABCDE"), c).otherwise(F.lit("ANULADA"))


def document_text(statement: Column | str, options: Column, sep: str = " ", times: int = 1) -> Column:
    """Statement (``times`` over) and option texts in one string."""
    return F.concat_ws(sep, *[col(statement)] * times, F.array_join(options, sep))


def exam_number(folder: Column | str) -> Column:
    return F.regexp_extract(col(folder), "^([0-9]{2})_", 1)


def exam_slug(folder: Column | str) -> Column:
    return F.regexp_replace(col(folder), "^[0-9]{2}_", "")


def exam_year(folder: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(folder), "-([0-9]{4})(?:-[0-9]+)?$", 1), F.lit("")).cast("int")


def exam_title(slug: Column | str) -> Column:
    return F.translate(F.regexp_replace(col(slug), "-fgv-[0-9]{4}(-[0-9]+)?$", ""), "-", " ")


def exam_shift(slug: Column | str) -> Column:
    return F.when(F.contains(col(slug), F.lit("manha")), "manha").when(F.contains(col(slug), F.lit("tarde")), "tarde")


def exam_type(text: Column | str) -> Column:
    """The digit of the first TIPOn in the beginning of the text, blanks ignored; 1 without one."""
    head = F.upper(F.regexp_replace(F.substring(col(text), 1, 3000), "\\s+", ""))
    return F.coalesce(F.nullif(F.regexp_extract(head, "TIPO([0-9])", 1), F.lit("")).cast("int"), F.lit(1))


def header_type(header: Column | str) -> Column:
    """Exam type that an answer-key header names: by number, by the shift's number, by its colour; else null."""
    c = F.regexp_replace(norm(header), "[^a-z0-9 ]", " ")
    some = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
    return F.coalesce(some("(?:tipo|prova)\\s*([0-9])"), some("\\s([0-9])\\s+turno"), F.when(F.contains(c, F.lit("branca")), 1))


def question_id(exam: Column | str, number: Column | str) -> Column:
    """``NN-nnn``; numbers of four digits are not cut."""
    return F.format_string("%s-%03d", col(exam), col(number))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def display_name(c: Column | str, names: dict[str, str]) -> Column:
    """A name for each listed value; the value itself for others."""
    out = col(c)
    for value, name in names.items():
        out = F.when(col(c) == value, F.lit(name)).otherwise(out)
    return out


def lettered(options: Column | str) -> Column:
    """A map of options as an array of (letra, texto), in the map's order."""
    return F.transform(F.map_entries(col(options)), lambda e: F.struct(e["key"].alias("letra"), e["value"].alias("texto")))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(c: Column | str) -> Column:
    """Unicode normal form C; ASCII texts are as they are."""
    return F.when(F.octet_length(col(c)) == F.char_length(col(c)), col(c)).otherwise(_composed(col(c)))


def today(zone: str = "America/Sao_Paulo", at: Column | None = None) -> Column:
    """The ISO date in a time zone, now or ``at`` a UTC timestamp without zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp()) if at is None else at
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM-dd")


def percent(c: Column | str, digits: int = 1) -> Column:
    """A share as a percentage with fixed digits."""
    return F.format_string(f"%.{digits}f%%", 100 * col(c).cast("double"))


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for those that are none."""
    fine = (code > 0) & ~code.between(0xD800, 0xDFFF) & (code <= 0x10FFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code)), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def unescape(c: Column | str) -> Column:
    """Character references decoded once: decimal, hexadecimal, and the names of HTML 4 with apos; others stay as they are."""
    names = name2codepoint | {"apos": ord("'")}
    known = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(chr(p)) for p in names.values()]))

    def decoded(x: Column) -> Column:
        name = F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0)))
        number = F.coalesce(
            F.regexp_extract(x, "^&#([0-9]+);$", 1).try_cast("long"), F.conv(F.nullif(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).try_cast("long")
        )
        return F.when(~F.rlike(x, F.lit("^&.+;$")), x).when(number.isNotNull(), _character(number)).otherwise(F.coalesce(F.try_element_at(known, name), x))

    parts = F.regexp_extract_all(col(c), F.lit("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&"), F.lit(0))
    return F.when(F.contains(col(c), F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(col(c))
