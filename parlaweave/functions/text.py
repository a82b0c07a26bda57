"""Column expressions over text.  All stay in the JVM; regular expressions are Unicode-aware by flag."""

from __future__ import annotations

import colorsys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LATIN = [(c, d[0]) for o in range(0xC0, 0x250) for c in [chr(o)] for d in [unicodedata.normalize("NFD", c)] if len(d) > 1 and d[0].isascii()]
# Titles a name may begin with, and month names of dates.
TITLES = ["sr", "sra", "dr", "dra", "deputado", "deputada", "senador", "senadora", "presidente"]
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def ascii_fold(c: Column) -> Column:
    """Latin letters without their accents, single characters or marks of their own; other characters stay."""
    return F.regexp_replace(F.translate(c, "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN)), r"\p{Mn}+", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparison_form(c: Column) -> Column:
    """Lower case, without ``. , ; : ! ? ( ) " \\``, white space collapsed."""
    return squeeze(F.regexp_replace(F.lower(c), r'[.,;:!?()"\\]', ""))


# A party and the state it is of, in a text whose white space is collapsed.
_PARTY_OF_STATE = "[A-Z][A-Z]+ ?- ?[A-Z][A-Z]"


def name_key(c: Column, faithful: bool = False) -> Column:
    """The key under which spellings of a name meet; null if fewer than two characters are left.

    Strips a trailing party and state, a bracketed one, one leading title, accents, case and punctuation.  By default a party and
    state after a plain space go too, and a bloc of several words in the bracket; ``faithful`` keeps them, as only dash and slash, and a bloc of one word, count there."""
    dash, bloc = (" ?[-/] ?", "[\\p{L}\\p{N}_]+") if faithful else ("(?: ?[-/] ?| )", "[^()/]*")
    tail, bracket = f"{dash}{_PARTY_OF_STATE} ?[)]? ?$", rf"(?i) ?[(](?:{bloc}/)?[A-Z]+ ?- ?[A-Z][A-Z][)] ?$"
    x = squeeze(c)
    for part in (tail, bracket) if faithful else (bracket, tail):  # a bracket whose end went first no longer is one
        x = F.trim(F.regexp_replace(x, part, ""))
    x = F.trim(F.regexp_replace(x, rf"(?iu)^(?:{'|'.join(TITLES)})[.]? +", ""))
    x = squeeze(F.regexp_replace(F.lower(ascii_fold(x)), r'[.,;:!?()"\\]', ""))
    return F.when(F.length(x) >= 2, x)


def without_tags(c: Column) -> Column:
    """Without tags made of ASCII capitals only."""
    return F.regexp_replace(c, r"</?[A-Z]+>", "")


def without_person_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"</?PESSOA(?::[^>]*)?>", "")


def is_speaker(c: Column) -> Column:
    return c.startswith("A SRA.") | c.startswith("O SR.")


def year_of(c: Column, start: int = 20, stop: int = 200, first: int = 2010, last: int = 2025) -> Column:
    """First whole-word year of a range in the characters [start, stop); null if there is none."""
    years = "|".join(str(y) for y in range(first, last + 1))
    return F.nullif(F.regexp_extract(F.substring(c, start + 1, stop - start), rf"(?:^|[^0-9A-Za-z_])({years})(?:[^0-9A-Za-z_]|$)", 1), F.lit("")).cast("int")


def date_phrase(c: Column) -> Column:
    """``d de month de yyyy`` after ``Em``; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"Em (\d{1,2}[ºª]? de [a-zA-Zç]+ de \d{4})", 1), F.lit(""))


def phrase_date(c: Column) -> Column:
    """A date phrase as a date."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, r"de ([a-zA-Zç]+) de", 1)))
    text = F.concat_ws("-", F.regexp_extract(c, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, r"^(\d{1,2})", 1), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def type_of_title(c: Column) -> Column:
    """First word of the part behind the one that is an ordinal alone, the parts being set off by dashes; null if there is none."""
    parts = F.split(squeeze(c), " ?- ")
    at = F.array_position(F.transform(parts, lambda x: x.rlike("^[0-9]+[ªº]$")), True)
    return F.when(at > 1, F.nullif(F.regexp_extract(F.get(parts, at.cast("int")), r"^[\p{L}\p{N}_]+", 0), F.lit("")))


def ordinal_type(c: Column) -> Column:
    """The middle part of ``<n>ª <kind> - TYPE - Em ...``."""
    return F.nullif(F.trim(F.regexp_extract(c, r"^\d+[ªº] [^-]+ - (.+) - Em ", 1)), F.lit(""))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def span(text: Column, start: Column, end: Column) -> Column:
    """Code points [start, end)."""
    return F.substring(text, start + 1, end - start)


def nfc(c: Column) -> Column:
    """Canonical composition, in Arrow batches: there is no built-in function for it."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))

    return run(c)


def cleaned(c: Column) -> Column:
    """Composed text without tags of capitals."""
    return without_tags(nfc(c))


def mend_tags(c: Column, tag: str = "PESSOA") -> Column:
    """Square-bracket annotations that were put around twice, or that stand empty on both sides of a text, as one annotation of it."""
    opening = rf"\[{tag}:"
    once = F.regexp_replace(c, rf"(?s){opening}{opening}(.*?)\]\]", f"[{tag}:$1]")
    return F.regexp_replace(once, rf"(?s){opening}\](.*?){opening}\]", f"[{tag}:$1]")


def first_line(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(c, "\n", 1), r"\r$", "")


def second_line_type(c: Column) -> Column:
    """The second line without white space around it and without its last character (a colon); null if there is no second line."""
    line = F.regexp_replace(F.get(F.split(c, "\n"), F.lit(1)), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(line) > 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def base_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def label_or(label: Column, ident: Column, index: Column) -> Column:
    """The label of a vertex, or its id, or its number."""
    return F.coalesce(F.nullif(label.cast("string"), F.lit("")), F.nullif(ident.cast("string"), F.lit("")), index.cast("string"))


def palette(n: int) -> list[str]:
    """``n`` colours as hex: hues a golden section apart, two saturations by threes, two brightnesses in turn."""
    section = 0.618033988749895
    shades = [colorsys.hsv_to_rgb(k * section % 1, (0.7, 0.9)[k // 3 % 2], (0.8, 0.7)[k % 2]) for k in range(n)]
    return ["#" + "".join(f"{round(255 * x):02x}" for x in shade) for shade in shades]
