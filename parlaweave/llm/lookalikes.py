"""Visually identical text with different characters (problem 2).

Only strings with a character outside plain Latin text are touched.  They are exploded to positioned
code points under a key of 16 bytes, joined with a table of decompositions and look-alikes, their combining marks ordered by
class, composed again pair by pair and rebuilt.  Both tables come from the Unicode data of Python by rule, so their size is
bounded by Unicode (a few thousand rows) and they can be broadcast whatever the input.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, parallelism

# Letters of other alphabets that look like Latin ones (Greek, Cyrillic, Cherokee, Armenian, Coptic, Lisu); a parameter of the operators.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ӏ": "I", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "һ": "h",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q",
    "ı": "i", "ǃ": "!",
}
# Signs that look like ASCII ones but are no compatibility form of them.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "−": "-", "‗": "_", "∕": "/", "⁄": "/", "∶": ":", "ꞏ": "·", "․": "."}
KEPT = "ªº"
#: What a plain string may be made of, as a Java character class: anything else sends the string through the tables.
PLAIN = "\\x20-\\x7EªºÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏḀ-ẙẜ-ỿ"
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


#: Where characters are assigned that are no ideographs, Hangul syllables or private ones.
_ASSIGNED = [range(0x80, 0x3400), range(0x4DC0, 0x4E00), range(0xA000, 0xAC00), range(0xD7B0, 0xD800), range(0xFB00, 0x20000), range(0xE0000, 0xE0200)]


def plain_pieces(c: str, look_alikes: Mapping[str, str] = LOOK_ALIKES) -> tuple[str, str] | None:
    """(decomposed, decomposed with look-alikes) of one code point, None if it stays as it is."""
    kind, o = unicodedata.category(c), ord(c)
    if c in KEPT or 0xAC00 <= o <= 0xD7A3 or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or kind in ("Co", "Cs", "Cn"):
        return None
    if kind == "Cf" or o in _INVISIBLE or kind == "Cc" and c not in "\t\n\r":
        return "", ""
    if kind == "Zs" or c in "\t\n\r" or kind in ("Zl", "Zp"):
        return " ", " "
    base = "".join(SIGNS.get(x, x) for x in unicodedata.normalize("NFKD", SIGNS.get(c, c)))
    if kind == "Nd" and not base.isascii():
        base = str(unicodedata.digit(c))
    alike = "".join(look_alikes.get(x, x) for x in base)
    return (base, alike) if base != c or alike != c or unicodedata.combining(c) or c in joiners() else None


def character_table(spark: SparkSession, look_alikes: Mapping[str, str] = LOOK_ALIKES) -> DataFrame:
    """``c``, ``plain`` and ``alike``: arrays of (character, combining class); the class is -1 for a letter that joins the one before it."""
    rows = []
    for o in (o for block in _ASSIGNED for o in block):
        if (p := plain_pieces(chr(o), look_alikes)) is not None:
            rows.append((chr(o), *([(x, -1 if x in joiners() else unicodedata.combining(x)) for x in side] for side in p)))
    return spark.createDataFrame(rows, "c string, plain array<struct<ch: string, ccc: int>>, alike array<struct<ch: string, ccc: int>>")


@lru_cache(1)
def compositions() -> dict[str, tuple[str, str]]:
    """What each character that canonical composition makes is made of: (a character, the mark or letter added)."""
    out = {}
    for o in (o for block in [*_ASSIGNED, range(0xAC00, 0xD7A4)] for o in block):
        c, d = chr(o), unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == c:
            out[c] = unicodedata.normalize("NFC", d[:-1]), d[-1]
    return out


@lru_cache(1)
def joiners() -> frozenset[str]:
    """Letters of class 0 that composition joins to the letter right before them."""
    return frozenset(mark for _, mark in compositions().values() if not unicodedata.combining(mark))


def composition_table(spark: SparkSession) -> DataFrame:
    """``base`` and ``made``: a map with what comes of the base, or of a character made from it, and one more mark."""
    table: dict[str, dict[str, str]] = {}
    for c, (first, mark) in compositions().items():
        for base in {unicodedata.normalize("NFD", c)[0], first if 0xAC00 <= ord(first) <= 0xD7A3 else ""} - {""}:  # syllables stay whole
            table.setdefault(base, {})[first + mark] = c
    return spark.createDataFrame(sorted(table.items()), "base string, made map<string, string>")


def composed(base: Column, marks: Column, made: Column) -> Column:
    """A letter with its marks (array of (``ccc``, ..., ``ch``), ordered by class) composed as canonical composition does.

    Mark by mark: one that composes with what the letter has become is taken in, unless a mark left over before it has its class (or is a letter) and blocks it."""
    start = F.struct(base.alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def add(acc: Column, m: Column) -> Column:
        new = F.try_element_at(made, F.concat(acc["s"], m["ch"]))
        free = new.isNotNull() & (acc["last"] < F.greatest(m["ccc"], F.lit(1))) & ((m["ccc"] >= 0) | (acc["rest"] == ""))
        left = F.when(m["ccc"] < 0, 999).otherwise(F.greatest(acc["last"], m["ccc"]))
        return F.struct(F.when(free, new).otherwise(acc["s"]).alias("s"), F.when(free, acc["rest"]).otherwise(F.concat(acc["rest"], m["ch"])).alias("rest"), F.when(free, acc["last"]).otherwise(left).alias("last"))

    return F.aggregate(marks, start, add, lambda acc: F.concat(acc["s"], acc["rest"]))


def foreign(text: Column) -> Column:
    """All letters are of one alphabet that isn't Latin: a name of its own, no disguised Latin one."""
    one = F.lit(False)
    for script in ("IsGreek", "IsCyrillic", "IsArabic", "IsHebrew", "IsArmenian", "IsHan", "IsHangul", "IsHiragana", "IsKatakana", "IsThai", "IsDevanagari", "IsGeorgian", "IsEthiopic"):
        one = one | text.rlike(f"^[\\P{{L}}\\p{{{script}}}]*$")
    return one & text.rlike("\\p{L}")


def _key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _odd(text: Column) -> Column:
    """Whether a text has a character outside plain Latin text."""
    return text.rlike(f"[^{PLAIN}]")


def _rebuilt(odd: DataFrame, look_alikes: Mapping[str, str]) -> DataFrame:
    """``key`` and ``plain`` of the texts ``t`` with something odd in them; a text of which nothing is left has no row."""
    spark = odd.sparkSession
    # a given number of tasks: the texts are few bytes but become many code points; all that follows stays where the key is
    tasks = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    todo = odd.select(_key(F.col("t")).alias("key"), "t").distinct().repartition(tasks, "key").withColumn("alien", foreign(F.col("t")))
    tokens = todo.select("key", "alien", F.posexplode(F.regexp_extract_all("t", F.lit("[\\s\\p{Z}]+|[^\\s\\p{Z}]+"), F.lit(0))).alias("k", "token"))
    genuine = "[\\p{IsGreek}\\p{IsCyrillic}\\p{IsArmenian}\\p{IsCherokee}&&\\p{L}&&[^" + "".join(look_alikes) + "]]"
    keep = F.col("alien") | (~F.col("token").rlike("\\p{IsLatin}") & F.col("token").rlike(genuine) & F.regexp_like("token", F.lit("[\\p{IsGreek}\\p{IsCyrillic}]")))
    points = tokens.select("key", "k", keep.alias("own"), F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("pos", "c"))
    joined = points.join(F.broadcast(character_table(spark, look_alikes)), "c", "left")
    itself = F.array(F.struct(F.col("c").alias("ch"), F.lit(0).alias("ccc")))
    pieces = joined.select("key", "k", "pos", F.posexplode(F.when(F.col("plain").isNull(), itself).when(F.col("own"), F.col("plain")).otherwise(F.col("alike"))).alias("n", "p"))
    order = Window.partitionBy("key").orderBy("k", "pos", "n")
    # a letter begins at a character of class 0, and at a joining one that doesn't stand right behind a letter
    begins = (F.col("p.ccc") == 0) | ((F.col("p.ccc") < 0) & (F.coalesce(F.lag("p.ccc").over(order), F.lit(1)) > 0))
    marked = pieces.withColumn("begins", begins.cast("int")).withColumn("letter", F.sum("begins").over(order))
    letters = marked.groupBy("key", "letter").agg(F.array_sort(F.collect_list(F.struct((1 - F.col("begins")).alias("behind"), F.col("p.ccc").alias("ccc"), "k", "pos", "n", F.col("p.ch").alias("ch")))).alias("m"))
    # marks at the very beginning of a text have no letter
    base, marks = F.when(F.col("letter") > 0, F.col("m")[0]["ch"]).otherwise(""), F.when(F.col("letter") > 0, F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))).otherwise(F.col("m"))
    parts = letters.select("key", "letter", base.alias("base"), marks.alias("marks")).join(F.broadcast(composition_table(spark)), "base", "left")
    whole = F.when(F.size("marks") == 0, F.col("base")).otherwise(composed(F.col("base"), F.col("marks"), F.col("made")))
    built = parts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("letter", whole.alias("s")))), lambda x: x["s"]), "").alias("built"))
    return built.withColumnRenamed("built", "plain")


def plain_rows(rows: DataFrame, text: str, look_alikes: Mapping[str, str] = LOOK_ALIKES) -> DataFrame:
    """``rows`` with the column ``plain`` added (null where the text is null) and ``is_case``: the text isn't in plain form and isn't written wholly in another alphabet.

    Full-width and other compatibility forms, combining accents, look-alike letters, unusual spaces and invisible characters go;
    ª and º, Latin letters with accents as single characters and all signs stay.  A word of another alphabet (no Latin letter in it and at
    least one letter that looks like none), and a string written wholly in one, keep their letters, composed.  The empty string is plain.
    Repeated rows each keep their row; columns of these names that ``rows`` already has are replaced.
    """
    rows = rows.drop("plain", "is_case")
    t = F.col(text)
    easy = rows.where(t.isNull() | ~_odd(t)).withColumn("plain", t).withColumn("is_case", F.lit(False))
    odd = rows.where(_odd(t))
    forms = checkpoint(_rebuilt(odd.select(t.alias("t")), look_alikes)).select(F.col("key").alias("_plain_key"), "plain")
    out = odd.join(forms, _key(t) == F.col("_plain_key"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("plain", F.lit("")).alias("plain"))
    return easy.unionByName(out.withColumn("is_case", (F.col("plain") != t) & ~foreign(t)))


def plain_texts(texts: DataFrame, text: str, look_alikes: Mapping[str, str] = LOOK_ALIKES) -> DataFrame:
    """``text`` and its ``plain`` form, one row for every distinct non-null value (see ``plain_rows``)."""
    return plain_rows(texts.select(text).where(F.col(text).isNotNull()).distinct(), text, look_alikes).select(text, "plain")
