"""Comparing personal names: folding, edit distance, initials, nicknames."""

from __future__ import annotations

import re
import unicodedata

PARTICLES = {"de", "da", "do", "dos", "das", "e", "di", "del"}
GENERATION = {"filho", "neto", "junior", "jr", "sobrinho", "segundo"}
# Portuguese short forms that are neither a beginning, an end nor a diminutive of the name.
NICKNAMES = {
    "ze": {"jose"}, "zeca": {"jose"}, "zezinho": {"jose"}, "zeze": {"jose"}, "joca": {"joao", "jose"}, "juca": {"jose"}, "janjao": {"joao"},
    "chico": {"francisco"}, "chiquinho": {"francisco"}, "chica": {"francisca"}, "chiquinha": {"francisca"}, "quinha": {"francisca"}, "quinzinho": {"joaquim"},
    "cida": {"aparecida"}, "cidinha": {"aparecida"}, "cidoca": {"aparecida"}, "ro": {"rosangela", "rogerio"}, "rosinha": {"rosangela"}, "janda": {"jandira"},
    "tiao": {"sebastiao"}, "bastiao": {"sebastiao"}, "mundinho": {"raimundo"}, "mundico": {"raimundo"}, "dudu": {"eduardo"}, "duda": {"eduardo"}, "edu": {"eduardo"},
    "beto": {"roberto", "alberto"}, "betinho": {"roberto", "alberto"}, "dito": {"benedito"}, "bene": {"benedito"}, "mane": {"manoel"}, "maneco": {"manoel"}, "neco": {"manoel"}, "nequinho": {"manoel"},
    "caca": {"carlos"}, "carlinhos": {"carlos"}, "guto": {"augusto"}, "toninho": {"antonio"}, "tonho": {"antonio"}, "tonico": {"antonio"}, "totonho": {"antonio"}, "toninha": {"antonia"}, "tonia": {"antonia"},
    "lena": {"helena"}, "leninha": {"helena"}, "tete": {"terezinha"}, "teca": {"terezinha"}, "zinha": {"terezinha"}, "teresa": {"terezinha"}, "quincas": {"joaquim"}, "maga": {"margarida"}, "pati": {"patricia"}, "gabi": {"gabriela"}, "fefe": {"fernanda"}, "lele": {"helena", "leandro", "leoncio"}, "nelsinho": {"nelson"}, "marquinhos": {"marcos"}, "marquito": {"marcos"},
    "lu": {"luiz", "luzia", "lucia", "lucas"}, "lulu": {"luiz", "luzia", "lucia"}, "bia": {"beatriz"}, "bibi": {"beatriz"}, "cica": {"cecilia"}, "cissa": {"cecilia"}, "vivi": {"vitoria"}, "guida": {"margarida"}, "ceicao": {"conceicao"}, "ceica": {"conceicao"},
    "cacau": {"claudio"}, "lelo": {"aurelio"}, "lelio": {"aurelio"}, "tavinho": {"otavio"}, "tavo": {"otavio"}, "binho": {"fabio", "rubens"}, "rubinho": {"rubens"}, "deda": {"ademar"}, "dema": {"ademar"}, "cacilda": {"cecilia"},
    "nono": {"leoncio"}, "nana": {"ana"}, "pepe": {"jose", "pedro"}, "pedrinho": {"pedro"}, "kel": {"raquel"}, "quel": {"raquel"}, "sisi": {"simone"}, "mona": {"monica"}, "nina": {"antonia", "cristina"}, "zelinha": {"zelia"}, "cris": {"cristina"}, "tina": {"cristina"}, "gege": {"geraldo"}, "gera": {"geraldo"},
}
_DIMINUTIVE = re.compile(r"(z?inh[oa]s?|zito|zita|it[oa])$")


def fold(text: str | None) -> str:
    """Lower case without accents."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def tokens(text: str | None) -> list[str]:
    """Folded words of a name without particles; a single letter is an initial."""
    return [t for t in re.findall(r"[a-z0-9]+", fold(text)) if t not in PARTICLES or len(t) == 1]


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits from ``a`` to ``b`` with neighbours swapped counting one (optimal string alignment); ``most + 1`` beyond ``most``.

    Hyyrö's bit-vectors: a column of the matrix of distances is held as its rises and falls, a bit a letter of ``a``."""
    if a == b:
        return 0
    n = len(a)
    if abs(n - len(b)) > most:
        return most + 1
    if not n:
        return len(b)
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    rise, fall, same, last, score = full, 0, 0, 0, n
    for c in b:
        here = place.get(c, 0)
        swapped = ((~same & here) << 1) & last
        same = (((here & rise) + rise) ^ rise) | here | fall | swapped
        up = fall | ~(same | rise) & full
        down = same & rise
        score += bool(up & top) - bool(down & top)
        up = up << 1 | 1
        rise = ((down << 1) | ~(same | up)) & full
        fall = up & same & full
        last = here
    return min(score, most + 1)


def allowed(length: int) -> int:
    """Edits within which two words of this length are the same word mistyped."""
    return 0 if length <= 3 else 1 if length <= 6 else 2


def same_given(short: str, name: str) -> bool:
    """Whether ``short`` is a nickname of ``name``: listed, a diminutive, a beginning or an end of it."""
    if short == name or name in NICKNAMES.get(short, ()):
        return True
    m = _DIMINUTIVE.search(short)
    stem = short[: m.start()] if m else short
    if m and len(stem) >= 3 and (name.startswith(stem) or stem.endswith("qu") and name.startswith(stem[:-2] + "c") or stem[:-1] == name[: len(stem) - 1] and len(stem) >= 5):
        return True
    if m and len(stem) >= 2 and name.startswith(stem) and len(name) <= len(stem) + 2:
        return True
    return not m and 3 <= len(short) < len(name) and (name.startswith(short) or name.endswith(short) and len(short) >= 3)
