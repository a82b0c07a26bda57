"""Speech transcripts into clean speaker turns (problem 1).

Labels are cut out of the raw text, normalised to name words, title, party and state, and clustered inside
their transcript: label variants and roster entries are nodes, an edge joins two nodes whose initials
agree and whose words are similar, and union-find takes the edges from the most similar down without ever joining two
roster entries.  A cluster with a roster entry is that speaker, one without is nobody known.  Stretches
whose speech is empty after cleaning are dropped, neighbours of one speaker collapse into a turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import GENERATION, allowed, distance, fold, same_given, tokens

# Time stamps, titles, voices without a name, fillers and annotations as they are written in the transcripts.
STAMP = r"(?:\[\d{1,3}:\d\d(?::\d\d)?(?:\.\d+)?\]|\(\d{1,2}h\d\d\)|<\d{1,4}:\d\d(?:\.\d+)?>|\b\d{1,3}:\d\d:\d\d\b)"
_STAMP = re.compile(STAMP)
ROLES = {
    "presidente": "chair", "presidenta": "chair", "pres": "chair", "presid": "chair",
    "deputado": "", "deputada": "", "dep": "", "senador": "", "senadora": "", "sen": "", "sr": "", "sra": "", "o": "", "a": "", "senhor": "", "senhora": "", "vereador": "", "vereadora": "", "ver": "", "dr": "", "dra": "", "exmo": "", "exma": "",
}
NOBODY = re.compile(r"\b(?:n[aã]o identificad[oa]|inaud[ií]vel|desconhecid[oa]|oradora?|voz|plateia|participante)\b", re.I)
# Each pattern begins with the letters or signs a match may begin with, so that the text between is passed over quickly.
FILLERS = re.compile(
    r"[AaÃãÂâBbEeÉéHhNnQqTtUu](?<![\w-].)(?i:(?<=t)ipo assim|(?<=h)(?:um-hum|[ãa]-h[ãa]|[ãâ]n*|u+m+|m+)|(?<=a)(?:h?n+|hm+|i+n+)|(?<=[ãâ])h+n*|(?<=ã)ã*|(?<=é)é+|(?<=e)h+|(?<=n)[ée]|(?<=u)h+|(?<=b)om, é|(?<=q)uer dizer assim)(?![\w-])[,.…]*"
)
ANNOTATION = re.compile(
    r"[(\[<*\u2600-\u27BF\uFE0F\u200D\U0001F300-\U0001FAFF](?:(?<=\()(?:\([^()]*\)\)|[A-ZÀ-Ý][^()\n]*[.!]\))|(?<=<)<[^<>]*>>|(?<=\[)[^\[\]\n]*\]|(?<=\*)[^*\n]+\*|(?<=[\u2600-\U0001FAFF])[\u2600-\u27BF\uFE0F\u200D\U0001F300-\U0001FAFF]*|(?<=\u200D)[\u2600-\u27BF\uFE0F\u200D\U0001F300-\U0001FAFF]*)"
)

_END = r"(?:[^\S\n]*:(?=\s|$)|[^\S\n]+[-–—](?=\s|$))"
_PAREN = r"(?:[^\S\n]*\((?P<paren>[^()\n]+)\))?"
_TITLE = r"(?:(?:[OA]\s+)?(?:SRA?|Sra?)\.|(?:Pres|Presid|PRES|PRESID|Dep|DEP|Sen|SEN|Ver|VER)\.|Deputad[oa]|DEPUTAD[OA]|Senadora?|SENADORA?|Vereadora?|VEREADORA?|President[ea]|PRESIDENT[EA])"
#: Where a line begins, and what may stand there before a label.
_LINE = re.compile(r"^", re.M)
_BEFORE = rf"[^\S\n]*(?:{STAMP}[^\S\n]*(?:[-–—][^\S\n]*)?)*"
#: At the start of a line, after an optional time stamp.
AT_LINE = re.compile(rf"{_BEFORE}(?P<label>(?P<head>[^\W\d_][^:\n()–—]*?){_PAREN}){_END}", re.M)
_AT_TITLE = re.compile(_TITLE + r"(?=[\s.]|$|(?<=\.))")
#: Inside a line only the full stenographic form starts a stretch: article, title and name in capitals.
_STENO = re.compile(r"O SR\.|A SRA\.")
IN_LINE = re.compile(rf"(?P<label>(?P<title>(?:O SR|A SRA)\.)[^\S\n]+(?P<name>[^\W\d_a-zà-ÿ][^a-zà-ÿ()\n:–—]*?){_PAREN}){_END}", re.M)
ALONE = re.compile(rf"{_BEFORE}(?P<label>\((?P<paren>[^()\n]*identificad[oa][^()\n]*)\)){_END}", re.M | re.I)


@dataclass
class Label:
    start: int
    end: int
    words: tuple[str, ...] = ()
    chair: bool = False
    titled: bool = False
    nobody: bool = False
    party: str = ""
    state: str = ""
    gender: str = ""
    raw: str = ""
    plain: bool = field(default=False)


def _affiliation(paren: str) -> tuple[str, str, str]:
    """(name, party, state) of what stands in brackets: ``Name. [bloc/]PARTY - UF``, ``[bloc/]PARTY-UF``, ``PARTY/UF`` or a name."""
    m = re.match(r"^(?:(?P<name>[^/]*?)\.\s*)?(?:[^/.]*/\s*)?(?P<party>[\w.]+)\s*[-–/]\s*(?P<state>[A-Za-z]{2})\s*$", paren)
    return ((m["name"] or "").strip(), fold(m["party"]), fold(m["state"])) if m else (paren.strip(), "", "")


_WORD = re.compile(r"[^\W\d_][\w'’]*")
_SMALL = ("de", "da", "do", "dos", "das", "e", "di", "del")


def _capitalised(name: str) -> bool:
    """Every word of a name begins with a capital, particles apart."""
    some = False
    for m in _WORD.finditer(name):  # ordinary text ends at its first small word
        if (w := m.group())[0].isupper():
            some = some or fold(w) not in _SMALL
        elif fold(w) not in _SMALL:
            return False
    return some


def parse(m: re.Match[str]) -> Label | None:
    """A label of a match, None if what matched is ordinary text."""
    g = m.groupdict()
    title, name, paren = (g.get(k) or "" for k in ("title", "name", "paren"))
    if g.get("head"):
        t = _AT_TITLE.match(g["head"])
        title, name = (t.group(), g["head"][t.end() :]) if t else ("", g["head"])
    raw = m["label"].strip()
    if not raw:
        return None
    out = Label(m.start(), m.end(), raw=raw, titled=bool(title))
    if NOBODY.search(raw) and not re.search(r"\d", raw):
        out.nobody = True
        return out
    if name and not _capitalised(name):
        return None
    head = [fold(t).strip(".") for t in re.findall(r"[^\s.]+\.?", title + " " + name)]
    out.chair = any(ROLES.get(h) == "chair" for h in head[:3])
    out.gender = "f" if re.match(r"(?:A\s|SRA|Sra|\w*[Aa]\b)", title) and not title.lower().startswith(("pres", "o")) else "m" if title.lower().startswith(("o", "sr.", "deputado", "senador ")) else ""
    inner, out.party, out.state = _affiliation(paren) if paren else ("", "", "")
    words = [t for t in tokens(name) if t not in ROLES or len(t) == 1]
    if not words and inner:
        if not _capitalised(inner):
            return None
        words = tokens(inner)
    if not words and not out.chair:
        return None
    out.words = tuple(words)
    out.plain = not title and not out.party
    return out


def _may_follow(text: str, at: int) -> bool:
    """Whether an introduction may stand here: at the beginning of a line, behind a sign and white space, or behind a gap."""
    if at == 0 or text[at - 1] == "\n":
        return True
    before = text[at - 2] if at > 1 else "\n"
    return text[at - 1].isspace() and (before.isspace() or before.isdigit() or before in ".!?…)]>*\"”:;,-–—")


def _matches(text: str) -> Iterator[re.Match[str]]:
    """All places where a label may stand: at the beginning of a line, and at a stenographic introduction inside one."""
    for line in _LINE.finditer(text):
        for pattern in (ALONE, AT_LINE):
            if m := pattern.match(text, line.start()):
                yield m
    found = [m.start() for m in _STENO.finditer(text)]
    for at, following in zip(found, [*found[1:], len(text)]):  # a label does not run over the next introduction
        if _may_follow(text, at) and (m := IN_LINE.match(text, at, following + 1)):
            yield m


def labels(text: str, known: dict[tuple, Label] | None = None) -> list[Label]:
    """Labels in order of place, without overlaps.  ``known`` remembers what a label says: most come up again and again."""
    known = {} if known is None else known
    found = []
    for m in _matches(text):
        key = m.re, *m.groups()
        if key in known:
            found.append(replace(known[key], start=m.start(), end=m.end()))
        elif x := parse(m):
            if len(known) >= Distances.MOST:
                known.clear()
            known[key] = x
            found.append(x)
    out: list[Label] = []
    for x in sorted(found, key=lambda x: (x.start, -x.end)):
        if not out or x.start >= out[-1].end:
            out.append(x)
    return out


def clean(speech: str) -> str:
    """Speech without time stamps, annotations and fillers, white space collapsed."""
    speech = FILLERS.sub(" ", ANNOTATION.sub(" ", _STAMP.sub(" ", speech)))
    return " ".join(speech.split()).strip(" -–—")


class Distances(dict):
    """Edit distances of pairs of words, and what labels say, remembered: the same names come up in many transcripts."""

    MOST = 200_000

    def __init__(self) -> None:
        self.labels: dict[tuple, Label] = {}

    def __missing__(self, pair: tuple[str, str]) -> int:
        if len(self) >= self.MOST:
            self.clear()
        d = self[pair] = distance(*pair)
        return d


def similarity(words: tuple[str, ...], full: tuple[str, ...], apart: Distances) -> float:
    """How well the words of a label fit a full name: 0 if a word fits nowhere, else up to 1."""
    if not words or not full:
        return 0.0
    total, used = 0.0, set()
    for k, w in enumerate(words):
        best, at = 0.0, -1
        for i, f in enumerate(full):
            if i in used:
                continue
            if w == f:
                s = 1.0
            elif len(w) == 1:
                s = 0.55 if w == f[0] and i < len(full) - (len(words) > 1) else 0.0
            elif (d := apart[w, f]) <= allowed(min(len(w), len(f))):
                s = 0.95 - 0.1 * d
            elif i == 0 and len(w) >= 2 and same_given(w, f):
                s = 0.8
            elif len(w) >= 7 and d <= 3 and w[:2] == f[:2]:
                s = 0.5
            else:
                s = 0.0
            if s > best:
                best, at = s, i
        if at < 0:
            glued = [f + full[i + 1] for i, f in enumerate(full[:-1])]  # a missing space
            if any(apart[w, g] <= 2 for g in glued):
                total += 0.8
                continue
            return 0.0
        used.add(at)
        total += best
    surname = any(len(w) > 1 for w in words)
    return total / len(words) if surname else 0.0


def cluster(found: list[Label], roster: list[dict], apart: Distances | None = None) -> dict[tuple, int]:
    """Speaker number of each label variant (key: words, party, state, gender)."""
    apart = Distances() if apart is None else apart
    people = [(r["speaker_no"], tuple(tokens(r["word"])), fold(r["party"]), fold(r["state"]), fold(r["title"])) for r in roster]
    variants = list(dict.fromkeys((x.words, x.party, x.state, x.gender) for x in found if x.words))
    parent = {**{("r", p[0]): ("r", p[0]) for p in people}, **{("l", v): ("l", v) for v in variants}}
    person = {("r", p[0]): p[0] for p in people}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for v in variants:
        words, party, state, gender = v
        scores: dict[int, float] = {}
        for no, full, p, s, title in people:
            score = similarity(words, full, apart)
            if not score:
                continue
            last = [f for f in full if f not in GENERATION]
            if last and any(apart[w, last[-1]] <= allowed(len(w)) for w in words):
                score += 0.05  # the last surname counts more than one in the middle
            for given, known in ((party, p), (state, s)):
                if given and known:
                    score += 0.15 if given == known else -0.25
            if gender and title in ("deputado", "senador", "deputada", "senadora"):
                score += 0.02 if (gender == "f") == title.endswith("a") else -0.1
            scores[no] = max(score, scores.get(no, 0))
        top = max(scores.values(), default=0)
        best = [no for no, s in scores.items() if s >= top - 1e-9]
        if top >= 0.45 and len(best) == 1:
            edges.append((top, ("l", v), ("r", best[0])))
    for i, v in enumerate(variants):  # variants of one another: initials agree, words similar
        for u in variants[i + 1 :]:
            if v[1] and u[1] and v[1] != u[1] or len(v[0]) != len(u[0]) or any(a[0] != b[0] for a, b in zip(v[0], u[0])):
                continue
            gap = sum(apart[a, b] for a, b in zip(v[0], u[0]))
            if gap <= 2 and len(v[0]) > 1 and all(len(w) > 1 for w in v[0] + u[0]):
                edges.append((0.44 - 0.01 * gap, ("l", v), ("l", u)))
    for _, a, b in sorted(edges, key=lambda e: -e[0]):
        x, y = root(a), root(b)
        if x == y or x in person and y in person:
            continue
        if x in person:
            x, y = y, x
        parent[x] = y
    return {v: person.get(root(("l", v)), 0) for v in variants}


def turns_of(text: str | None, roster: list[dict], apart: Distances | None = None) -> list[tuple[int, int, str]]:
    """(turn number, speaker number, clean speech) of one transcript."""
    if not text or not text.strip():
        return []
    apart = Distances() if apart is None else apart
    found = labels(text, apart.labels)
    who = cluster(found, roster, apart)
    chair = next((r["speaker_no"] for r in sorted(roster, key=lambda r: r["speaker_no"]) if fold(r["title"]).startswith("president")), 0)

    def speaker(x: Label) -> int:
        if x.nobody:
            return 0
        if not x.words:
            return chair
        return who.get((x.words, x.party, x.state, x.gender), 0)

    # a bare name before a colon is a label only if it names somebody of the roster
    kept = [(x, n) for x in found if (n := speaker(x)) or not x.plain or x.nobody]
    out: list[list] = []
    for k, (x, n) in enumerate(kept):
        speech = clean(text[x.end : kept[k + 1][0].start if k + 1 < len(kept) else len(text)])
        if not re.search(r"[^\W_]", speech):
            continue
        if out and out[-1][0] == n:
            out[-1][1] += " " + speech
        else:
            out.append([n, speech])
    return [(i, n, s) for i, (n, s) in enumerate(out, 1)]


def speaker_turns(transcripts: DataFrame, roster: DataFrame) -> DataFrame:
    """Ordered turns: ``doc_id``, ``turn_no`` (from 1), ``speaker_no`` (0: labelled but not identified), ``speech``.

    ``transcripts`` has ``doc_id``, ``text``, ``captured_at``; of several captures the earliest with text counts.  ``roster`` has
    ``doc_id``, ``speaker_no``, ``title``, ``word``, ``party``, ``state``; its repeated rows count once.  Null, blank and unlabelled
    texts have no turn; without a roster every label is unidentified; a null ``doc_id`` has no roster.  Other columns are ignored.
    """
    texts = transcripts.select("doc_id", "text", "captured_at").where(F.length(F.trim("text")) > 0)
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct("captured_at", "text")).alias("text"))
    people = roster.select("doc_id", F.struct(F.col("speaker_no").cast("bigint").alias("speaker_no"), "title", "word", "party", "state").alias("p")).where("p.speaker_no is not null").distinct()
    people = people.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("people"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart = Distances()
        for pdf in frames:
            rows = []
            for d, t, p in zip(pdf["doc_id"], pdf["text"], pdf["people"]):
                rows += [(d, *turn) for turn in turns_of(t, [] if p is None else [dict(x) for x in p], apart)]
            yield pd.DataFrame(rows, columns=["doc_id", "turn_no", "speaker_no", "speech"])

    return texts.join(people, "doc_id", "left").mapInPandas(run, "doc_id string, turn_no bigint, speaker_no bigint, speech string")
