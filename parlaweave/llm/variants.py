"""Variant spellings of names typed by people (problem 3).

Trie join.  The register is cut into blocks of entries, the words of a block into a trie.  All distinct typed words of a
task walk a trie at once with a Levenshtein automaton (its states as bits of one integer a word, swapped neighbours count one)
that enumerates the register's words in bounded distance, or with a prefix for an abbreviated word.  A typed name then meets the entries
that hold a neighbour of every word it has, or of every word but one that is a nickname of the entry's given name; nothing else can fit.
Token-order permutations (surname first, dropped middle names, initials, nicknames, words glued or torn) are checked for those.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .names import GENERATION, PARTICLES, fold, same_given

#: Entries in one broadcast block of the register (some 3 KB each in a worker).
BLOCK_ENTRIES = 20_000
#: Typed names that a task holds at once, and words whose neighbours it remembers.
CHUNK_FORMS, KEPT_WORDS = 50_000, 500_000
# Titles before a typed name.
TITLES = {"dep", "sen", "dr", "dra", "sr", "sra", "deputado", "deputada", "senador", "senadora", "presidente", "presidenta", "exmo", "exma", "vereador", "vereadora", "ver", "prof", "profa", "pres", "senhor", "senhora"}
_AFFILIATION = re.compile(r"(?:\s*\(\s*|\s+-\s+|\s+)([A-ZÀ-Ý]{2,10})\s*[-/]\s*([A-Z]{2})\s*\)?\s*$")
_ACRONYM = re.compile(r"\s*\(([A-Z]{3,12})\)\s*$")
_ONE = np.uint64(1)
#: Letters of a word that one integer of the automaton holds; longer words walk alone.
_WIDE = 61
_FEW = 10


def bound(length: int) -> int:
    """Edits allowed for a typed word of this length."""
    return 0 if length <= 3 else 1 if length <= 5 else 2


class Trie:
    """Words of one block, as flat lists of nodes in the order of the sorted words.

    A state of the automaton is a set of (letters of the typed word read, edits made); the sets for 0, 1, ... edits are the bits of one
    integer each, so a step over a letter of the trie is a few shifts, for one word or, as arrays, for many."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(set(words))
        self.kids: list[list[tuple[str, int]]] = [[]]
        self.ends = [-1]
        path, last = [0], ""
        for n, w in enumerate(self.words):
            k = next((i for i, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))
            del path[k + 1 :]
            for c in w[k:]:
                self.kids[path[-1]].append((c, len(self.kids)))
                path.append(len(self.kids))
                self.kids.append([])
                self.ends.append(-1)
            self.ends[path[-1]] = n
            last = w

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        """(word of the trie, edits) of all words in reach of one typed word of any length."""
        return list(self._alone(0, [(1 << min(d, len(word)) + 1) - 1 for d in range(most + 1)], None, 0, _places(word), len(word)))

    def _alone(self, node: int, now: list[int], before: list[int] | None, last: int, place: dict[str, int], size: int) -> Iterator[tuple[str, int]]:
        """The walk of one word from a node on."""
        full, goal = (1 << size + 1) - 1, 1 << size
        todo: list[tuple] = [(node, now, before, last)]
        while todo:
            node, now, before, last = todo.pop()
            if self.ends[node] >= 0 and (d := next((d for d, r in enumerate(now) if r & goal), -1)) >= 0:
                yield self.words[self.ends[node]], d
            for c, child in self.kids[node]:
                here = place.get(c, 0)
                new = _step(now, before, here, last, full)
                if new[-1]:
                    todo.append((child, new, now, here))

    def near_many(self, words: list[str], most: int) -> Iterator[tuple[str, str, int]]:
        """(typed word, word of the trie, edits) for many typed words of at most ``_WIDE`` letters at once."""
        if not words:
            return
        width = max(1, *map(len, words))
        size = np.array([len(w) for w in words], np.uint64)
        letters = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
        bit = _ONE << np.arange(1, width + 1, dtype=np.uint64)
        place = {c: np.where(letters == ord(c), bit, np.uint64(0)).sum(1, dtype=np.uint64) for c in set("".join(self.words))}
        goal = _ONE << size
        full = (goal << _ONE) - _ONE
        first = [(_ONE << np.minimum(np.uint64(d), size) + _ONE) - _ONE for d in range(most + 1)]
        todo: list[tuple] = [(0, np.arange(len(words)), first, None, None)]
        while todo:
            node, who, now, before, last = todo.pop()
            if len(who) <= _FEW:  # arrays don't pay for a few words
                for k, i in enumerate(who.tolist()):
                    own = _places(words[i])
                    state = [int(r[k]) for r in now], None if before is None else [int(r[k]) for r in before]
                    for w, d in self._alone(node, *state, own.get(last, 0), own, len(words[i])):
                        yield words[i], w, d
                continue
            if self.ends[node] >= 0:
                want, seen = goal[who], np.zeros(len(who), bool)
                for d, r in enumerate(now):
                    hit = ((r & want) != 0) & ~seen
                    seen |= hit
                    for i in who[hit].tolist():
                        yield words[i], self.words[self.ends[node]], d
            for c, child in self.kids[node]:
                new = _step(now, before, place[c][who], None if last is None else place[last][who], full[who], _ONE, _ONE + _ONE)
                live = np.flatnonzero(new[-1])
                if len(live) == len(who):
                    todo.append((child, who, new, now, c))
                elif len(live):
                    todo.append((child, who[live], [r[live] for r in new], [r[live] for r in now], c))

    def completions(self, prefix: str) -> list[str]:
        """Words that begin with ``prefix``."""
        node = 0
        for c in prefix:
            node = next((n for x, n in self.kids[node] if x == c), -1)
            if node < 0:
                return []
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            if self.ends[n] >= 0:
                out.append(self.words[self.ends[n]])
            todo += [child for _, child in self.kids[n]]
        return out


def _places(word: str) -> dict[str, int]:
    """The places of each letter in a word, counted from 1, as bits."""
    place: dict[str, int] = {}
    for i, c in enumerate(word, 1):
        place[c] = place.get(c, 0) | 1 << i
    return place


def _step(now: list, before: list | None, here, last, full, one=1, two=2) -> list:
    """The automaton's sets after a letter: ``here`` and ``last`` are the places of this and the previous letter in the typed word."""
    new = [(now[0] << one) & here]
    for d in range(1, len(now)):
        r = ((now[d] << one) & here) | now[d - 1] | ((now[d - 1] | new[d - 1]) << one)
        if before is not None:
            r |= (before[d - 1] << two) & (here << one) & last
        new.append(r & full)
    return new


def parse_name(word: str | None) -> tuple[list[tuple[str, str]], str, str, str]:
    """(words with their kind, party, state, acronym).  Kinds: ``full``, ``initial``, ``abbr`` (a beginning with a dot)."""
    if not word:
        return [], "", "", ""
    s, party, state, acronym = " ".join(word.split()), "", "", ""
    if m := _AFFILIATION.search(s):
        s, party, state = s[: m.start()], fold(m[1]), fold(m[2])
    if m := _ACRONYM.search(s):
        s, acronym = s[: m.start()], fold(m[1])
    s = re.sub(r"\([^()]*\)", " ", s)
    s = re.sub(r"^\s*[OA]\s+(?=S[Rr][Aa]?\.)", "", s)
    while (m := re.match(r"\s*([^\W\d_]+)(?:\.\s*|\s+)(?=\S)", s)) and fold(m[1]) in TITLES:
        s = s[m.end() :]
    if s.count(",") == 1:
        tail, head = s.split(",")
        s = f"{head.strip()} {tail.strip()}" if head.strip() else tail
    if re.fullmatch(r"\s*(?:[^\W\d_]\.\s*){3,}", s):  # an acronym with dots
        s = re.sub(r"[.\s]", "", s)
    raw = re.findall(r"[^\W_]+\.?", s)
    out: list[tuple[str, str]] = []
    for t in raw:
        f = fold(t.rstrip("."))
        if not f or f in PARTICLES and not t.endswith("."):
            continue
        out.append((f, "initial" if len(f) == 1 else "abbr" if t.endswith(".") else "full"))
    return out, party, state, acronym


def _words(name: str) -> list[str]:
    return [t for t in re.findall(r"[a-z0-9]+", fold(name)) if t not in PARTICLES]


def entry_terms(name: str) -> list[tuple[str, int, int]]:
    """(term, first position, positions covered): the words of a register name and neighbours written as one."""
    every = re.findall(r"[a-z0-9]+", fold(name))
    kept = [i for i, t in enumerate(every) if t not in PARTICLES]
    at = {i: k for k, i in enumerate(kept)}
    out = [(every[i], at[i], 1) for i in kept]
    for i in range(len(every) - 1):
        a, b = i in at, i + 1 in at
        if a and b:
            out.append((every[i] + every[i + 1], at[i], 2))
        elif a or b:
            out.append((every[i] + every[i + 1], at[i] if a else at[i + 1], 1))
    return out


def fit(words: list[dict], entry: dict, name: dict) -> tuple[float, int, bool, bool] | None:
    """(score, name's words left over, given name found, last surname found) of typed words against a name of an entry; None if a typed word fits nowhere."""
    full, last, terms = name["words"], name["last"], name["terms"]
    person = entry["kind"] == "pessoa"
    used: set[int] = set()
    total, edits, order = 0.0, 0, []
    exact = lambda w: any(not d and r in terms for r, d in w["near"])
    for w in sorted(words, key=lambda w: (("full", "pair", "abbr", "initial").index(w["kind"]), not exact(w))):  # what is written out chooses first, and of that what needs no edit
        best: tuple[float, int, int, int] | None = None
        for r, d in w["near"]:
            for pos, n in terms.get(r, ()):
                span = range(pos, pos + n)
                if any(i in used for i in span):
                    continue
                s = 1.0 - 0.08 * d - 0.05 * (n > 1) - 0.1 * (w["kind"] == "abbr")
                if best is None or s > best[0]:
                    best = s, pos, n, d
        if best is None and person and 0 not in used and w["kind"] != "initial" and same_given(w["t"], full[0]):
            best = 0.85, 0, 1, 0
        if best is None and w["kind"] == "initial":
            free = [i for i, f in enumerate(full) if i not in used and f[0] == w["t"] and i != last]
            if free:
                best = 0.75, free[0], 1, 0
        if best is None:
            return None
        s, pos, n, d = best
        used.update(range(pos, pos + n))
        total, edits = total + s, edits + d
        order.append((w["pos"], pos))
    if edits > 4:
        return None
    places = [p for _, p in sorted(order)]
    turns = sum(a > b for a, b in zip(places, places[1:]))  # descents: 0 in order, 1 for a rotation
    return total / len(words) - 0.02 * turns, len(full) - len(used), 0 in used, last in used


def score(variant: list[dict], entry: dict, party: str, state: str, acronym: str) -> float | None:
    """How well a variant of the typed words names an entry, None if it doesn't."""
    best = None
    solid = sum(w["kind"] != "initial" for w in variant)
    for name in entry["names"]:
        if (got := fit(variant, entry, name)) is None:
            continue
        value, left, given, last = got
        if entry["kind"] == "pessoa":
            if len(variant) > 1 and not given:  # relatives share surnames
                continue
            if not last and not any(w["kind"] != "initial" and not (k == 0 and same_given(w["t"], name["words"][0])) for k, w in enumerate(variant)):
                continue
            value += 0.03 * last - 0.01 * left
            if state and entry["state"] and state != entry["state"]:
                continue
            agree = bool(state and entry["state"]) + bool(party and entry["party"] and party == entry["party"])
            if party and entry["party"] and party != entry["party"]:
                if solid < 2 or not given:
                    continue
                value -= 0.02  # people change parties
            value += 0.04 * agree
        else:
            if left > 1 or left and len(variant) < 3:
                continue
            value -= 0.05 * left
            if acronym and acronym in entry["acronyms"]:
                value += 0.05
        best = value if best is None else max(best, value)
    if best is not None and tuple(w["t"] for w in variant) in entry["spelled"]:
        best += 0.02  # a spelling that the register lists, more than a tie and less than a party
    return best


def _variants(words: list[dict]) -> list[list[dict]]:
    """The words as typed, and with a torn word put together where its halves mean nothing."""
    out = [[w for w in words if w["kind"] != "pair"]]
    for p in words:
        if p["kind"] == "pair" and p["near"]:
            rest = [w for w in out[0] if w["pos"] not in (p["pos"], p["pos"] + 1)]
            halves = [w for w in out[0] if w["pos"] in (p["pos"], p["pos"] + 1)]
            if not all(h["near"] for h in halves):
                out.append(sorted([*rest, p], key=lambda w: w["pos"]))
    return out


class Index:
    """A block of the register: its entries, the entries that hold each term, and the trie of the terms."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        self.entries: list[dict] = []
        self.holders: dict[str, set[int]] = {}
        self._held: dict[tuple[str, bool, bool], frozenset[int]] = {}
        for entry_id, kind, canonical, spellings, party, state in rows:
            if entry_id is None or not _words(canonical or ""):
                continue
            spellings = [x for x in (spellings if spellings is not None else []) if x]
            acronyms = {fold(x) for x in spellings if re.fullmatch(r"[A-Z]{2,12}", x)}
            listed = [(x, tuple(t for t, _ in parse_name(x)[0])) for x in spellings]
            spelled, known = {ts for _, ts in listed}, set(_words(canonical))
            names = [canonical, *(x for x, ts in listed if fold(x) not in acronyms and not known.issuperset(ts) and all(len(t) > 1 for t in ts))]
            made = []
            for x in names:
                terms: dict[str, list[tuple[int, int]]] = {}
                for t, pos, n in entry_terms(x):
                    terms.setdefault(t, []).append((pos, n))
                own = _words(x)
                sur = [k for k, f in enumerate(own) if f not in GENERATION]
                made.append({"words": own, "terms": terms, "last": sur[-1] if sur else len(own) - 1})
            at = len(self.entries)
            self.entries.append({"entry_id": entry_id, "kind": kind, "names": made, "acronyms": acronyms, "spelled": spelled, "party": fold(party), "state": fold(state)})
            for t in acronyms.union(*(m["terms"] for m in made)):
                self.holders.setdefault(t, set()).add(at)
        self.trie = Trie(self.holders)
        self.longest = max((len(n["words"]) for e in self.entries for n in e["names"]), default=0)

    def near(self, words: list[tuple[str, bool]]) -> Iterator[tuple[str, bool, str, int]]:
        """(typed word, whether it is abbreviated, term, edits) of typed words."""
        by_bound: dict[int, list[str]] = {}
        asked = set(words)
        for t in {t for t, _ in words}:
            if len(t) > _WIDE:
                for r, d in self.trie.near(t, bound(len(t))):
                    yield from ((t, abbr, r, d) for abbr in (False, True) if (t, abbr) in asked)
            elif bound(len(t)):
                by_bound.setdefault(bound(len(t)), []).append(t)
            elif t in self.holders:
                yield from ((t, abbr, t, 0) for abbr in (False, True) if (t, abbr) in asked)
        for most, some in by_bound.items():
            for t, r, d in self.trie.near_many(some, most):
                yield from ((t, abbr, r, d) for abbr in (False, True) if (t, abbr) in asked)
        for t, abbr in words:
            if abbr and len(t) >= 2:
                yield from ((t, abbr, r, 0) for r in self.trie.completions(t) if r != t)

    def held(self, w: dict) -> frozenset[int]:
        """Entries with a neighbour of a typed word."""
        key = w["t"], w["kind"] == "abbr", w["strict"]
        if key not in self._held:
            if len(self._held) > KEPT_WORDS:
                self._held.clear()
            self._held[key] = frozenset().union(*(self.holders.get(r, ()) for r, _ in w["near"]))
        return self._held[key]

    def candidates(self, variant: list[dict]) -> set[int]:
        """All entries that can fit: they hold a neighbour of every written-out word, or of all but one that is a nickname of the given name."""
        if len(variant) > self.longest:  # each typed word takes a word of the name at least
            return set()
        held = [(w, self.held(w)) for w in variant if w["kind"] != "initial"]
        if not held:
            return set()
        held.sort(key=lambda h: len(h[1]))
        if len(held) == 1:
            return set(held[0][1])
        out = held[0][1].intersection(*(h for _, h in held[1:]))
        for k, (w, mine) in enumerate(held):  # the one that may be a nickname
            rest = [h for i, (_, h) in enumerate(held) if i != k]
            some = rest[0].intersection(*rest[1:]) - mine
            out = out.union(e for e in some if self.entries[e]["kind"] == "pessoa" and any(same_given(w["t"], n["words"][0]) for n in self.entries[e]["names"]))
        return set(out)

    def best(self, words: list[dict], party: str, state: str, acronym: str) -> list[tuple[float, int]]:
        """(score, entry) of the two best entries, the best first."""
        found: dict[int, float] = {}
        variants = _variants(words)
        for variant in variants:
            for e in self.candidates(variant):
                value = score(variant, self.entries[e], party, state, acronym)
                if value is not None:
                    found[e] = max(value, found.get(e, value))
        if len(words) == 1:
            for e in self.holders.get(words[0]["t"], ()):
                if words[0]["t"] in self.entries[e]["acronyms"]:
                    found[e] = max(1.0, found.get(e, 1.0))
        return sorted(((v, self.entries[e]["entry_id"]) for e, v in found.items()), reverse=True)[:2]


def _chosen(ranked: list[tuple[float, int]]) -> tuple[bool, int | None]:
    """(whether anything fits well, the entry if one fits better than all others)."""
    ranked = sorted(ranked, reverse=True)
    if not ranked or ranked[0][0] < 0.6:
        return False, None
    return True, None if len(ranked) > 1 and ranked[0][0] - ranked[1][0] < 0.0099 else ranked[0][1]


def link_forms(forms: list[tuple], blocks: Callable[[], Iterable[Index]], memo: dict[tuple[str, bool], list[tuple[str, int]]]) -> list[int | None]:
    """The entry each typed (word, party, state) means, None if there is none or several fit alike.

    ``blocks`` gives the register's blocks, as often as asked.  What a word is near to is gathered over all of them first, so the
    blocks don't change the result.  A word of the register is meant as it is where an entry fits so; only if none does, it may be another one mistyped."""
    if len(memo) > KEPT_WORDS:
        memo.clear()
    parsed = []
    for word, party, state in forms:
        words, p, s, acronym = parse_name(word)
        parsed.append((words, fold(party) or p, fold(state) or s, acronym))

    def walk(words: set[tuple[str, bool]]) -> None:
        new = [w for w in words if w not in memo]
        memo.update((w, []) for w in new)
        for index in blocks() if new else ():
            for t, abbr, r, d in index.near(new):
                memo[t, abbr].append((r, d))
        for w in new:  # a term may stand in several blocks
            memo[w] = sorted(set(memo[w]), key=lambda n: (n[1], n[0]))

    walk({(t, kind == "abbr") for words, *_ in parsed for t, kind in words if kind != "initial"})
    made = []
    for words, *_ in parsed:
        out = [{"pos": k, "t": t, "kind": kind, "near": [] if kind == "initial" else memo[t, kind == "abbr"]} for k, (t, kind) in enumerate(words)]
        for k, (a, b) in enumerate(zip(out, out[1:])):  # two words are put together only where one of them means nothing
            if any(w["kind"] != "initial" and not w["near"] for w in (a, b)) and ("initial" not in (a["kind"], b["kind"]) or len(a["t"]) + len(b["t"]) > 4):
                out.append({"pos": k, "t": a["t"] + b["t"], "kind": "pair", "near": None})
        made.append(out)
    walk({(w["t"], False) for words in made for w in words if w["kind"] == "pair"})
    for words in made:
        for w in words:
            if w["near"] is None:
                w["near"] = memo[w["t"], False]
            w["strict"] = False
    meant = [[w | {"near": [(w["t"], 0)], "strict": True} if (w["t"], 0) in w["near"] else w for w in words] for words in made]
    got: list[int | None] = [None] * len(forms)
    todo = [i for i, words in enumerate(made) if any(w["near"] for w in words)]
    for reading in (meant, made):
        ranked: dict[int, list[tuple[float, int]]] = {i: [] for i in todo}
        for index in blocks() if todo else ():
            for i in todo:
                ranked[i] += index.best(reading[i], *parsed[i][1:])
        chosen = {i: _chosen(r) for i, r in ranked.items()}
        got = [chosen[i][1] if i in chosen and chosen[i][0] else g for i, g in enumerate(got)]
        todo = [i for i in todo if not chosen[i][0] and meant[i] != made[i]]
    return got


def link_names(records: DataFrame, register: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(``name_id``, ``entry_id``): the register entry each typed name means; names of nobody in the register, and names that fit several entries alike, don't appear.

    ``records`` has ``name_id``, ``word``, ``party``, ``state``; ``register`` has ``entry_id``, ``kind``, ``canonical_name``, ``original_names``, ``party``, ``state``.
    A state that differs rules an entry out, a party that differs does for names with fewer than two written-out words.  Null, blank and wordless
    names, and initials or a nickname alone, link nothing; repeated content links alike under every id; an empty table on either side gives an empty result; other columns are ignored.

    The register is the stated set that all names are held against: its entries are broadcast in blocks of ``block_entries``, which pass
    the driver one at a time.  Each content is linked once; the blocks change nothing in the result.
    """
    spark = records.sparkSession
    typed = records.select("name_id", F.trim("word").alias("word"), "party", "state").where("word <> ''")
    blocks, block = [], []
    for row in register.select("entry_id", "kind", "canonical_name", "original_names", "party", "state").where("canonical_name is not null").toLocalIterator():
        block.append(tuple(row))
        if len(block) == block_entries:
            blocks.append(spark.sparkContext.broadcast(block))
            block = []
    if block:
        blocks.append(spark.sparkContext.broadcast(block))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[Index] = []

        def indexes() -> Iterator[Index]:
            if len(blocks) == 1 and not kept:
                kept.append(Index(blocks[0].value))
            yield from kept or (Index(b.value) for b in blocks)

        memo: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        forms: list[tuple] = []

        def settle() -> pd.DataFrame:
            rows = [(*f, e) for f, e in zip(forms, link_forms(forms, indexes, memo)) if e is not None]
            forms.clear()
            return pd.DataFrame(rows, columns=["w", "p", "s", "entry_id"])

        for pdf in frames:
            forms += [tuple(None if pd.isna(x) else x for x in r) for r in zip(pdf["word"], pdf["party"], pdf["state"])]
            if len(forms) >= CHUNK_FORMS:
                yield settle()
        if forms:
            yield settle()

    # a given number of tasks: the contents are few bytes but much work, so they must not be coalesced
    tasks = max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = typed.select("word", "party", "state").distinct().repartition(tasks).mapInPandas(run, "w string, p string, s string, entry_id bigint")
    return typed.join(named, (typed["word"] == named["w"]) & typed["party"].eqNullSafe(named["p"]) & typed["state"].eqNullSafe(named["s"])).select("name_id", "entry_id").distinct()
