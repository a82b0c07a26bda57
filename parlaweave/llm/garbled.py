"""Garbled text from wrong character encoding (problem 9).

Noisy-channel decoding.  A channel is the pair of the encoding the bytes had and the one they were read in.
Every distinct token with a character outside ASCII becomes a byte lattice under each channel: bytes that
were lost (U+FFFD, a missing continuation byte, ``?`` inside a word) are wildcards.  Decodings are
scored with the word frequencies of the whole corpus; a wildcard takes the most frequent word that fits.
A Viterbi search over the contested tokens of a document, with the channel as its state, then decides which
spans are damaged: a document tends to be damaged by one channel, so evidence adds up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

LOST = "�"
#: (name, [(read as, really), ...]): what to encode the observed text in and to decode it from, step by step.
CHANNELS: list[tuple[str, list[tuple[str, str]]]] = [
    ("clean", []),
    ("utf8-as-cp1252", [("cp1252", "utf-8")]),
    ("utf8-as-cp1252-twice", [("cp1252", "utf-8"), ("cp1252", "utf-8")]),
    ("utf8-as-macroman", [("mac_roman", "utf-8")]),
    ("utf8-as-cp1251", [("cp1251", "utf-8")]),
    ("utf8-as-cp850", [("cp850", "utf-8")]),
    ("utf8-as-cp437", [("cp437", "utf-8")]),
    ("utf8-as-cp1250", [("cp1250", "utf-8")]),
    ("cp1252-as-cp850", [("cp850", "cp1252")]),
    ("cp1252-as-cp437", [("cp437", "cp1252")]),
    ("cp1252-as-macroman", [("mac_roman", "cp1252")]),
    ("cp1252-as-cp1251", [("cp1251", "cp1252")]),
    ("cp850-as-cp1252", [("cp1252", "cp850")]),
    ("macroman-as-cp1252", [("cp1252", "mac_roman")]),
    ("lost", []),
]
LOST_STATE = len(CHANNELS) - 1
#: Contested tokens that are broadcast (some 300 bytes each).
BROADCAST_TOKENS = 100_000
#: Costs in nats: entering a channel, an unknown word, a form no rightly written text has, a lost byte filled in, an unknown word from single bytes.
ENTER, IMPROBABLE, FILL, WEAK = 5.0, 8.0, 4.0, 4.0
#: Signs beyond Latin-1 letters that a right decoding may hold.
_SIGNS = set("–—‘’“”„†‡•…‰‹›€™œŒšŠžŽŸƒ")


def _byte(c: str, codec: str) -> int | None:
    """The byte that ``codec`` shows as ``c``, None for a lost one, -1 if there is none."""
    if c == LOST:
        return None
    try:
        return c.encode(codec)[0]
    except UnicodeEncodeError:
        return ord(c) if codec == "cp1252" and 0x80 <= ord(c) < 0xA0 else -1  # bytes that cp1252 leaves undefined


def _plausible(c: str) -> bool:
    return 0xA0 <= ord(c) <= 0xFF or c in _SIGNS or c == LOST


def _script(c: str) -> str:
    """The alphabet a letter or mark is of, by its name; empty for other characters."""
    return unicodedata.name(c, "").split(" ")[0].replace("HIRAGANA", "CJK").replace("KATAKANA", "CJK") if unicodedata.category(c)[0] in "LM" else ""


def _right(text: str, codec: str) -> bool:
    """Whether a decoding may be right: Western letters and signs, or, from bytes of UTF-8, other Latin letters, a word in one other alphabet, or a pictograph."""
    other = [c for c in text if ord(c) > 0x7F and not _plausible(c) and not (codec == "utf-8" and 0xFF < ord(c) < 0x180)]
    if not other or codec != "utf-8":
        return not other
    letters = [s for c in other if (s := _script(c))]
    if any(not _script(c) and ord(c) < 0x10000 for c in other):
        return False
    return not letters or len(letters) > 1 and len(set(letters)) == 1 and letters[0] != "COMBINING" and not any(c.isascii() and c.isalpha() for c in text)


def _decode(lattice: list[int | None], codec: str, last: bool = True) -> str | None:
    """The text of a byte lattice; None if the bytes are no text of ``codec``, or no plausible one at the ``last`` step."""
    if codec != "utf-8":
        text = "".join(LOST if b is None else bytes([b]).decode(codec, "replace") for b in lattice)
        return text if not last or _right(text, codec) else None
    out, i, n = [], 0, len(lattice)
    while i < n:
        b = lattice[i]
        if b is None:
            out.append(LOST)
            i += 1
        elif b < 0x80:
            out.append(chr(b))
            i += 1
        elif 0xC2 <= b < 0xF5:
            need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            tail = lattice[i + 1 : i + 1 + need]
            got = 0
            while got < len(tail) and (tail[got] is None or 0x80 <= tail[got] < 0xC0):
                got += 1
            if got == need and None not in tail:
                c = bytes([b, *tail]).decode("utf-8", "replace")
                if len(c) != 1 or c == LOST:
                    return None
                out.append(c)
            elif b in (0xC2, 0xC3, 0xE2):  # a lead byte without its continuation: a lost character
                out.append(LOST)
            else:
                return None
            i += 1 + got
        else:
            return None
    text = "".join(out)
    return text if not last or _right(text, codec) else None


def decodings(token: str) -> list[tuple[int, str]]:
    """(channel, decoded token) for every channel under which the token is a plausible byte lattice."""
    out: list[tuple[int, str]] = []
    for k, (_, steps) in enumerate(CHANNELS):
        text: str | None = token
        for step, (read_as, really) in enumerate(steps, 1):
            lattice = [_byte(c, read_as) for c in text]
            text = None if -1 in lattice else _decode(lattice, really, step == len(steps))
            if text is None or text == token:
                text = None
                break
        if steps and text is not None:
            out.append((k, text))
    inner = [i for i in range(1, len(token) - 1) if token[i] == "?" and token[i - 1].isalpha() and token[i + 1].isalpha()]
    if LOST in token:
        out.append((LOST_STATE, token))
        if LOST * 2 in token:  # both bytes of a character lost
            out.append((LOST_STATE, token.replace(LOST * 2, LOST)))
    elif inner:
        out.append((LOST_STATE, "".join(LOST if i in inner else c for i, c in enumerate(token))))
    return out


def improbable(token: str) -> bool:
    """Forms that rightly written text does not have: control or lost characters, alphabets or signs mixed into a word, capitals after small letters."""
    if LOST in token or any(0x80 <= ord(c) < 0xA0 for c in token):
        return True
    core = token.strip("".join({c for c in token if not c.isalnum()}))
    latin = any("a" <= c.lower() <= "z" for c in core)
    for a, b in zip(core, core[1:]):
        if (a.islower() and b.isupper() and (ord(a) > 127 or ord(b) > 127)) or latin and ord(b) > 0x17F and (b.isalpha() or not _plausible(b)):
            return True
        if b.isascii() is False and not b.isalnum() and b not in "’–—­" and a.isalpha():
            return True
    return bool(core) and latin and ord(core[0]) > 0x17F


def fill(token: str, word: str | None) -> str:
    """``token`` with its lost characters taken from ``word``, which fits the token's core, in the token's case."""
    if word is None:
        return token
    at = next((i for i in range(len(token) - len(word) + 1) if all(c == LOST or c.lower() == w for c, w in zip(token[i:], word))), None)
    if at is None:
        return token
    upper = sum(c.isupper() for c in token) > sum(c.islower() for c in token)
    out = [c if c != LOST or not at <= i < at + len(word) else (word[i - at].upper() if upper else word[i - at]) for i, c in enumerate(token)]
    return "".join(out)


def core(token: Column) -> Column:
    """A token's word: lower case, without signs around it (U+FFFD counts as a letter); the token itself if it has none."""
    bare = F.lower(F.regexp_replace(token, "^[^\\p{L}\\p{N}\\x{FFFD}]+|[^\\p{L}\\p{N}\\x{FFFD}]+$", ""))
    return F.when(bare == "", F.lower(token)).otherwise(bare)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r]+"), F.lit(0))


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for t in pdf["token"]:
            found = decodings(t)
            if found or improbable(t):
                # a strict UTF-8 decoding by chance is as improbable as a malformed word
                odd = improbable(t) or any(CHANNELS[k][1] and CHANNELS[k][1][-1][1] == "utf-8" and LOST not in c for k, c in found)
                rows.append((t, 0, t, odd))
                rows += [(t, k, c, improbable(c.replace(LOST, "a"))) for k, c in found]
        yield pd.DataFrame(rows, columns=["token", "channel", "cand", "odd"])


def _filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        made = [c if w is None else fill(c, w) for c, w in zip(pdf["cand"], pdf["word"])]
        yield pd.DataFrame({"token": pdf["token"], "channel": pdf["channel"], "made": made, "score": pdf["score"]})


def contested_tokens(docs: DataFrame, text: str) -> DataFrame:
    """Tokens for which some decoding beats the token itself: ``token`` and ``ways``, an array of (channel, text, score)."""
    tokens = checkpoint(docs.select(F.explode(_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))  # read four times
    words = tokens.groupBy(core(F.col("token")).alias("core")).agg(F.sum("n").alias("n")).where("core not like '%�%'")
    total = words.agg(F.sum("n")).first()[0] or 1
    odd = tokens.where(F.col("token").rlike("[^\\x00-\\x7F]|\\p{L}\\?\\p{L}")).select("token")
    cands = odd.mapInPandas(_candidates, "token string, channel int, cand string, odd boolean").withColumn("core", core(F.col("cand")))
    # the most frequent word for each shape with its letters beyond ASCII lost
    shapes = words.where(F.col("core").rlike("[^\\x00-\\x7F]")).groupBy(F.regexp_replace("core", "[^\\x00-\\x7F]", LOST).alias("core")).agg(F.max_by("core", F.struct("n", "core")).alias("word"), F.max("n").alias("n_shape"))
    scored = cands.join(words, "core", "left").join(shapes, "core", "left")
    n = F.coalesce(F.when(F.col("word").isNotNull(), F.col("n_shape")), F.col("n"), F.lit(0))
    score = F.log((n + 0.1) / F.lit(float(total))) - F.when(F.col("odd"), F.lit(IMPROBABLE)).otherwise(0.0) - F.when(F.col("cand").contains(LOST), F.lit(FILL)).otherwise(0.0)
    # an unknown word decoded from single bytes is no evidence by itself; it may follow the channel of its neighbours
    weak = F.col("channel").isin([k for k, (_, s) in enumerate(CHANNELS) if s and s[-1][1] != "utf-8"]) & (n < 2)
    score = score - F.when(weak, F.lit(WEAK)).otherwise(0.0)
    scored = scored.select("token", "channel", "cand", "word", score.alias("score")).mapInPandas(_filled, "token string, channel int, made string, score double")
    ways = scored.groupBy("token", "channel").agg(F.max_by("made", F.struct("score", "made")).alias("made"), F.max("score").alias("score"))
    ways = ways.where((F.col("channel") == 0) | (F.col("made") != F.col("token")) | F.col("made").contains(LOST))
    best = ways.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("channel", "made", "score"))).alias("ways"))
    own = F.filter("ways", lambda w: w["channel"] == 0)[0]["score"]
    other = F.array_max(F.transform(F.filter("ways", lambda w: w["channel"] > 0), lambda w: w["score"]))
    return best.where((other > own) | F.col("token").contains(LOST) | F.col("token").rlike("[\\x{80}-\\x{9F}]"))


def best_path(ways: list[list[tuple[int, str, float]]]) -> list[int]:
    """The channel of each token on the cheapest path (Viterbi); ``ways`` has (channel, text, score) of each token."""
    states = range(len(CHANNELS))
    score = {s: 0.0 if s == 0 else -ENTER for s in states}
    back: list[dict[int, int]] = []
    for options in ways:
        emit = {k: v for k, _, v in options}
        worst = min(emit.values()) - IMPROBABLE  # a channel that doesn't explain the token
        top = max(score, key=lambda s: (score[s], -s))
        came, now = {}, {}
        for s in states:
            switch = score[top] - (0.0 if s == 0 else ENTER)
            came[s], before = (s, score[s]) if score[s] >= switch else (top, switch)
            now[s] = before + emit.get(s, worst)
        back.append(came)
        score = now
    at = max(score, key=lambda s: (score[s], -s))
    path = []
    for came in reversed(back):
        path.append(at)
        at = came[at]
    return path[::-1]


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for doc, text_key, spans in zip(pdf["doc"], pdf["text_key"], pdf["spans"]):
            spans = sorted(spans, key=lambda s: s["pos"])
            ways = [[(w["channel"], w["made"], w["score"]) for w in s["ways"]] for s in spans]
            fixes = []
            for s, k, options in zip(spans, best_path(ways), ways):
                made = next((m for c, m, _ in options if c == k), s["token"])
                lost = LOST in s["token"] or any(0x80 <= ord(c) < 0xA0 for c in s["token"])
                if k or lost:
                    fixes.append({"pos": int(s["pos"]), "channel": CHANNELS[k or LOST_STATE][0], "was": s["token"], "now": made})
            if fixes:
                rows.append((doc, text_key, fixes))
        yield pd.DataFrame(rows, columns=["doc", "text_key", "fixes"])


def _text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def find_garbled(docs: DataFrame, key: str, text: str, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """Documents with damaged spans: ``key``, ``text_key`` (16 bytes for the text) and ``fixes``, an array of (pos, channel, was, now) by token position.

    ``now`` is the restored token; one that can't be restored keeps U+FFFD for lost characters, or stays.  Found are texts of any alphabet in UTF-8
    that were read in a one-byte encoding, Western texts in one one-byte encoding read in another, and lost characters.
    Null and empty texts are never damaged; equal texts under several keys are all reported; a key with several texts, the null key too, has a row
    for each; equal rows give one row; an empty table gives an empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).where("t is not null")
    contested = checkpoint(contested_tokens(texts, "t"))
    spots = texts.select("doc", _text_key(F.col("t")).alias("text_key"), F.posexplode(_tokens(F.col("t"))).alias("pos", "token")).where(F.col("token").rlike("[^\\x00-\\x7F]|\\p{L}\\?\\p{L}"))
    # beyond the bound the join shuffles by token, and adaptive execution splits hot ones
    hit = spots.join(F.broadcast(contested) if contested.count() <= broadcast_tokens else contested, "token")
    spans = hit.groupBy("doc", "text_key").agg(F.collect_set(F.struct("pos", "token", "ways")).alias("spans"))
    return spans.mapInPandas(_settle, f"doc {kind}, text_key binary, fixes array<struct<pos: int, channel: string, was: string, now: string>>").withColumnRenamed("doc", key)


def restore(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The damaged documents with ``restored`` text; white space stays as it was.  A row for each distinct text of a key."""
    fixed = find_garbled(docs, key, text).withColumnsRenamed({key: "_key", "text_key": "_text_key"})
    rows = docs.select(key, F.col(text).alias("_text")).where("_text is not null")
    both = rows.join(fixed, rows[key].eqNullSafe(fixed["_key"]) & (_text_key(F.col("_text")) == fixed["_text_key"])).dropDuplicates(["_key", "_text_key"]).select(key, "_text", "fixes")

    def rebuild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, t, fixes in zip(pdf[key], pdf["_text"], pdf["fixes"]):
                now = {f["pos"]: (f["was"], f["now"]) for f in fixes}
                parts, at = [], 0
                for pos, m in enumerate(re.finditer(r"[^ \t\n\r]+", t)):
                    was, new = now.get(pos, ("", ""))
                    parts += [t[at : m.start()], new if was == m.group() else m.group()]
                    at = m.end()
                out.append((k, "".join(parts) + t[at:], len(fixes), ",".join(sorted({f["channel"] for f in fixes}))))
            yield pd.DataFrame(out, columns=[key, "restored", "n_spans", "channels"])

    return both.mapInPandas(rebuild, f"`{key}` {dict(docs.dtypes)[key]}, restored string, n_spans bigint, channels string")
