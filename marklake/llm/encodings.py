"""Text decoded with the wrong character encoding: which records, and the original text where it can be had.

Round-trip repair. A stretch of text is encoded back under each legacy encoding it may wrongly have been decoded with and then strictly decoded as
what it may have been; the result stands if a garbling cost drops. This is repeated for nested layers until nothing drops any more.

* Intended UTF-8: every sequence of characters whose legacy bytes form one UTF-8 character is a tentative repair. It stands if it
  removes what no orthography has (controls, line-drawing or other symbols inside words, alphabets mixed within a word, capitals after small letters) and
  its character goes with its neighbours', or if it adjoins another repair.
* Intended a one-byte encoding: any bytes decode, so the cost is the negative log likelihood under letter pairs counted over the documents of the
  corpus. What is garbled must not make its own letters usual, whatever its share: of a text with words that no orthography has (`suspicious`), the foreign words count
  in the one reading that fits an alphabet, or not at all. A run of words is repaired if its likelihood rises by `least` nats in total and by `least_per_char` for each character that changes.

Replacement characters (U+FFFD) show lost text: such a record is garbled, and not complete. The counted pairs go to all workers. They are few: letters of scripts with thousands of characters count by their
block of 256, and a pair with less than `rarest` of all counts is left to the smoothing, so there are at most 1 / `rarest` pairs, in any corpus.

Defined results: null, empty and blank texts are not garbled; each row is judged by itself, so repeated rows come out repeatedly; a null id stays null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.sources.shared import written

LEGACY = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "mac_cyrillic", "iso8859_2", "iso8859_5", "cp1254", "cp1257", "cp1253")
# (decoded as, intended): one byte per character on both sides.
ONE_BYTE = tuple(
    (wrong, meant)
    for wrong, meants in {
        "cp1252": ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1250", "iso8859_2", "mac_roman", "cp850", "cp437", "cp852", "cp1254", "cp1257"),
        "cp1250": ("cp1252", "iso8859_2", "cp852", "cp1251"),
        "iso8859_2": ("cp1250", "cp1252", "cp1251"),
        "cp1251": ("koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1252", "cp1250"),
        "koi8_r": ("cp1251", "cp866", "iso8859_5", "cp1252"),
        "cp866": ("cp1251", "koi8_r", "cp1252"),
        "mac_roman": ("cp1252", "cp1251", "cp1250"),
        "cp437": ("cp1252", "cp1251", "cp1250"),
        "cp850": ("cp1252", "cp1250", "cp1251"),
        "iso8859_5": ("cp1251", "koi8_r"),
        "mac_cyrillic": ("cp1251", "koi8_r"),
    }.items()
    for meant in meants
)


@lru_cache(maxsize=None)
def bytes_of(codec: str) -> dict[str, int]:
    """Character to byte for the upper half; a byte without character stands for the control of that number, as lenient decoders have it."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if codec == "cp1252" else {}
    for b in range(0x80, 0x100):
        out[bytes([b]).decode(codec, "ignore") or chr(b)] = b
    return out


@lru_cache(maxsize=None)
def translation(wrong: str, meant: str) -> dict[int, str]:
    """Character decoded wrongly to character meant; U+FFFE where there is none."""
    table = defaultdict(lambda: "\ufffe", {b: chr(b) for b in range(0x80)})
    return table | {ord(c): bytes([b]).decode(meant, "ignore") or "\ufffe" for c, b in bytes_of(wrong).items()}


_FOREIGN = re.compile(r"[^\x00-\x7f]{2,}")


@lru_cache(maxsize=1 << 16)
def openers(pair: str) -> int:
    """Which of LEGACY's encodings (bits) have these two characters as the begin of a UTF-8 character."""
    return sum(1 << k for k, codec in enumerate(LEGACY) if 0xC2 <= bytes_of(codec).get(pair[0], 0) <= 0xF4 and 0x80 <= bytes_of(codec).get(pair[1], 0) <= 0xBF)


def opening(text: str) -> list[str]:
    """The encodings under which the text can have UTF-8 sequences at all."""
    bits = 0
    for pair in {run[k : k + 2] for run in _FOREIGN.findall(text) for k in range(len(run) - 1)}:
        bits |= openers(pair)
    return [codec for k, codec in enumerate(LEGACY) if bits >> k & 1]


@lru_cache(maxsize=None)
def sequences(codec: str) -> re.Pattern:
    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in bytes_of(codec).items() if low <= b <= high) + "]"

    more = chars(0x80, 0xBF)
    return re.compile(f"{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{{2}}|{chars(0xF0, 0xF4)}{more}{{3}}")


# Ranges of characters that texts are written with.
_COMMON = ((0xA0, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2D8, 0x2DD), (0x300, 0x30C), (0x384, 0x3CE), (0x400, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x1E00, 0x1EFF), (0x200B, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0xFB01, 0xFB02), (0xFFFD, 0xFFFD))
# Ranges whose sequences also occur by chance, as a letter before an ellipsis and a quotation mark: they need company or a control among their bytes.
_EXOTIC = ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF))
_PRINTERS = frozenset("“”‘’„‚‹›«»…–—")


@lru_cache(maxsize=1 << 16)
def decoded(codec: str, text: str) -> str | None:
    try:
        return bytes(bytes_of(codec)[c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """Alphabet of a letter, empty for anything else."""
    if not c.isalpha() or unicodedata.category(c) == "Lm" or c in "ªº":
        return ""
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(maxsize=1 << 16)
def closing(c: str) -> bool:
    return c in "»”’›“…™®©°.,;:!?)%" or unicodedata.category(c) in ("Pf", "Pe", "Zs", "Po")


def odd(run: str, before: str, after: str) -> int:
    """The garbling cost of `run` between its neighbours: what no orthography has."""
    cost = 0
    for k, c in enumerate(run):
        p, n = run[k - 1] if k else before, run[k + 1] if k + 1 < len(run) else after
        kind = unicodedata.category(c)
        if kind == "Cc" or "─" <= c <= "▟":
            cost += 2
        elif kind == "Zs":
            cost += 2 * (p == "Ã" and k > 0)
        elif kind[0] in "SPNC" or c in "ªº":
            if c in "-'’·‑":
                cost += 0
            elif script(n) and (script(p) or kind in ("Pf", "No", "So")):
                cost += 2
            elif script(p) and (not closing(c) and kind not in ("Pi", "Ps", "Pd") or c in "«‹‚„"):
                cost += 2
            elif kind == "Sc" and c not in "€£$" or c in "¬√≈∆¶§¤¨´¸":
                cost += 1
        elif script(c):
            cost += 2 * sum(script(o) not in ("", script(c)) for o in (p, n))
            cost += 2 * (p.islower() and c.isupper()) + 2 * (c.islower() and n.isupper())
    return cost


def goes_with(c: str, before: str, after: str) -> bool:
    if not script(c):
        return not (script(before) and script(after)) or c in "’'-‐‑\xad\u200b\u200c\u200d" or unicodedata.combining(c) > 0
    return all(script(o) in ("", script(c)) for o in (before, after))


def _utf8_layer(text: str, codec: str) -> tuple[str, int]:
    """The text with the UTF-8 sequences that stand decoded, and how many."""
    spans = [(m.start(), m.end(), made) for m in sequences(codec).finditer(text) if (made := decoded(codec, m.group())) is not None]
    within = lambda made, ranges: any(a <= ord(made) <= b for a, b in ranges)
    exotic = [within(made, _EXOTIC) for _, _, made in spans]
    usual = [within(made, _COMMON) for _, _, made in spans]
    for k, (a, b, _) in enumerate(spans):
        beside = [j for j in (k - 1, k + 1) if 0 <= j < len(spans) and exotic[j] and (spans[j][1] == a or spans[j][0] == b)]
        usual[k] |= exotic[k] and bool(beside or b - a == 4 or any("\x80" <= c <= "\x9f" for c in text[a:b]))
    joined = [k > 0 and spans[k - 1][1] == spans[k][0] for k in range(len(spans))] + [False]
    drops = []
    for k, (a, b, made) in enumerate(spans):
        before = spans[k - 1][2] if joined[k] else text[a - 1 : a]
        after = spans[k + 1][2] if joined[k + 1] else text[b : b + 1]
        ok = usual[k] and goes_with(made, before, after)
        sign = 2 * (b - a == 3 and ("‐" <= made <= "⁄" or made in "€™"))  # no word or sentence has the three characters these come from
        drops.append(sign + odd(text[a:b], text[a - 1 : a], text[b : b + 1]) - odd(made, before, after) if ok else -99)
    sure = any(d >= 2 for d in drops)
    stands = [d >= 2 or sure and d >= 1 for d in drops]
    for way in (range(len(spans)), range(len(spans) - 1, -1, -1)):
        for k in way:  # what adjoins a repair was garbled with it
            if not stands[k] and drops[k] > -99:
                stands[k] = joined[k] and stands[k - 1] or joined[k + 1] and stands[k + 1]
    n = sum(stands)
    if not n:
        return text, 0
    first, last = stands.index(True), len(stands) - 1 - stands[::-1].index(True)
    out, at = [], 0
    for k, (a, b, made) in enumerate(spans):
        if stands[k] or first < k < last:  # inside a garbled stretch all that decodes was garbled with it
            out += [text[at:a], made]
            at = b
    return "".join(out) + text[at:], n


def utf8_repaired(text: str) -> tuple[str, list[str]]:
    layers: list[str] = []
    while codecs := opening(text):  # every layer makes the text shorter
        best = max((_utf8_layer(text, c) + (c,) for c in codecs), key=lambda x: x[1])
        if best[1]:
            text = best[0]
            layers.append(f"{best[2]} < utf-8")
            continue
        # The outer of two layers may leave alphabets mixed, so it only stands together with the inner one.
        under = sequences("cp1252").sub(lambda m: decoded("cp1252", m.group()) or m.group(), text)
        best = max((_utf8_layer(under, c) + (c,) for c in opening(under)), key=lambda x: x[1], default=("", 0, "")) if under != text else ("", 0, "")
        if best[1] < 2:
            break
        text = best[0]
        layers += ["cp1252 < utf-8", f"{best[2]} < utf-8"]
    return text, layers


class Pairs:
    """Letter pairs counted over the corpus, without regard to case."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts, self.firsts, self.all = counts, Counter(), Counter()
        for (a, b), n in counts.items():
            self.firsts[a] += n
            self.all[b] += n
        self.total, self.kinds = sum(self.all.values()) + 1, len(self.all) + 200
        self.known: dict[str, float] = {}
        self.nats: dict[str, float] = {}
        self.usual = sum(n * self.pair(a, b) for (a, b), n in counts.items()) / self.total
        self.gained: dict[str, list[tuple[int, float]]] = {}

    def gains(self, word: str) -> list[tuple[int, float]]:
        """By which of ONE_BYTE's pairs the word gets likelier, and by how much."""
        out = self.gained.get(word)
        if out is None:
            cost = self.cost(word)
            pairs = decodable("".join(sorted({c for c in word if c > "\x7f"}))) if cost > self.usual * (len(word) + 1) else ()
            out = self.gained[word] = [(k, gain) for k in pairs if (gain := self.gain(word, translated(word, *ONE_BYTE[k]))) > 0]
        return out

    @cached_property
    def matrix(self) -> np.ndarray:
        """Nats of all pairs of letters that the encodings have, without regard to case."""
        chars = repertoire()
        low = [chars[k] for k in lowered()]
        n = len(chars)
        counts, one = np.zeros((n, n)), np.array([(self.all.get(c, 0) + 0.05) / (self.total + self.kinds) for c in low])
        first = {c: k for k, c in reversed(list(enumerate(low)))}
        for (a, b), times in self.counts.items():
            if a in first and b in first:
                counts[first[a], first[b]] = times
        at = np.array([first[c] for c in low])
        firsts = np.array([self.firsts.get(c, 0) for c in low])
        return -np.log((counts[at][:, at] + 4 * one[None]) / (firsts[:, None] + 4))

    def prepare(self, texts: list[str | None]) -> None:
        """Finds the gains of the texts' words, all together."""
        if len(self.gained) > 200_000:
            self.gained.clear()
        words = {w for t in texts if t and not t.isascii() for w in t.split() if not w.isascii()} - self.gained.keys()
        index, blank = positions(), positions()[" "]
        self.gained.update(dict.fromkeys(words, []))
        words = [w for w in words if all(c in index for c in w)]  # no encoding has another word
        if not words:
            return
        flat = np.array([k for w in words for k in (blank, *map(index.__getitem__, w))] + [blank])
        begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
        small, capital, tables, printers = cases()

        def cost(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(self.matrix[x[:-1], x[1:]] + 2.0 * (small[x[:-1]] & capital[x[1:]]), begin)

        own = cost(flat)
        unlikely = own > self.usual * np.diff(np.append(begin, len(flat) - 1))
        for k, table in enumerate(tables):
            made = table[flat]
            fits = unlikely & (np.minimum.reduceat(made[:-1], begin) >= 0)
            if not fits.any():
                continue
            changed = made != flat
            fits &= np.logical_or.reduceat((changed & ~printers[flat])[:-1], begin)  # printers' marks alone are no garbling
            gain = own - cost(np.maximum(made, 0))
            for j in np.flatnonzero(fits & (gain > 0)):
                self.gained[words[j]] = [*self.gained[words[j]], (k, float(gain[j]))]

    def gain(self, word: str, made: str) -> float:
        """By how many nats the word gets likelier; printers' marks alone are no garbling."""
        gain = self.cost(word) - self.cost(made)
        return min(gain, 0.0) if all(a == b or a in _PRINTERS for a, b in zip(word, made)) else gain

    def pair(self, a: str, b: str) -> float:
        one = (self.all.get(b, 0) + 0.05) / (self.total + self.kinds)
        if len(self.nats) > 500_000:
            self.nats.clear()
        out = self.nats[a + b] = -math.log((self.counts.get((a, b), 0) + 4 * one) / (self.firsts.get(a, 0) + 4))
        return out

    def cost(self, word: str) -> float:
        """Nats of a word; capitals after small letters, which no word has, cost on top."""
        out = self.known.get(word)
        if out is None:
            low, nats = f" {folded(word)} ", self.nats
            out = 0.0
            for k in range(len(low) - 1):
                n = nats.get(low[k : k + 2])
                out += self.pair(low[k], low[k + 1]) if n is None else n
            if not (word.islower() or word[1:].islower() or word.isupper()):
                out += sum(2.0 for p, c in zip(word, word[1:]) if p.islower() and c.isupper())
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = out
        return out


@lru_cache(maxsize=None)
def repertoire() -> tuple[str, ...]:
    """All characters that one of ONE_BYTE's encodings has, and their small ones."""
    upper = {c for pair in ONE_BYTE for codec in pair for c in bytes_of(codec)}
    every = {chr(b) for b in range(0x80)} | upper
    return tuple(sorted(every | {c.lower()[0] for c in every}))


@lru_cache(maxsize=None)
def positions() -> dict[str, int]:
    return {c: k for k, c in enumerate(repertoire())}


@lru_cache(maxsize=None)
def lowered() -> tuple[int, ...]:
    return tuple(positions()[c.lower()[0]] for c in repertoire())


@lru_cache(maxsize=None)
def cases() -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the repertoire's characters: small, capital, their translation by each of ONE_BYTE's pairs (-1 where there is none), printers' marks."""
    chars, index = repertoire(), positions()
    tables = []
    for pair in ONE_BYTE:
        made = [translation(*pair)[ord(c)] for c in chars]
        tables.append(np.array([index.get(c, -1) for c in made]))
    return np.array([c.islower() for c in chars]), np.array([c.isupper() for c in chars]), tables, np.array([c in _PRINTERS for c in chars])


def folded(word: str) -> str:
    """Small letters; those of scripts with thousands of characters stand for their block of 256."""
    word = word.lower()
    return word if word.isascii() or max(word) < "\u2e80" else "".join(c if c < "\u2e80" else chr(ord(c) & ~0xFF) for c in word)


def translated(word: str, wrong: str, meant: str) -> str | None:
    made = word.translate(translation(wrong, meant))
    return None if "\ufffe" in made else made


@lru_cache(maxsize=1 << 16)
def decodable(foreign: str) -> tuple[int, ...]:
    """Which of ONE_BYTE's pairs have all these characters, and change one."""
    return tuple(k for k, pair in enumerate(ONE_BYTE) if (made := translated(foreign, *pair)) is not None and made != foreign)


@lru_cache(maxsize=1 << 16)
def sensible(foreign: str) -> tuple[int, ...]:
    """Which of ONE_BYTE's pairs turn all these characters into what texts are written with, and change one."""
    out = []
    for k, pair in enumerate(ONE_BYTE):
        made = translated(foreign, *pair)
        if made is not None and made != foreign and all(c.isalpha() or unicodedata.category(c)[0] == "P" or c in "€£§©®™°№µ±\xa0" for c in made):
            out.append(k)
    return tuple(out)


def one_byte_repaired(text: str, pairs: Pairs, least: float, least_per_char: float) -> tuple[str, str | None]:
    """The text with its best run of words decoded as it was meant, and by which encodings."""
    hoped: dict[int, float] = {}
    for word in text.split():
        if not word.isascii():
            for k, gain in pairs.gains(word):
                hoped[k] = hoped.get(k, 0.0) + gain
    hoped = {k: gain for k, gain in hoped.items() if gain > least}
    if not hoped:
        return text, None
    parts = re.split(r"(\s+)", text)
    best: tuple[float, int, int, str, str] = (least, 0, 0, "", "")
    for wrong, meant in (ONE_BYTE[k] for k in sorted(hoped)):
        total, changed, begin = 0.0, 0, None
        for k in range(0, len(parts), 2):
            made = translated(parts[k], wrong, meant)
            gain = -1e9 if made is None else pairs.gain(parts[k], made) if made != parts[k] else 0.0
            if total + gain <= 0 or (begin is None and gain <= 0):
                total, changed, begin = 0.0, 0, None
                continue
            begin = k if begin is None else begin
            total += gain
            changed += sum(c >= "\x80" for c in parts[k])
            if gain > 0 and total > best[0] and total >= least_per_char * changed:
                best = (total, begin, k, wrong, meant)
    if not best[3]:
        return text, None
    _, a, b, wrong, meant = best
    parts[a : b + 1] = [translated(p, wrong, meant) or p for p in parts[a : b + 1]]
    return "".join(parts), f"{wrong} < {meant}"


def judged(text: str | None, pairs: Pairs, least: float, least_per_char: float) -> tuple[bool, str | None, list[str], bool]:
    """(garbled, restored, layers from the outermost, complete)."""
    if not text or text.isascii() or not text.strip():
        return False, text, [], True
    lost, layers, made = "�" in text, [], text
    while True:  # every layer makes the text shorter or likelier
        tried = [(t, names) for t, names in (utf8_repaired(made), _named(one_byte_repaired(made, pairs, least, least_per_char))) if names]
        if not tried:
            break
        made, names = min(tried, key=lambda x: sum(map(pairs.cost, x[0].split()))) if len(tried) > 1 else tried[0]
        layers += names
    return bool(layers) or lost, made, layers, "�" not in made


def _named(made: tuple[str, str | None]) -> tuple[str, list[str]]:
    return made[0], [made[1]] if made[1] else []


# Letters beyond a to z that occur together in one orthography.
ALPHABETS = tuple(
    frozenset(a)
    for a in (
        "ąćęłńóśźż", "áäčďéěíĺľňóôŕřšťúůýž", "áéíóöőúüű", "ăâîșțşţ", "čćđšž", "äöüß", "àâæçéèêëîïôœùûüÿ", "áéíñóúü", "àáâãçéêíóôõúü", "àèéìíîòóù", "åäöæøé", "áéíóúýþæöð", "âçğıîöşüû", "āčēģīķļņšūž", "ąčęėįšųūž", "äöõüšž", "éèëêïöüóá",
        "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "абвгдеёжзійклмнопрстуўфхцчшыьэюя", "абвгдђежзијклљмнњопрстћуфхцчџш", "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
    )
)


@lru_cache(maxsize=1 << 16)
def strange(word: str) -> bool:
    return sum(map(str.isalpha, word)) >= 3 and odd(word, " ", " ") > 0


@lru_cache(maxsize=1 << 16)
def all_foreign(word: str) -> bool:
    """No letter from a to z, but three or more Latin ones: what other alphabets look like in a Latin encoding."""
    letters = [c for c in word if c.isalpha()]
    return len(letters) >= 3 and all("\x7f" < c < "\u0100" for c in letters)


def suspicious(foreign: list[str]) -> bool:
    """Are these words, those of a text that aren't ASCII, partly such as no orthography has?"""
    return any(map(strange, foreign)) or len({w for w in foreign if all_foreign(w)}) > 1


def readings(words: list[str]) -> list[list[str]]:
    """Different readings of garbled words under ONE_BYTE that have no strange words and the letters of one alphabet."""
    found: list[list[str]] = []
    for k in sensible("".join(sorted({c for w in words for c in w if c > "\x7f"}))):
        made = [w.translate(translation(*ONE_BYTE[k])) for w in words]
        letters = {c for w in made for c in w.lower() if c > "\x7f" and c.isalpha()}
        if made not in found and any(letters <= a for a in ALPHABETS) and not suspicious(made):
            found.append(made)
    return found


def countable(text: str) -> list[str]:
    """The words of a text that count: of a suspicious one those of a to z, and the garbled ones if there is one way only to read them."""
    words = text.split()
    foreign = [w for w in words if not w.isascii()]
    if not suspicious(foreign):
        return words
    read = readings(foreign)
    if len(read) != 1:  # garbled in parts
        read = readings([w for w in foreign if strange(w) or all_foreign(w)])
    return [w for w in words if w.isascii()] + (read[0] if len(read) == 1 else [])


def letter_pairs(df: DataFrame, text_col: str = "text", rarest: float = 1e-7) -> dict[tuple[str, str], int]:
    """Counts over all texts, added up where the texts lie; at most 1 / `rarest` pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: defaultdict = defaultdict(int)

        def flush() -> None:
            for word, n in words.items():
                a = " "
                for b in [*folded(word), " "]:
                    pairs[a, b] += n
                    a = b
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(text.split() if text.isascii() else countable(text))
            if len(words) > 100_000:
                flush()
        flush()
        keys = list(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64())], ["a", "b", "n"])

    counted = df.select(text_col).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted = written(counted, "pairs")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return {(r.a, r.b): r.n for r in counted.where(F.col("n") >= F.lit(rarest * total)).collect()}


def repaired(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 14.0, least_per_char: float = 1.0) -> DataFrame:
    """(id, garbled, restored, layers, complete) of every row."""
    counts = letter_pairs(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(counts)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(shared.value)
        for batch in batches:
            texts = batch.column("body").to_pylist()
            pairs.prepare(texts)
            rows = [judged(t, pairs, least, least_per_char) for t in texts]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.bool_())], ["id", "garbled", "restored", "layers", "complete"])

    kind = df.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, garbled boolean, restored string, layers array<string>, complete boolean").withColumnRenamed("id", id_col)
