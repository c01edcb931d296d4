"""Garbled text from wrong character encodings.

A hidden Markov model labels every character with the clean state or with the
state of one encoding pair (how the text was written, how it was read). A state's emission is
the probability of the character that its inverse transform gives at this place: a state of
UTF-8 read as a one-byte encoding explains whole byte sequences, one of two one-byte
encodings explains letters. Changing the state costs, so a lone symbol that would also be a valid byte sequence stays
as it is, unless it stands for a letter or sign of the languages where no clean text has it (``mÉ™ktub``): that alone pays for the change.
No word is restored to a mix of scripts. Every labelled span gets its state's inverse transform; texts garbled more than once
go through the model again.

All texts go to the model. The gains of many texts are bounded together; a state is followed further in a text only if
some span of it can pay for the changes to it and back.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 was read as.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1254", "iso8859-9", "koi8-r", "cp866", "iso8859-2")
#: (written as, read as) of one-byte encodings.
BYTE_PAIRS = (
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1251", "cp1252"), ("cp1251", "latin-1"),
    ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("cp1254", "cp1252"), ("iso8859-9", "latin-1"),
)
#: Cost of a change of state, in nats.
SWITCH = 7.0
#: More for a change between two characters of a word.
INSIDE = 3.0
#: Cost of a change within a byte sequence.
WITHIN = 100.0
#: What a sequence that no clean text has at its place is worth: more than the changes to its state and back inside a word.
ALONE = 11.0
#: Times that a text may go through the model.
ROUNDS = 3
#: What a character beyond ASCII must gain on average in a span of one-byte encodings.
FLOOR = 0.5
#: Characters whose emissions are computed together.
CHUNK = 200_000
#: Emissions: letters of other languages beside letters of their script and apart from them, other Cyrillic letters, marks and letters of other scripts.
_OTHER, _APART, _CYRILLIC, _FOREIGN = -5.5, -6.5, -5.5, -6.0
#: What a byte sequence is worth that stands for a letter outside the languages, or for another sign.
_LETTER, _SIGN = -7.0, -8.0

# Russian letters by falling frequency, per mille.
_RU = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))
# The commonest pairs of letters in Russian words, about two thirds of all pairs.
_RU_PAIRS = """ст но то на ен ов ни ра во ко ал ро по ре ос пр ли ер не ол ка ло ть ор ес ел ет ан го ом та ит ва да ам ль де од от ас те ла ак
об ог за ат ле ск ис он ин ти ри мо до ии ия ие ию ий ый ой ая ое их ых ым им ем ми ду тр тв нн ны вы ви ве ед ек ик ич че чт ши же жи ег бе бы ан
ар ма мы св се си со су сл та ту ты уд ус ут уч це ци ша ще щи яв ят ях ют юд ьн ьс эт ки ке ку лу лы лю ля му на ну ня ок оп ож оз оч ош па пе пи ру ры
ря са ть ул ур фо фе хо ча чн""".split()
#: What a pair of letters is worth that is one of these, and what one that is not.
_PAIR, _NO_PAIR = 0.5, -0.7
# Letters of Azerbaijani and Turkish beyond ASCII, and signs that clean texts have.
_LATIN = "çəğıöşüÇƏĞİÖŞÜ"
_SIGNS = "«»“”„‘’–—…№• "
_HATS = "âîû"

_FFFD = 0xFFFD
_BEYOND = 0xF8FF
_BLANKS = np.array([9, 10, 13, 32])


def _chars(enc: str) -> list[str]:
    """The character of every byte; bytes that the encoding leaves out read as the control character of the same number."""
    out = []
    for b in range(256):
        try:
            out.append(codecs.decode(bytes([b]), enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class _Tables:
    """Look-up tables by code point under 0x10000; built once per process. All characters beyond share the last private one."""

    def __init__(self) -> None:
        n = 0x10000
        every = [chr(c) if not 0xD800 <= c < 0xE000 else "\ufffe" for c in range(n)]
        kind = np.array([unicodedata.category(c) for c in every])
        self.letter = np.array([c.isalpha() and c not in "ªº" for c in every])
        clean = np.full(n, -12.0, np.float32)
        some = np.isin(kind, ["Mn", "Mc", "Me", "Nd", "Nl"]) | self.letter
        clean[some] = _FOREIGN
        clean[np.isin(kind, ["Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "No", "Zs", "Cf"])] = -7.0
        clean[0x2500:0x2600] = -9.0
        clean[0x400:0x530] = _CYRILLIC
        clean[0x20:0x7F] = -3.0
        clean[[9, 10, 13]] = -3.0
        self.latin = self.letter & np.array([0xAA < c < 0x250 or 0x1E00 <= c < 0x1F00 for c in range(n)])
        upper = np.zeros(n, np.int8)  # 1 lower, 2 upper
        for c in range(0x41, 0x5B):
            upper[c], upper[c + 32] = 2, 1
        clean[self.latin] = _APART
        for c in _LATIN:
            clean[ord(c)] = -3.5
            upper[ord(c)] = 2 if c.isupper() else 1
        for c in _SIGNS:
            clean[ord(c)] = -4.5
        for c in _HATS + "€™":
            clean[ord(c)] = -6.0
        clean[[ord(c) for c in "ÝÞÐýþð"]] = -6.5
        for c in "іїєґІЇЄҐ":
            clean[ord(c)] = -4.5
        for c, w in _RU.items():
            clean[ord(c)] = clean[ord(c.upper())] = np.log(w / 1000.0)
            upper[ord(c)], upper[ord(c.upper())] = 1, 2
        clean[_FFFD] = -6.0
        clean[_BEYOND] = _FOREIGN
        self.clean, self.upper = clean, upper
        self.cyr = np.zeros(n, bool)
        self.cyr[0x400:0x530] = True
        self.ascii_letter = np.zeros(n, bool)
        self.ascii_letter[0x41:0x5B] = self.ascii_letter[0x61:0x7B] = True
        self.ru = np.full(n, 33, np.int8)
        for i, c in enumerate(_RU):
            self.ru[ord(c)] = self.ru[ord(c.upper())] = i
        self.pair = np.zeros((34, 34), np.float32)
        self.pair[:33, :33] = _NO_PAIR
        for a, b in _RU_PAIRS:
            self.pair[self.ru[ord(a)], self.ru[ord(b)]] = _PAIR
        # letters of words of other languages, next to others of their script
        self.easy = np.where(self.latin & (clean < _OTHER), _OTHER - clean, 0).astype(np.float32)
        self.easy[[ord(c) for c in "ÝÞÐýþð"]] = 0  # these are letters of the languages read wrong, above all
        # what a byte sequence may stand for: any character that is assigned, and what one-byte encodings show of such sequences
        self.fits = ~np.isin(kind, ["Cn", "Cc", "Co", "Cs"])
        self.fits[0x80:0xA0] = self.fits[_BEYOND] = True
        for c in _chars("cp1252")[0x80:]:
            self.fits[ord(c)] = True
        known = clean > -5.0
        known[[ord(c) for c in _HATS + "€™"]] = True
        self.worth = np.where(known, np.maximum(clean, -6.0), np.where(some | (kind == "Cf"), _LETTER, _SIGN)).astype(np.float32)
        self.worth[0x80:0x100] = np.maximum(self.worth[0x80:0x100], -6.0)
        for c in _chars("cp1252")[0x80:] + ["ё", "Ё"]:
            self.worth[ord(c)] = max(self.worth[ord(c)], -6.0)
        self.worth[_BEYOND] = _LETTER
        alone = np.zeros(n, bool)
        alone[0x410:0x450] = True
        for c in _LATIN + _HATS + "ёЁ№€™“”„‘’–—…•":
            alone[ord(c)] = True
        self.alone = alone
        self.small = np.array([c.islower() and c not in "ªº" for c in every])
        self.capital = np.array([c.isupper() for c in every])
        self.box = np.zeros(n, bool)
        self.box[0x2500:0x2600] = True


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _cased(cp: np.ndarray, base: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Emission of decoded characters: the letter, and its case after the one before."""
    e = base.copy()
    prev = np.empty_like(kind)
    prev[0], prev[1:] = 0, kind[:-1]
    up = kind == 2
    e[up & (prev == 0)] -= 1.5
    e[up & (prev == 2)] -= 0.3
    e[up & (prev == 1)] -= 6.0
    e[(kind == 1) & (prev == 2)] -= 0.2
    t = _tables()
    letter = t.ru[cp]
    e[1:] += t.pair[letter[:-1], letter[1:]]
    return e


class _Utf8:
    """UTF-8 read as ``enc``."""

    def __init__(self, enc: str) -> None:
        self.name = f"utf-8>{enc}"
        chars = _chars(enc)
        self.byte = np.full(0x10000, -1, np.int16)
        for b in range(0x80, 256):
            self.byte[ord(chars[b])] = b
        if enc in ("cp1252", "cp1250", "cp1251", "cp1254"):
            for b in range(0x80, 0xA0):  # the control characters were kept where the encoding has none
                if self.byte[b] < 0:
                    self.byte[b] = b
        t = _tables()
        # second characters that go on no word and are no everyday sign; koi8-r has everyday signs only, but for its box drawing
        odd = t.box.copy() if enc == "koi8-r" else ~t.letter
        for c in _SIGNS + "Ÿ":
            odd[ord(c)] = c == "Ÿ"
        self.odd = odd

    def _sequences(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes the valid sequence that starts at each place has, 0 for none, and what it stands for."""
        b = self.byte[cp].astype(np.int32)
        n = len(cp)
        pad = np.append(b, [-1, -1, -1])
        b1, b2, b3 = pad[1 : n + 1], pad[2 : n + 2], pad[3:]
        c1, c2, c3 = ((x & 0xC0) == 0x80 for x in (b1, b2, b3))
        c1, c2, c3 = c1 & (b1 >= 0), c2 & (b2 >= 0), c3 & (b3 >= 0)
        size = np.where((b >= 0xC2) & (b <= 0xDF) & c1, 2, np.where((b >= 0xE0) & (b <= 0xEF) & c1 & c2, 3, np.where((b >= 0xF0) & (b <= 0xF4) & c1 & c2 & c3, 4, 0)))
        at = np.flatnonzero(size)
        val = np.zeros(n, np.int64)
        if len(at):
            s, x, x1, x2, x3 = size[at], b[at], b1[at] & 0x3F, b2[at] & 0x3F, b3[at] & 0x3F
            v = np.where(s == 2, (x & 0x1F) << 6 | x1, np.where(s == 3, (x & 0x0F) << 12 | x1 << 6 | x2, (x & 0x07) << 18 | x1 << 12 | x2 << 6 | x3))
            # the shortest form only, no surrogate, nothing beyond the last plane
            ok = (v >= np.array([0, 0, 0x80, 0x800, 0x10000])[s]) & (v < 0x110000) & _tables().fits[np.where(v < 0x10000, v, _BEYOND)]
            size[at[~ok]] = 0
            val[at] = np.where(ok, v, 0)
        return size, val

    def candidates(self, cp: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of characters beyond ASCII (``high``) at which a sequence may start; without one the state never gains."""
        b = self.byte[cp[high]]
        nxt = self.byte[cp[np.minimum(high + 1, len(cp) - 1)]]
        return high[(b >= 0xC2) & (b <= 0xF4) & (nxt >= 0x80) & (nxt <= 0xBF)]

    def _alone(self, cp: np.ndarray, size: np.ndarray, val: np.ndarray) -> np.ndarray:
        """Starts of sequences that no clean text has at their place."""
        t = _tables()
        at = np.flatnonzero(((size == 2) | (size == 3)) & t.alone[np.where(val < 0x10000, val, 0)])
        out = np.zeros(len(cp), bool)
        if len(at):
            pad = np.concatenate(([32], cp, [32, 32, 32]))
            first, second, after, before = cp[at], pad[at + 2], pad[at + 3], pad[at]
            touches = t.small[before] | t.small[after]
            within = t.small[before] & t.small[after]
            word = touches & (t.box[first] | self.odd[second]) | within & (~t.letter[first] | t.capital[first] & t.capital[second])
            three = size[at] == 3
            signs = three & ~(t.letter[first] & t.letter[second] & t.letter[pad[at + 3]])
            out[at] = ~t.capital[before] & np.where(three, signs, word)
        return out

    def emission(self, cp: np.ndarray, pure: np.ndarray, clean: np.ndarray) -> np.ndarray:
        t = _tables()
        size, val = self._sequences(cp)
        e = np.where(cp < 0x80, clean - 0.05, -15.0).astype(np.float32)
        e[cp == _FFFD] = -6.0
        at = np.flatnonzero(size)
        if len(at):
            v = val[at]
            v = np.where(v < 0x10000, v, _BEYOND)
            e[at] = t.worth[v]
            small = t.small[cp] & (cp < 0x80)
            small[at + size[at] - 1] = t.small[v]
            e[at[t.capital[v] & np.append(False, small)[at]]] -= 6.0  # no capital goes on a small letter
            for j in (1, 2, 3):
                e[at[size[at] > j] + j] = 0.0
            e[self._alone(cp, size, val)] += ALONE
        return e

    def restore(self, cp: np.ndarray) -> str:
        size, val = self._sequences(cp)
        at = np.flatnonzero(size)
        out, keep = np.where(size > 0, val, cp), np.ones(len(cp), bool)
        for j in (1, 2, 3):
            keep[at[size[at] > j] + j] = False
        return out[keep].astype("<u4").tobytes().decode("utf-32-le", "replace")


class _Bytes:
    """Text in ``wrote`` read as ``read``."""

    def __init__(self, wrote: str, read: str) -> None:
        self.name = f"{wrote}>{read}"
        w, r = _chars(wrote), _chars(read)
        self.to = np.full(0x10000, -1, np.int32)
        for b in range(0x80, 256):
            self.to[ord(r[b])] = ord(w[b])
        self.cyr = any("а" <= c <= "я" for c in w)
        shown = [c for c in range(0x80, 0x10000) if self.to[c] >= 0 and self.to[c] != c]
        # letters that only this state explains: its span has two of them at least
        self.mark = np.zeros(0x10000, bool)
        self.mark[[c for c in shown if 0x400 <= self.to[c] < 0x460 or chr(self.to[c]) in _LATIN]] = True

    def candidates(self, cp: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of characters beyond ASCII (``high``) that stand for other letters in this state; without one it never gains."""
        return high[self.mark[cp[high]]]

    def emission(self, cp: np.ndarray, pure: np.ndarray, clean: np.ndarray) -> np.ndarray:
        t = _tables()
        d = np.where(cp < 0x80, cp, self.to[cp])
        bad = d < 0
        d = np.where(bad, 0, d)
        e = _cased(d, t.clean[d].astype(np.float32), t.upper[d])
        e[cp < 0x80] -= 0.05
        if self.cyr:
            e[t.ascii_letter[cp]] -= 0.5
            e[(cp >= 0x80) & ~t.cyr[d] & ~bad] -= 2.0
            e[(cp >= 0x80) & t.cyr[d] & ~pure] = -15.0  # a word would mix scripts
        else:
            e[t.latin[d] & (t.clean[d] < -6.0)] -= 2.0  # letters that the languages do not have
        e[bad] = -15.0
        e[cp == _FFFD] = -6.0
        return e

    def restore(self, cp: np.ndarray) -> str:
        d = np.where((cp < 0x80) | (self.to[cp] < 0), cp, self.to[cp])
        return d.astype("<u4").tobytes().decode("utf-32-le", "replace")


@lru_cache(1)
def _states() -> list:
    return [_Utf8(e) for e in UTF8_READ_AS] + [_Bytes(*p) for p in BYTE_PAIRS]


def _clean_emission(cp: np.ndarray, easy: bool = True) -> np.ndarray:
    t = _tables()
    e = _cased(cp, t.clean[cp], t.upper[cp])
    letters = t.letter[cp]
    beside = np.zeros(len(cp), bool)
    beside[1:] |= letters[:-1]
    beside[:-1] |= letters[1:]
    if easy:
        e += t.easy[cp] * beside
    cyr = t.cyr[cp]
    script = (t.upper[cp] > 0) | t.latin[cp] | cyr & letters
    mixed = np.zeros(len(cp), bool)
    mixed[1:] = script[1:] & script[:-1] & (cyr[1:] != cyr[:-1])
    e[mixed] -= 4.0
    return e


def _pure(cp: np.ndarray) -> np.ndarray:
    """Whether the run of letters that a character is in, if any, has no ASCII letter."""
    t = _tables()
    letters = t.letter[cp]
    run = np.cumsum(np.diff(letters, prepend=False))
    has = np.bincount(run, weights=t.ascii_letter[cp], minlength=int(run[-1]) + 1 if len(run) else 0)
    return ~(letters & (has[run] > 0))


def _worth(rows: list[np.ndarray], switch: float) -> list[int]:
    """Places of the states that can be on a best path: their gain over the clean one may pay for a change, and no other state is as good everywhere."""
    clean, left = rows[0], []
    for i in range(1, len(rows)):
        gain = rows[i] - clean
        if gain[gain > 0].sum() > switch:
            left.append(i)
    kept: list[int] = []
    for i in sorted(left, key=lambda i: -float(rows[i].sum())):
        if not any((rows[i] <= rows[j] + 1e-6).all() for j in kept):
            kept.append(i)
    return sorted(kept)


def _two(sums: list[list[float]], costs: list[float], switch: float) -> np.ndarray:
    """The best path of two states: only the lead of the garbled one counts."""
    lead, from_clean, from_other = -switch, [], []
    for (clean, other), cost in zip(sums, costs):
        up, down = lead < -cost, lead > cost
        from_clean.append(down)  # the clean state comes from the other one
        from_other.append(up)
        lead = (-cost if up else cost if down else lead) + other - clean
    s = lead > switch  # the end of the text is a change back
    path = np.empty(len(sums), np.int64)
    for i in range(len(sums) - 1, -1, -1):
        path[i] = s
        s = not from_other[i] if s else from_clean[i]
    return path


def _viterbi(rows: list[np.ndarray], cost: np.ndarray, switch: float) -> np.ndarray:
    """Best state per column; row 0 is the clean state, in which texts begin and end. ``cost``: of a change before each column."""
    e = np.stack(rows)
    k, n = e.shape
    # a path has no reason to change its state inside a run in which the order of the states' emissions stays the same and the cost does not fall
    if k == 2:
        order = e.argmax(0) * 2 + (e[0] == e[1])
        differs = order[1:] != order[:-1]
    else:
        differs = (np.diff(np.argsort(e, axis=0, kind="stable"), axis=1) != 0).any(0)
    starts = np.flatnonzero(np.concatenate(([True], differs | (cost[1:] < cost[:-1]))))
    sums = np.add.reduceat(e.astype(np.float64), starts, axis=1).T.tolist()
    costs = cost[starts].tolist()
    if k == 2:
        return np.repeat(_two(sums, costs, switch), np.diff(np.append(starts, n)))
    v = [0.0] + [-switch] * (k - 1)
    back: list[list[int]] = []
    states = range(k)
    for col, cost in zip(sums, costs):
        top = max(v)
        at, jump = v.index(top), top - cost
        back.append([s if v[s] >= jump else at for s in states])
        v = [(x if x >= jump else jump) + c for x, c in zip(v, col)]
    v = [v[0], *(x - switch for x in v[1:])]  # the end of the text is a change back
    s = v.index(max(v))
    path = [0] * len(sums)
    for i in range(len(sums) - 1, -1, -1):
        path[i] = s
        s = back[i][s]
    return np.repeat(np.array(path), np.diff(np.append(starts, n)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _chunks(texts: Sequence[str], size: int) -> Iterator[list[int]]:
    """Places of texts that have anything beyond ASCII, in groups of about ``size`` characters; all others are clean in every state."""
    group, n = [], 0
    for i, t in enumerate(texts):
        if t and not t.isascii():
            group.append(i)
            n += len(t)
            if n >= size:
                yield group
                group, n = [], 0
    if group:
        yield group


class _Pairs:
    """Gains of the states of one-byte encodings over the clean one by character and the one before, as upper bounds.

    Characters that an encoding shows have a class each, those of ASCII one per case, all others share one. Letters beside letters of
    another language and words of mixed scripts are left out of account, which only raises the bounds.
    """

    def __init__(self) -> None:
        shown = sorted({ord(c) for pair in BYTE_PAIRS for enc in pair for c in _chars(enc)[0x80:]})
        as_class = [10, ord("1"), ord("a"), ord("A"), 0xE001, *shown]
        self.k = len(as_class)
        self.of = np.full(0x10000, 4, np.int64)
        self.of[:0x80] = 1
        self.of[0x41:0x5B], self.of[0x61:0x7B], self.of[10] = 3, 2, 0
        self.of[shown] = np.arange(5, self.k)
        three = np.full((self.k, self.k, 3), 10)
        three[:, :, 1], three[:, :, 2] = np.array(as_class)[:, None], np.array(as_class)
        cp = three.reshape(-1)
        clean = _clean_emission(cp, easy=False)
        pure = np.ones(len(cp), bool)
        self.gain = {s: (state.emission(cp, pure, clean) - clean)[2::3].astype(np.float64) for s, state in enumerate(_states()) if isinstance(state, _Bytes)}
        for g in self.gain.values():  # another character: not explained here, and at best not in the clean state either
            g.reshape(self.k, self.k)[:, 4] = -3.0


@lru_cache(1)
def _pairs() -> _Pairs:
    return _Pairs()


def _promising(texts: Sequence[str], switch: float) -> dict[int, list[int]]:
    """Per text that needs it (by place) the states of which some span pays for the changes to it and back.

    Only characters beyond ASCII and their neighbours count: no state gains by any other.
    """
    cp = _points("\n".join([*texts, ""]))
    cp[cp >= 0x10000] = _BEYOND
    ends = np.cumsum([len(t) + 1 for t in texts])
    high = cp >= 0x80
    keep = high.copy()
    keep[1:] |= high[:-1]
    keep[:-1] |= high[1:]
    keep[ends - 1] = True
    ends = np.cumsum(keep)[ends - 1]
    cp = cp[keep]
    starts = np.append(0, ends[:-1])
    high = np.flatnonzero(cp >= 0x80)
    # states that may gain in the same texts share the arrays of these texts
    wanted: dict[bytes, list[int]] = {}
    for s, state in enumerate(_states()):
        at = state.candidates(cp, high)
        if len(at):
            wanted.setdefault(np.unique(np.searchsorted(ends, at, "right")).tobytes(), []).append(s)
    out: dict[int, list[int]] = {}
    for which, states in wanted.items():
        some = np.frombuffer(which, np.int64)
        part = cp if len(some) == len(texts) else np.concatenate([cp[starts[i] : ends[i]] for i in some])
        size = ends[some] - starts[some]
        first = np.cumsum(size) - size
        clean = pure = pair = None
        for s in states:
            state = _states()[s]
            if isinstance(state, _Bytes):
                if pair is None:
                    of = _pairs().of[part]
                    pair = np.append(0, of[:-1]) * _pairs().k + of
                gain = _pairs().gain[s][pair]
            else:
                if clean is None:
                    clean, pure = _clean_emission(part), _pure(part)
                gain = (state.emission(part, pure, clean) - clean).astype(np.float64)
            gain[first + size - 1] = -1e4  # no span goes on into the next text
            run = np.cumsum(gain)
            lead = run - np.minimum.accumulate(np.append(0.0, run[:-1]))
            for i in some[np.maximum.reduceat(lead, first) > 2 * switch].tolist():
                out.setdefault(i, []).append(s)
    return out


def _spans(text: str, states: list[int], switch: float) -> list[tuple[int, int, int]]:
    cp = _points(text)
    cp[cp >= 0x10000] = _BEYOND
    pure = _pure(cp)
    clean = _clean_emission(cp)
    rows = [clean, *(_states()[i].emission(cp, pure, clean) for i in states)]
    worth = _worth(rows, switch)
    if not worth:
        return []
    rows = [rows[0], *(rows[i] for i in worth)]
    word = ~np.isin(cp, _BLANKS)
    cost = switch + INSIDE * np.concatenate(([False], word[1:] & word[:-1]))
    for i in worth:  # a sequence is in its state as a whole
        if isinstance(_states()[states[i - 1]], _Utf8):
            size, _ = _states()[states[i - 1]]._sequences(cp)
            for j in (1, 2, 3):
                cost[np.flatnonzero(size > j) + j] = WITHIN
    path = _viterbi(rows, cost, switch)
    out = []
    edges = np.flatnonzero(np.diff(path)) + 1
    for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(path)).tolist()):
        if path[a]:
            s = states[worth[path[a] - 1] - 1]
            gain = float((rows[path[a]][a:b] - rows[0][a:b]).sum())
            if isinstance(_states()[s], _Utf8) or gain >= FLOOR * int((cp[a:b] >= 0x80).sum()):
                out.append((a, b, s))
    return out


def spans_of(texts: Sequence[str], switch: float = SWITCH) -> dict[int, list[tuple[int, int, int]]]:
    """(start, end, state) of the garbled spans of every text that has some, by its place; state is a place in the list of encoding pairs."""
    out = {}
    for group in _chunks(texts, CHUNK):
        for i, states in _promising([texts[j] for j in group], switch).items():
            found = _spans(texts[group[i]], states, switch)
            if found:
                out[group[i]] = found
    return out


def restore_all(texts: Sequence[str], switch: float = SWITCH, rounds: int = ROUNDS) -> tuple[list[str], list[list[str]]]:
    """The texts with every garbled span restored, and for each the encoding pairs that were undone, in order. None stays None."""
    texts, pairs = list(texts), [[] for _ in texts]
    todo = list(range(len(texts)))
    for _ in range(rounds):
        again = []
        for i, found in spans_of([texts[j] for j in todo], switch).items():
            text, out, at = texts[todo[i]], [], 0
            for a, b, s in found:
                out += [text[at:a], _states()[s].restore(_points(text[a:b]))]
                at = b
                if _states()[s].name not in pairs[todo[i]]:
                    pairs[todo[i]].append(_states()[s].name)
            new = "".join([*out, text[at:]])
            if new != text:
                texts[todo[i]] = new
                again.append(todo[i])
        todo = again
    return texts, pairs


def restore(text: str, switch: float = SWITCH, rounds: int = ROUNDS) -> tuple[str, list[str]]:
    """:func:`restore_all` of one text."""
    texts, pairs = restore_all([text], switch, rounds)
    return texts[0], pairs[0]


def repair(df: DataFrame, key: str = "doc_id", text: str = "text", switch: float = SWITCH, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """(``key``, ``text`` restored, ``garbled``, ``lost``, ``pairs``) for every row of ``df``.

    ``garbled`` is true if the text or a part of it was decoded with a wrong encoding, restorable or not; ``lost``
    counts replacement characters, whose originals are gone; ``pairs`` names the pairs undone. Null texts stay null and are not garbled;
    empty texts stay empty. Repeated rows come out each; texts of any length are read whole. Other columns are dropped. Without ``texts``
    the text column is null, for those who want to know only which rows are garbled.
    """
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    schema = f"_k {dict(src.dtypes)['_k']}, _t string, garbled boolean, lost bigint, pairs array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm import encoding as me

        for b in batches:
            new, pairs = me.restore_all(b.column(1).to_pylist(), switch, rounds if texts else 1)
            lost = [t.count("\ufffd") if t else 0 for t in new]
            garbled = [bool(p) or n > 0 for p, n in zip(pairs, lost)]
            shown = pa.array(new, pa.string()) if texts else pa.nulls(len(new), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), shown, pa.array(garbled, pa.bool_()), pa.array(lost, pa.int64()), pa.array(pairs, pa.list_(pa.string()))], ["_k", "_t", "garbled", "lost", "pairs"])

    return src.mapInArrow(run, schema).withColumnsRenamed({"_k": key, "_t": text})


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows of :func:`repair` that are garbled, without their texts."""
    return repair(df, key, text, switch, texts=False).filter("garbled").drop(text)
