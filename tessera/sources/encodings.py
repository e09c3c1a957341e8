"""Which encoding legacy text is in: marks first, then strict UTF-8, then the code page whose letters stand together best.

For single-byte code pages every pair of neighbouring bytes with one beyond ASCII is counted once over the whole text, and
each distinct pair is judged as characters: letters of one script side by side speak for a code page; a capital after
a small letter, letters of two scripts in one word, signs inside words and undefined bytes speak against it. Frequent letters
and the alternation of vowels and consonants tell apart pages of the same script. Multi-byte encodings must decode without error and are
judged by their characters.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections import Counter
from functools import cache

import numpy as np

#: Pages in order of preference: an earlier one wins unless a later one is better by ``MARGIN`` for each byte.
SINGLE = ("cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253", "cp1255", "cp1256", "cp1254")
MULTI = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
MARGIN = 0.15

#: Letters that are frequent in the languages of a page, own selection; others of their script are possible but rare.
FREQUENT = {
    "cp1252": "éèàçêäöüßñóíáúôîâëïùœæøåãõ",
    "cp1250": "čěřšžůýáíéúąęłśżźćńóőűöüăâîşţđňťď",
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїє",
    "koi8_r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "cp866": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "cp1253": "αοιετνσηρπκυςμλάόέίήθγωδχύώβφξζψ",
    "cp1254": "ığşçöüİâî",
    "cp1255": "אבגדהוזחטיכךלמםנןסעפףצץקרשת",
    "cp1256": "ابتثجحخدذرزسشصضطظعغفقكلمنهويةىأإآئؤء",
}
#: The most frequent characters of running Chinese, simplified and traditional, own selection.
HAN = set("的一是不了人在有我他这個个们們中来來上大为為和国國地到以说說时時要就出会會可也你对對生能而子那得于着下自之年过過发發后後作里")
PUNCTUATION = set("“”‘’„‚–—…«»‹›•·€№§°©®™¿¡、。，．：；！？「」『』（）　・")


def _kind(c: str | None) -> str:
    """lower, upper, letter (without case), mark of punctuation, space, sign, or bad."""
    if c is None or "\x80" <= c <= "\x9f" or (c < " " and c not in "\t\n\r"):
        return "bad"
    if c.isspace() or c == "\xad":
        return "space"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if c.isalpha():
        return "letter"
    return "mark" if c in PUNCTUATION or c.isascii() else "sign"


def _script(c: str) -> str:
    return unicodedata.name(c, "X").split()[0]


def _vowel(c: str) -> bool:
    return unicodedata.normalize("NFD", c)[0].lower() in "aeiouyæœøаеиоуыэюяіїєαεηιουω"


@cache
def _values(page: str) -> np.ndarray:
    """The value of each pair of bytes in a code page."""
    chars = [bytes([b]).decode(page, "ignore") or None for b in range(256)]
    kinds = [_kind(c) for c in chars]
    scripts = [_script(c) if c else "" for c in chars]
    frequent = set(FREQUENT[page])
    out = np.zeros((256, 256))
    for a in range(256):
        for b in range(256):
            if a < 128 and b < 128:
                continue
            x, y, value = kinds[a], kinds[b], 0.0
            value -= 10.0 * ((x == "bad") + (y == "bad"))
            letters = [k in ("lower", "upper", "letter") for k in (x, y)]
            if all(letters):
                value += 1.5 if scripts[a] == scripts[b] else -6.0
                if x == "lower" and y == "upper":
                    value -= 6.0
                if scripts[a] == scripts[b]:
                    value += 0.5 if "letter" in (x, y) or _vowel(chars[a]) != _vowel(chars[b]) else -0.2
            elif any(letters):
                value -= 4.0 * ("sign" in (x, y))
                value -= 1.0 * (x == "sign" and b >= 128 or y == "sign" and a >= 128)
            for n, c, k in ((a, chars[a], x), (b, chars[b], y)):
                if n >= 128 and c and k in ("lower", "upper", "letter"):
                    value += 0.7 if c in frequent else 0.3 if c.lower() in frequent else -0.8
            out[a, b] = value
    return out.reshape(-1)


def _single(page: str, pairs: np.ndarray, counts: np.ndarray) -> float:
    return float((_values(page)[pairs] * counts).sum())


def _multi(name: str, raw: bytes) -> float | None:
    try:
        text = raw.decode(name)
    except UnicodeDecodeError:
        return None
    value = 0.0
    for c, n in Counter(c for c in text if not c.isascii()).items():
        script = _script(c)
        size = len(c.encode(name))
        if "\u3131" <= c <= "\u318e":  # parts of syllables do not stand alone
            each = -2.0
        elif script in ("HIRAGANA", "KATAKANA", "HANGUL"):
            each = 2.2
        elif script == "HALFWIDTH":
            each = -2.0
        elif script == "CJK":
            each = 0.3 if name == "euc_kr" else 2.2 if c in HAN else 1.1
        elif c in PUNCTUATION or script in ("FULLWIDTH", "IDEOGRAPHIC"):
            each = 1.0
        else:
            each = -3.0
        value += each * n * size
    return value


def detected(raw: bytes) -> str:
    """The name of the encoding; ``utf-8`` where the bytes are valid."""
    if raw.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    if raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int64)
    met = b[:-1] * 256 + b[1:]
    pairs, counts = np.unique(met[(b[:-1] >= 128) | (b[1:] >= 128)], return_counts=True)
    high = max(1, int((b >= 128).sum()))
    best, value = SINGLE[0], _single(SINGLE[0], pairs, counts) / high
    for name in (*SINGLE[1:], *MULTI):
        found = _multi(name, raw) if name in MULTI else _single(name, pairs, counts)
        if found is not None and found / high > value + MARGIN:
            best, value = name, found / high
    return best


def decoded(raw: bytes) -> str:
    """The text of bytes in whatever encoding; what an encoding does not define becomes a replacement character."""
    name = detected(raw)
    return raw.decode(name, errors="replace")
