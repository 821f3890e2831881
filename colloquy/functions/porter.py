"""Porter's suffix stripper (Porter 1980) for English words; other words pass unchanged.

A word is a run of consonants and vowels; its measure m counts the vowel runs
that a consonant run follows.  Each step replaces the longest matching suffix
if the stem before it meets a condition.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = "aeiou"
# Suffixes of steps 2 to 4 with their replacements; fixed values of the algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
         "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
         "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize").split()


def _shape(word: str) -> str:
    """One of c, v per letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in VOWELS or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


@lru_cache(maxsize=100_000)
def porter_stem(word: str) -> str:
    """Stem of a lower-case word of a-z; any other word is returned as it is."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    # 1a plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b past and progressive forms
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = _longest(w, ("ed", "ing"))
        if end and "v" in _shape(w[:-len(end)]):
            w = w[:-len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double_end(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    # 1c final y
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(w, table)
        if end and _measure(w[:-len(end)]) > 0:
            w = w[:-len(end)] + table[end]
    end = _longest(w, STEP4)
    if end and _measure(w[:-len(end)]) > 1 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[:-len(end)]
    # 5 final e and double l
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
