"""Snowball English stems, computed on the distinct words of each Arrow batch.

A join with a stemmed vocabulary would shuffle every token twice.  Here a batch of token arrays is
dictionary-encoded, only its distinct words are stemmed, and the arrays are rebuilt from the codes,
so no row leaves its partition.
"""

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiouy"

#: Stems that a task remembers from one batch to the next.
MEMO_WORDS = 200_000

# Fixed values of the published algorithm: irregular words and words left alone.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_INVARIANT = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}

# Fixed values of the published algorithm: suffix replacements of steps 2 and 3, step 4 removals.
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
]


def _ending(suffixes) -> re.Pattern:
    """Splits a word before its longest listed suffix (the lazy head finds the earliest start)."""
    return re.compile(rf"(.*?)({'|'.join(suffixes)})")


_END_0 = _ending(["'s'", "'s", "'"])
_END_1A = _ending(["sses", "ied", "ies", "us", "ss", "s"])
_END_1B = _ending(["eedly", "eed", "edly", "ed", "ingly", "ing"])
_END_2 = _ending(_STEP_2)
_END_3 = _ending(_STEP_3)
_END_4 = _ending(_STEP_4)
_REGION = re.compile(rf"[{_VOWELS}][^{_VOWELS}]")
_LONG_PREFIX = re.compile("gener|commun|arsen")
_SHORT_END = re.compile(rf"(?:.*[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|[{_VOWELS}][^{_VOWELS}])")
_DOUBLE_END = re.compile(r".*(bb|dd|ff|gg|mm|nn|pp|rr|tt)")


def _has_vowel(part: str) -> bool:
    return any(letter in _VOWELS for letter in part)


def _regions(word: str) -> tuple[int, int]:
    """Start of R1 and of R2."""
    first = _LONG_PREFIX.match(word) or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def _plural(word: str) -> str:
    found = _END_1A.fullmatch(word)
    if not found:
        return word
    head, suffix = found.groups()
    if suffix == "sses":
        return head + "ss"
    if suffix in ("ied", "ies"):
        return head + ("i" if len(head) > 1 else "ie")
    if suffix == "s" and _has_vowel(head[:-1]):
        return head
    return word


def _past_or_gerund(word: str, r1: int) -> str:
    found = _END_1B.fullmatch(word)
    if not found:
        return word
    head, suffix = found.groups()
    if suffix in ("eed", "eedly"):
        return head + "ee" if len(head) >= r1 else word
    if not _has_vowel(head):
        return word
    if head.endswith(("at", "bl", "iz")):
        return head + "e"
    if _DOUBLE_END.fullmatch(head):
        return head[:-1]
    if len(head) <= r1 and _SHORT_END.fullmatch(head):
        return head + "e"
    return head


def _derivation(word: str, r1: int) -> str:
    found = _END_2.fullmatch(word)
    if not found or found.start(2) < r1:
        return word
    head, suffix = found.groups()
    if suffix == "ogi" and not head.endswith("l"):
        return word
    if suffix == "li" and head[-1:] not in tuple("cdeghkmnrt"):
        return word
    return head + _STEP_2[suffix]


def _inflection(word: str, r1: int, r2: int) -> str:
    found = _END_3.fullmatch(word)
    if not found or found.start(2) < (r2 if found[2] == "ative" else r1):
        return word
    return found[1] + _STEP_3[found[2]]


def _residue(word: str, r2: int) -> str:
    found = _END_4.fullmatch(word)
    if not found or found.start(2) < r2:
        return word
    if found[2] == "ion" and not found[1].endswith(("s", "t")):
        return word
    return found[1]


def _final_letter(word: str, r1: int, r2: int) -> str:
    last = len(word) - 1
    if word.endswith("e"):
        short = _SHORT_END.fullmatch(word[:-1])
        return word[:-1] if last >= r2 or (last >= r1 and not short) else word
    if word.endswith("ll") and last >= r2:
        return word[:-1]
    return word


def english_stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = word.removeprefix("'")
    word = re.sub(rf"^y|(?<=[{_VOWELS}])y", "Y", word)
    r1, r2 = _regions(word)
    possessive = _END_0.fullmatch(word)
    word = _plural(possessive[1] if possessive else word)
    if word in _INVARIANT:
        return word
    word = _past_or_gerund(word, r1)
    word = re.sub(rf"(?<=.[^{_VOWELS}])[yY]$", "i", word)
    word = _derivation(word, r1)
    word = _inflection(word, r1, r2)
    word = _residue(word, r2)
    word = _final_letter(word, r1, r2)
    return word.lower()


def stem_tokens(tokens, stem_fn: Callable[[str], str] = english_stem) -> Column:
    """The stems of a token array; ``stem_fn`` is called once per distinct word of a batch."""

    @F.arrow_udf("array<string>")
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = functools.lru_cache(maxsize=MEMO_WORDS)(stem_fn)
        for batch in batches:
            coded = batch.flatten().dictionary_encode()
            words = pa.array([known(word) for word in coded.dictionary.to_pylist()], pa.string())
            sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array([0, *sizes.cumsum()], pa.int32())
            yield pa.ListArray.from_arrays(offsets, words.take(coded.indices))

    return stems(tokens)
