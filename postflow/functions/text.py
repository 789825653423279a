"""Text clean-up as Column expressions.

Character classes are spelled out because Java's ``\\w``, ``\\d`` and ``\\s`` are ASCII only, while
the results to match come from Unicode-aware classes.
"""

import re
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"

# Code points that Unicode shows as emoji by default (Emoji_Presentation), without the
# regional indicators, and those that it shows as text unless asked (Emoji but not Emoji_Presentation),
# without digits, # and *.
EMOJI_BY_DEFAULT = """
231A-231B 23E9-23EC 23F0 23F3 25FD-25FE 2614-2615 2648-2653 267F 2693 26A1 26AA-26AB 26BD-26BE
26C4-26C5 26CE 26D4 26EA 26F2-26F3 26F5 26FA 26FD 2705 270A-270B 2728 274C 274E 2753-2755 2757
2795-2797 27B0 27BF 2B1B-2B1C 2B50 2B55 1F004 1F0CF 1F18E 1F191-1F19A 1F201 1F21A 1F22F
1F232-1F236 1F238-1F23A 1F250-1F251 1F300-1F320 1F32D-1F335 1F337-1F37C 1F37E-1F393 1F3A0-1F3CA
1F3CF-1F3D3 1F3E0-1F3F0 1F3F4 1F3F8-1F43E 1F440 1F442-1F4FC 1F4FF-1F53D 1F54B-1F54E 1F550-1F567
1F57A 1F595-1F596 1F5A4 1F5FB-1F64F 1F680-1F6C5 1F6CC 1F6D0-1F6D2 1F6D5-1F6D9 1F6DC-1F6DF
1F6EB-1F6EC 1F6F4-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C
1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
""".split()
EMOJI_IF_ASKED = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 2328 23CF 23ED-23EF 23F1-23F2 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FC 2600-2604 260E 2611 2618 261D 2620 2622-2623 2626 262A 262E-262F
2638-263A 2640 2642 265F-2660 2663 2665-2666 2668 267B 267E 2692 2694-2697 2699 269B-269C 26A0
26A7 26B0-26B1 26C8 26CF 26D1 26D3 26E9 26F0-26F1 26F4 26F7-26F9 2702 2708-2709 270C-270D 270F
2712 2714 2716 271D 2721 2733-2734 2744 2747 2763-2764 27A1 2934-2935 2B05-2B07 3030 303D 3297
3299 1F170-1F171 1F17E-1F17F 1F202 1F237 1F321 1F324-1F32C 1F336 1F37D 1F396-1F397 1F399-1F39B
1F39E-1F39F 1F3CB-1F3CE 1F3D4-1F3DF 1F3F3 1F3F5 1F3F7 1F43F 1F441 1F4FD 1F549-1F54A 1F56F-1F570
1F573-1F579 1F587 1F58A-1F58D 1F590 1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3
1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA 1F6CB 1F6CD-1F6CF 1F6E0-1F6E5 1F6E9 1F6F0 1F6F3
""".split()


def _class(ranges) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    ends = [r.split("-") for r in ranges]
    return "".join("-".join(rf"\x{{{end}}}" for end in pair) for pair in ends)


_SHOWN, _ASKED = _class(EMOJI_BY_DEFAULT), _class(EMOJI_IF_ASKED)
_MARKS = r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]*[\x{E0020}-\x{E007F}]*"
#: Flags, keycaps, emoji, text-style symbols that ask for emoji style or a skin, and joined sequences.
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]{2}"
    r"|[0-9#*]\x{FE0F}?\x{20E3}"
    rf"|(?:[{_SHOWN}]|[{_ASKED}][\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]){_MARKS}(?:\x{{200D}}[{_SHOWN}{_ASKED}]{_MARKS})*"
)
# A few ranges that hold every emoji, tried first at each place of a text.
_MAYBE = r"#*0-9\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}"
#: The same matches, found faster by a regex engine that can look ahead.
EMOJI_AHEAD = rf"(?=[{_MAYBE}])(?:{EMOJI})"

_NOISE_MARKS = rf"http[^{SPACE}]+|www[^{SPACE}]+|@[{WORD}]+|#[{WORD}]+|\p{{Nd}}+"
_BLANKS = rf"[{SPACE}]{{2,}}"
_PUNCTUATION = "[" + re.escape(string.punctuation) + "]+"
_EMOJI_HINT = r"[\x{A9}\x{AE}\x{20E3}\x{231A}-\x{3299}\x{1F000}-\x{1FAFF}]"
# What splitting at non-letters would get wrong: in ASCII text, and in any text.
_ASCII_TRAPS = r"[\x00-\x08\x0e-\x1f_\x7f]"
_NOT_PLAIN = rf"[^\p{{L}}\p{{N}}{SPACE}!-\x5e\x60-~]"
_BETWEEN_WORDS = r"[^\p{L}\p{N}]+"

# The English stop words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Words of no weight in posts, next to all single letters.
EXTRA_STOP_WORDS = ["twitter", "birds", "lists", "list", "source", "am", "pm", "nan"]

# Letters that carry no separable accent.
LETTER_FOLDS = {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}


def stop_list(base=ENGLISH_STOP_WORDS, extra=EXTRA_STOP_WORDS, letters=True) -> list[str]:
    """The distinct, sorted stop words."""
    singles = string.ascii_letters if letters else ""
    return sorted({*base, *extra, *singles})


def word_runs(words) -> list[str]:
    """The stop words closed under splitting at apostrophes, lower-cased (Q3)."""
    return sorted({run for word in words for run in re.findall(r"\w+", word.lower())})


def _alternation(words) -> str:
    """A regex for a set of words that shares prefixes, so no word is tried in vain."""
    tails: dict[str, set[str]] = {}
    for word in words:
        tails.setdefault(word[0], set()).add(word[1:])
    branches = []
    for head, rest in sorted(tails.items()):
        longer = _alternation(rest - {""}) if rest - {""} else ""
        branches.append(
            re.escape(head) + (f"(?:{longer})" + "?" * ("" in rest) if longer else "")
        )
    return "|".join(branches)


def _choose(c, pattern: str, then) -> Column:
    """``then(c)`` for rows where ``pattern`` occurs, else ``c``.

    The text is bound to a lambda variable.  A plain CASE would name it three times, and when such
    expressions are nested, a filter that is pushed below them evaluates every copy.
    """
    chosen = F.transform(
        F.array(c), lambda text: F.when(text.rlike(pattern), then(text)).otherwise(text)
    )
    return F.get(chosen, F.lit(0))


def strip_noise(c, whitespace: str = "remove") -> Column:
    """Drop links, mentions, hashtags, digits and runs of blanks.

    ``remove`` glues words that were two blanks apart, as the results to match do (Q2); ``space``
    keeps them apart.
    """
    if whitespace == "remove":
        return F.regexp_replace(c, f"{_NOISE_MARKS}|{_BLANKS}", "")
    return F.regexp_replace(F.regexp_replace(c, _NOISE_MARKS, ""), _BLANKS, " ")


def drop_stop_words(c, words) -> Column:
    """Delete every whole word that is in ``words``; what stands around it stays.

    The group is atomic: at a word start only the longest listed prefix can end where the word does.
    """
    pattern = rf"(?<![{WORD}])(?>{_alternation(word_runs(words))})(?![{WORD}])"
    return F.regexp_replace(c, pattern, "")


def strip_emoji(c) -> Column:
    """Delete emoji.  A text without any emoji code point is passed through."""
    return _choose(c, _EMOJI_HINT, lambda text: F.regexp_replace(text, EMOJI_AHEAD, ""))


def punctuation_to_space(c) -> Column:
    """Each run of ASCII punctuation becomes one blank."""
    return F.regexp_replace(c, _PUNCTUATION, " ")


def _accent_table() -> tuple[str, str]:
    """Letters that decompose into one base letter and combining marks, and those base letters."""
    pairs = []
    for point in range(0xC0, 0x3100):
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and all(unicodedata.combining(mark) for mark in marks):
            pairs.append((chr(point), base))
    return "".join(letter for letter, _ in pairs), "".join(base for _, base in pairs)


def fold_accents(c) -> Column:
    """Letters without their diacritics."""
    accented, plain = _accent_table()
    folded = F.regexp_replace(F.translate(c, accented, plain), r"\p{Mn}+", "")
    for letter, plain in LETTER_FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def strip_residue(c) -> Column:
    """Delete what is neither word nor blank, which glues the words around it (Q6)."""
    return F.regexp_replace(c, rf"[^{WORD}{SPACE}]+", "")


def split_words(c) -> Column:
    """The words between blanks; an empty array for a blank text."""
    return F.array_remove(F.split(c, rf"[{SPACE}]+"), "")


def words_by_steps(c, stop, library_stop) -> Column:
    """T8-T11 step by step: stop words, emoji, punctuation, accents, stop words, residue, split."""
    step = strip_emoji(drop_stop_words(c, stop))
    step = fold_accents(punctuation_to_space(step))
    return split_words(strip_residue(drop_stop_words(step, library_stop)))


def is_ascii(c) -> Column:
    """Whether a text has as many characters as bytes, which is far cheaper than a regex."""
    return F.length(c) == F.octet_length(c)


def words(c, stop, library_stop) -> Column:
    """The words of a text.

    The steps matter where symbols stand inside words: underscores, emoji, combining marks, control
    characters and punctuation beyond ASCII.  In any other text words are what stands between
    non-letters, so dropping them from an array gives the same result for half the time.
    """
    first, second = word_runs(stop), word_runs(library_stop)

    def without(runs: Column, dropped) -> Column:
        return F.filter(runs, lambda run: ~run.isin("", *dropped))

    def way(text: Column) -> Column:
        runs = F.split(text, _BETWEEN_WORDS)
        folded = F.split(fold_accents(F.array_join(without(runs, first), " ")), " ")
        return (
            F.when(is_ascii(text) & ~text.rlike(_ASCII_TRAPS), without(runs, [*first, *second]))
            .when(~text.rlike(_NOT_PLAIN), without(folded, second))
            .otherwise(words_by_steps(text, stop, library_stop))
        )

    return F.get(F.transform(F.array(c), way), F.lit(0))
