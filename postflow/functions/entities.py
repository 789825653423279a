"""Entities found in a post.  Pure Column functions, row-local, no Python workers."""

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.text import EMOJI_AHEAD, EMOJI_BY_DEFAULT, EMOJI_IF_ASKED, SPACE, WORD

# The patterns of tags, mentions and links.
HASHTAG = rf"#[{WORD}]+"
MENTION = rf"@[{WORD}]+"
LINK = rf"(?i)http[^{SPACE}]+|www[^{SPACE}]+"


def _find_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def hashtags(c) -> Column:
    """Every ``#word``, joined with a space; null stays null."""
    return F.array_join(_find_all(c, HASHTAG), " ")


def mentions(c) -> Column:
    """Every ``@word``, which includes the domain part of an e-mail address."""
    return F.array_join(_find_all(c, MENTION), " ")


def links(c) -> Column:
    """Everything from ``http`` or ``www`` up to the next blank, in any letter case."""
    return F.array_join(_find_all(c, LINK), " ")


def emoji(c) -> Column:
    """T4: every emoji sequence, joined with a space."""
    return F.array_join(_find_all(c, EMOJI_AHEAD), " ")


def _named_code_points() -> str:
    """``<char>\\x1f<name>`` pairs for the code points an emoji sequence is made of."""
    spans = ["23", "2A", "30-39", "1F1E6-1F1FF", *EMOJI_BY_DEFAULT, *EMOJI_IF_ASKED]
    ends = [[int(end, 16) for end in span.split("-")] for span in spans]
    points = [point for pair in ends for point in range(pair[0], pair[-1] + 1)]
    pairs = ((chr(point), unicodedata.name(chr(point), None)) for point in points)
    return "\x1e".join(f"{char}\x1f{name.lower()}" for char, name in pairs if name)


def emoji_names(c) -> Column:
    """T5: the Unicode names of the emoji in ``c``, joined with a space.

    The name table is a constant-folded map, so only rows that hold an emoji pay for the lookup.
    Joiners, variation selectors and other code points without a visible shape have no name.
    """
    names = F.str_to_map(F.lit(_named_code_points()), F.lit("\x1e"), F.lit("\x1f"))
    chars = F.flatten(F.transform(_find_all(c, EMOJI_AHEAD), lambda found: F.split(found, "")))
    return F.array_join(F.transform(chars, lambda ch: F.try_element_at(names, ch)), " ")


def with_entities(posts: DataFrame, text: str = "text") -> DataFrame:
    """T1-T5 as columns of a posts table."""
    return posts.withColumns(
        {
            "hashtags": hashtags(text),
            "emojis": emoji(text),
            "emoji_text": emoji_names(text),
            "usernames": mentions(text),
            "links": links(text),
        }
    )
