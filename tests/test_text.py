"""Entities, cleaning, stems and chunked mapping."""

import random

import pytest
from pyspark.sql import functions as F

from postflow.functions import entities as en
from postflow.functions import text as tx
from postflow.functions.stem import english_stem, stem_tokens
from postflow.operators.tokens import clean_text, map_text


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string").coalesce(1)


def values(df, c):
    return [row[0] for row in df.orderBy("id").select(c).collect()]


def test_entities(spark):
    df = en.with_entities(texts(spark, "a #b @c foo@bar.com http://x.y/#z", "none", None, "WWW.x é #é_1"))
    assert values(df, "hashtags") == ["#b #z", "", None, "#é_1"]
    assert values(df, "usernames") == ["@c @bar", "", None, ""]
    assert values(df, "links") == ["http://x.y/#z", "", None, "WWW.x"]


def test_which_symbols_are_emoji(spark):
    found = "⏰ ⌚ ⬛ 🆕 🆗 🀄 ⭕ ❤️ ☝🏽 🏳️‍🌈 ©️ 👩‍❤‍👨"
    df = texts(spark, f"★ ♪ ✓ ➜ {found} ☀ © 1 #")
    assert values(df.withColumn("e", en.emoji("text")), "e") == [found]
    assert values(df.withColumn("t", tx.strip_emoji(F.col("text"))), "t")[0].split() == "★ ♪ ✓ ➜ ☀ © 1 #".split()


def test_emoji_and_names(spark):
    df = en.with_entities(texts(spark, "hi 👍🏽 ok ❤️ 👩‍💻 🇫🇷 end", "1️⃣ and 1"))
    assert values(df, "emojis") == ["👍🏽 ❤️ 👩‍💻 🇫🇷", "1️⃣"]
    assert values(df, "emoji_text") == [
        "thumbs up sign emoji modifier fitzpatrick type-4 heavy black heart woman "
        "personal computer regional indicator symbol letter f regional indicator symbol letter r",
        "digit one",
    ]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("a  b", "ab"),
        ("x\n\ny 12 z", "xy  z"),
        ("see www.a.b now", "see  now"),
        ("a@b.com", "a.com"),
        ("a  b", "ab"),
        ("٣ #tag end", "  end"),
    ],
)
def test_strip_noise(spark, text, clean):
    assert values(texts(spark, text), tx.strip_noise("text")) == [clean]


def test_strip_noise_can_keep_words_apart(spark):
    assert values(texts(spark, "a  b 12  c"), tx.strip_noise("text", "space")) == ["a b c"]


def test_stop_words_are_whole_words(spark):
    df = texts(spark, "don't the theme, the-cat a_the thé isn't")
    assert values(df, tx.drop_stop_words("text", tx.stop_list())) == ["'  theme, -cat a_the thé '"]


def test_stop_list_is_sorted_distinct_and_closed():
    stop = tx.stop_list()
    assert stop == sorted(set(stop)) and len(tx.ENGLISH_STOP_WORDS) == 179
    assert {"twitter", "nan", "a", "Z", "don't"} <= set(stop)
    assert set(tx.word_runs(["don't"])) == {"don", "t"}


def test_alternation_matches_its_words_only(spark):
    words = ["a", "an", "and", "be", "been", "x+y"]
    df = texts(spark, "a an and ands be bee been x y xy")
    assert values(df, tx.drop_stop_words("text", words)) == ["   ands  bee    xy"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("a–b", []),  # single letters are stop words
        ("cat–dog", ["catdog"]),  # other punctuation glues
        ("cat-dog", ["cat", "dog"]),  # ASCII punctuation splits
        ("the–cat", ["cat"]),
        ("the_cat list_x", ["cat", "list", "x"]),  # hidden by the underscore: English words only
        ("Élan straße œuf Ø", ["elan", "strasse", "oeuf"]),
        ("thé cat", ["cat"]),  # hidden by the accent
        ("wi😀th cat", ["cat"]),  # hidden by the emoji
        ("fo\u0301ot e\u0301te", ["foot", "te"]),  # a mark parts words before it is removed
        ("tab\tbed\x00room", ["tab", "bedroom"]),
        ("", []),
        (None, []),
        ("AREN'T Liking @bob #x http://a.b 12", ["liking"]),
    ],
)
def test_clean_text(spark, text, tokens):
    df = clean_text(texts(spark, text), stem_fn=None)
    assert values(df, "nonstem_tokens") == [tokens]


PIECES = ["the", "cat", "a", "é", "thé", "dón't", "list", "x", " ", "  ", "-", "_", "–", "’", "😀", "\u0301",
          "\x00", "\x1f", "\xa0", "\u2028", "\n", "ß", "Ⅷ", "²", "…", "ø", "日本", "가", "#", "$", "ﬁ", "ǆ"]


def test_the_short_ways_to_words_equal_the_long_way(spark):
    rng = random.Random(11)
    rows = ["".join(rng.choices(PIECES, k=rng.randrange(1, 9))) for _ in range(4000)]
    rows += ["".join(rng.choices(PIECES[:11], k=rng.randrange(1, 9))) for _ in range(1000)]
    df = texts(spark, *rows)
    for stop in (tx.stop_list(), ["cat"]):
        short = tx.words("text", stop, tx.ENGLISH_STOP_WORDS)
        long = tx.words_by_steps("text", stop, tx.ENGLISH_STOP_WORDS)
        assert df.filter(~F.equal_null(short, long)).collect() == []


def test_library_stop_words_are_dropped_even_if_the_first_list_lacks_them(spark):
    df = clean_text(texts(spark, "the fox ran"), stop=["fox"], stem_fn=None)
    assert values(df, "nonstem_tokens") == [["ran"]]


def test_clean_text_keeps_every_row_and_stems(spark):
    df = clean_text(texts(spark, "cats liked", None, "", "running dogs"))
    assert df.count() == 4
    assert values(df, "stem_tokens") == [["cat", "like"], [], [], ["run", "dog"]]


# Word pairs of the published algorithm description.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist
consistency consist consistently consist consolation consol knack knack knackeries knackeri
knaves knave knavish knavish kneading knead kneel kneel kneeling kneel knees knee knell knell
knelt knelt knightly knight knocker knocker knotty knotti knuckle knuckl
generously generous communities communiti arsenal arsenal hopping hop hoping hope
relational relat conditional condit flies fli dies die agreed agre feed feed gas gas kiwis kiwi
cry cri by by say say luxuriated luxuri happily happili fizzed fizz bled bled rolled roll
adoption adopt goodness good hopefulness hope analogously analog geology geolog
succeeding succeed skies sky news news singly singl dying die national nation easily easili
""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, stem):
    assert english_stem(word) == stem


def test_stem_tokens_takes_another_function_and_keeps_order(spark):
    df = spark.createDataFrame(
        [(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "id int, tokens array<string>"
    )
    assert values(df, stem_tokens("tokens", str.upper)) == [["B", "A", "B"], [], ["C"]]


def test_map_text_maps_whole_texts_in_chunks(spark):
    df = map_text(texts(spark, "abcdefg", "", None, "abc", "é😀x" * 2), lambda s: "<" + s + ">", chunk=3)
    assert values(df, "text") == ["<abc><def><g>", "", None, "<abc>", "<é😀x><é😀x>"]


def test_plans_stay_in_the_jvm_up_to_the_stems(spark):
    plan = clean_text(texts(spark, "x"), stem_fn=None)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    plan = clean_text(texts(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def test_literal_pattern_matches_everything_it_should(spark):
    assert values(texts(spark, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), tx.punctuation_to_space("text")) == [" "]
    assert values(texts(spark, "ab cd"), F.size(tx.split_words("text"))) == [2]
