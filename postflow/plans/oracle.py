"""The queries as DuckDB SQL over the same tables.

Classes, patterns and word lists are spelled out here once more, and the emoji properties are taken from
another source, so that an error in those of the Spark queries shows.
"""

import regex

from postflow.plans.tables import EMOJI_SAMPLES, EVENT_TYPES, LABELS

WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0D\x1C-\x1F\x20\x{85}\p{Z}"

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
STOP_WORDS = sorted(
    {*ENGLISH_STOP_WORDS, *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    | {"twitter", "birds", "lists", "list", "source", "am", "pm", "nan"}
)

# Letters that carry no separable accent.
LETTER_FOLDS = {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}


def word_runs(words) -> list[str]:
    """What is left of words that are cut at apostrophes."""
    return sorted({run for word in words for run in word.lower().split("'") if run})


def _property(expression: str) -> str:
    """The code points beyond ASCII with a Unicode property, as the inside of a character class."""
    points = "".join(chr(p) for p in range(0x80, 0x20000) if not 0xD800 <= p < 0xE000)
    found = [m.span() for m in regex.finditer(f"(?:{expression})+", points)]
    return "".join(rf"\x{{{ord(points[a]):X}}}-\x{{{ord(points[b - 1]):X}}}" for a, b in found)


_SHOWN = _property(r"(?=\p{Emoji_Presentation})[^\p{Regional_Indicator}]")
_ASKED = _property(r"(?=\p{Emoji})[^\p{Emoji_Presentation}]")
_SKIN = r"\x{1F3FB}-\x{1F3FF}"
_TAIL = rf"[\x{{FE0F}}{_SKIN}]*[\x{{E0020}}-\x{{E007F}}]*"
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}][\x{1F1E6}-\x{1F1FF}]|[#*0-9]\x{FE0F}?\x{20E3}"
    rf"|(?:[{_SHOWN}]|[{_ASKED}][\x{{FE0F}}{_SKIN}]){_TAIL}(?:\x{{200D}}[{_SHOWN}{_ASKED}]{_TAIL})*"
)

_RUNS = rf"[{WORD}]+|[^{WORD}]+"
_ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
_LOCAL = "CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_quote(word) for word in words) + "]"


def _noise(c: str) -> str:
    return (
        rf"regexp_replace({c}, 'http[^{SPACE}]+|www[^{SPACE}]+|@[{WORD}]+|#[{WORD}]+"
        rf"|\p{{Nd}}+|[{SPACE}]{{2,}}', '', 'g')"
    )


def _noise_spaced(c: str) -> str:
    marks = rf"http[^{SPACE}]+|www[^{SPACE}]+|@[{WORD}]+|#[{WORD}]+|\p{{Nd}}+"
    return rf"regexp_replace(regexp_replace({c}, '{marks}', '', 'g'), '[{SPACE}]{{2,}}', ' ', 'g')"


def _without(c: str, words) -> str:
    """Cut a text into word runs and other runs, leave out the listed ones, and join the rest."""
    return (
        f"coalesce(array_to_string(list_filter(regexp_extract_all({c}, '{_RUNS}'), "
        f"lambda r: NOT list_contains({_list(word_runs(words))}, r)), ''), '')"
    )


def _no_punctuation(c: str) -> str:
    return f"regexp_replace({c}, {_quote(_ASCII_PUNCTUATION)}, ' ', 'g')"


def _no_accents(c: str) -> str:
    c = f"strip_accents({c})"
    for letter, plain in LETTER_FOLDS.items():
        c = f"replace({c}, '{letter}', '{plain}')"
    return c


def _tokens(source: str, key: str, text: str) -> str:
    """CTEs ending in ``toks`` with (key, t)."""
    return f"""
    s1 AS (SELECT {key}, {_noise(f"lower(coalesce({text}, ''))")} x FROM {source}),
    s2 AS (SELECT {key}, {_without("x", STOP_WORDS)} x FROM s1),
    s3 AS (SELECT {key}, regexp_replace(x, '{EMOJI}', '', 'g') x FROM s2),
    s4 AS (SELECT {key}, {_no_accents(_no_punctuation("x"))} x FROM s3),
    s5 AS (SELECT {key}, {_without("x", ENGLISH_STOP_WORDS)} x FROM s4),
    s6 AS (SELECT {key}, regexp_replace(x, '[^{WORD}{SPACE}]+', '', 'g') x FROM s5),
    toks AS (SELECT {key}, list_filter(regexp_split_to_array(x, '[{SPACE}]+'),
                                       lambda w: w <> '') t FROM s6)"""


_WORDS = _tokens("documents", "doc_id", "text")
_EXPLODED = f"""{_WORDS},
    w AS (SELECT doc_id, unnest(t) word, generate_subscripts(t, 1) i FROM toks)"""

_POSTS = f"""
    posts AS (SELECT event_type AS "group", 'u' || user_id AS "user", event_id AS id, ts,
        CAST(floor(value) AS BIGINT) AS favorite_count,
        CAST(json_extract(props, '$.k') AS BIGINT) AS retweet_count, value, {_LOCAL} AS date
        FROM events)"""

_TEXT_POSTS = f"""{_POSTS},
    text_posts AS (SELECT p."group", p."user", p.id, p.ts, p.favorite_count, p.date,
        p.retweet_count, concat_ws(' ', d.text, '#' || p."group", '@' || p."user",
        'https://x.example/' || p.id,
        ({_list(EMOJI_SAMPLES)})[CAST(p.id % {len(EMOJI_SAMPLES)} AS INT) + 1]) AS text
        FROM posts p LEFT JOIN documents d ON p.id = d.doc_id)"""


def _joined(c: str, pattern: str) -> str:
    return f"array_to_string(regexp_extract_all({c}, '{pattern}'), ' ')"


def _emoji_names() -> str:
    import unicodedata

    names = {
        char: unicodedata.name(char).lower()
        for char in dict.fromkeys("".join(EMOJI_SAMPLES))
        if regex.match(r"[\p{Emoji}\p{Regional_Indicator}]", char)
    }
    case = " ".join(f"WHEN '{char}' THEN '{name}'" for char, name in names.items())
    chars = f"regexp_extract_all(array_to_string(regexp_extract_all(text, '{EMOJI}'), ''), '(?s).')"
    named = f"list_transform({chars}, lambda ch: CASE ch {case} END)"
    return f"coalesce(array_to_string(list_filter({named}, lambda n: n IS NOT NULL), ' '), '')"


def _frequency(n: int, denominator="(SELECT count(*) FROM g)") -> str:
    grams = f"list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
    return f"""WITH {_WORDS},
    e AS (SELECT unnest({grams}) gram FROM toks WHERE len(t) >= {n}),
    g AS (SELECT gram, count(*) AS frequency FROM e GROUP BY gram)
    SELECT gram, frequency, round(frequency / {denominator}, 9) AS relative_frequency FROM g"""


_UNI = f"""{_EXPLODED},
    uni AS (SELECT word, count(*) c FROM w GROUP BY word),
    v AS (SELECT count(*) v FROM uni)"""

_BIGRAM_BASE = f"""{_UNI},
    n AS (SELECT count(*) n FROM toks),
    pairs AS (SELECT a.doc_id, a.word w1, b.word w2 FROM w a
              JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
    bi AS (SELECT w1, w2, count(*) c FROM pairs GROUP BY w1, w2),
    firsts AS (SELECT t[1] word, count(*) c FROM toks WHERE len(t) > 0 GROUP BY 1),
    lasts AS (SELECT t[-1] word, count(*) c FROM toks WHERE len(t) > 0 GROUP BY 1),
    edges AS (SELECT doc_id, ln(f.c / n) + ln(l.c / n) e FROM toks, n, firsts f, lasts l
              WHERE len(t) > 1 AND f.word = t[1] AND l.word = t[-1])"""


def _bigram(ratio: str) -> str:
    return f"""WITH {_BIGRAM_BASE},
    chain AS (SELECT doc_id, sum(ln({ratio})) s FROM pairs JOIN bi USING (w1, w2)
              JOIN uni ON uni.word = w1, v GROUP BY doc_id)
    SELECT doc_id, round(s + e, 4) AS bigram_logprob
    FROM toks LEFT JOIN chain USING (doc_id) LEFT JOIN edges USING (doc_id)"""


_CHANNEL = f"""{_POSTS},
    channel AS (SELECT date, "group" AS "user", favorite_count, retweet_count,
        value AS unigram, retweet_count / 64 AS bigram FROM posts)"""

_COUNT_SUMS = (
    "CAST(sum(favorite_count) AS BIGINT) AS favorite_count, "
    "CAST(sum(retweet_count) AS BIGINT) AS retweet_count"
)
_CELLS = ", ".join(
    f"coalesce(sum(CASE WHEN \"user\" = '{u}' THEN {m} END), 0) AS {m}_{u}"
    for u in EVENT_TYPES
    for m in ("unigram", "bigram")
)
_CELL_NAMES = [f"{m}_{u}" for u in EVENT_TYPES for m in ("unigram", "bigram")]
_WIDE = f"""{_CHANNEL},
    wide AS (SELECT date, {_COUNT_SUMS}, {_CELLS} FROM channel GROUP BY date)"""


def _monday(date: str) -> str:
    return f"CAST({date} + CAST((8 - isodow({date})) % 7 AS INT) AS DATE)"


def _sums(names, cast=()) -> str:
    return ", ".join(
        f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS {c}" if c in cast else f"coalesce(sum({c}), 0) AS {c}"
        for c in names
    )


_ROLLED_NAMES = ["favorite_count", "retweet_count", *_CELL_NAMES]
_ROLLED = f"""{_WIDE},
    block AS (SELECT {_monday("date")} AS monday, * EXCLUDE (date) FROM wide
              WHERE isodow(date) IN (6, 7, 1)),
    calendar AS (SELECT CAST(unnest(generate_series(min(monday), max(monday), INTERVAL 7 DAYS)) AS DATE)
                 AS date FROM block),
    mondays AS (SELECT c.date, {_sums(_ROLLED_NAMES, ("favorite_count", "retweet_count"))}
                FROM calendar c LEFT JOIN block b ON b.monday = c.date GROUP BY c.date),
    rolled AS (SELECT * FROM wide WHERE isodow(date) NOT IN (6, 7, 1)
               UNION ALL BY NAME SELECT * FROM mondays)"""

_CLOSES = f"""
    closes AS (SELECT {_LOCAL} AS date, event_type AS ticker_name, arg_max(value, ts) AS close
               FROM events GROUP BY ALL)"""
_PRICES = f"""{_CLOSES},
    prices AS (SELECT date, {", ".join(
        f"coalesce(max(CASE WHEN ticker_name = '{t}' THEN close END), 0) AS {label}"
        for t, label in LABELS.items())} FROM closes GROUP BY date)"""
_FEATURE_NAMES = [*LABELS.values(), *_ROLLED_NAMES]
_FEATURES = f"""{_ROLLED}, {_PRICES},
    features AS (SELECT * FROM prices JOIN rolled USING (date))"""
_DAY = "CAST(date AS VARCHAR) AS date"


def _rounded(names, places=4) -> str:
    whole = ("favorite_count", "retweet_count")
    return ", ".join(c if c in whole else f"round({c}, {places}) AS {c}" for c in names)


_SCALED = [*LABELS.values(), "favorite_count", "retweet_count"]


def _scaled(columns, source: str, places=8) -> str:
    return ", ".join(
        f"round(({c} - (SELECT min({c}) FROM {source})) / nullif((SELECT max({c}) - min({c}) "
        f"FROM {source}), 0), {places}) AS {c}"
        for c in columns
    )


_LONG = f"""{_FEATURES},
    wide_values AS (SELECT date, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATURE_NAMES)}
                    FROM features),
    long AS (SELECT * FROM wide_values UNPIVOT INCLUDE NULLS
             (value FOR twitter_ticker IN ({", ".join(_FEATURE_NAMES)})))"""
_TOTALS_LONG = f"""{_POSTS},
    totals AS (SELECT date, CAST(sum(favorite_count) AS DOUBLE) AS favorite_count,
               CAST(sum(retweet_count) AS DOUBLE) AS retweet_count FROM posts GROUP BY date),
    long AS (UNPIVOT totals ON favorite_count, retweet_count INTO NAME twitter_ticker VALUE value)"""


def _uuid(date="CAST(date AS VARCHAR)") -> str:
    digest = f"md5({date} || '~' || twitter_ticker)"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in cuts)


def _target(day: int, value: str, over: str) -> str:
    frame = f"({over} ROWS BETWEEN {day - 2} PRECEDING AND 1 FOLLOWING)"
    return (
        f"CASE WHEN row_number() OVER ({over}) >= {day} AND lead({value}) OVER ({over}) IS NOT NULL "
        f"AND {value} > sum({value}) OVER {frame} / {day} THEN 1 ELSE 0 END AS y"
    )


_ROSTER = f"""{_POSTS},
    roster AS (SELECT DISTINCT "group", "user" FROM posts WHERE value >= 60)"""
_SPLIT = f"""{_POSTS},
    history AS (SELECT * FROM posts WHERE ts < TIMESTAMP '2024-01-16'),
    batch AS (SELECT * FROM posts WHERE ts >= TIMESTAMP '2024-01-13'),
    marks AS (SELECT "group", "user", max(id) m FROM history GROUP BY ALL),
    fresh AS (SELECT batch.* FROM batch LEFT JOIN marks USING ("group", "user")
              WHERE m IS NULL OR id > m)"""

_PIPELINE = f"""{_TEXT_POSTS}, {_tokens("text_posts", "id", "text")},
    w AS (SELECT id, unnest(t) word, generate_subscripts(t, 1) i FROM toks),
    uni AS (SELECT word, count(*) c FROM w GROUP BY word),
    v AS (SELECT count(*) v FROM uni), n AS (SELECT count(*) n FROM toks),
    pairs AS (SELECT a.id, a.word w1, b.word w2 FROM w a JOIN w b ON a.id = b.id AND b.i = a.i + 1),
    bi AS (SELECT w1, w2, count(*) c FROM pairs GROUP BY ALL),
    firsts AS (SELECT t[1] word, count(*) c FROM toks WHERE len(t) > 0 GROUP BY 1),
    lasts AS (SELECT t[-1] word, count(*) c FROM toks WHERE len(t) > 0 GROUP BY 1),
    edges AS (SELECT id, ln(f.c / n) + ln(l.c / n) e FROM toks, n, firsts f, lasts l
              WHERE len(t) > 1 AND f.word = t[1] AND l.word = t[-1]),
    us AS (SELECT id, sum(ln(c / v)) s FROM w JOIN uni USING (word), v GROUP BY id),
    bs AS (SELECT id, sum(ln(bi.c / uni.c)) b FROM pairs JOIN bi USING (w1, w2)
           JOIN uni ON uni.word = w1 GROUP BY id),
    logs AS (SELECT id, coalesce(s, 0) s, b + e AS b FROM toks LEFT JOIN us USING (id)
             LEFT JOIN bs USING (id) LEFT JOIN edges USING (id)),
    tops AS (SELECT max(s) s, max(b) b FROM logs),
    powers AS (SELECT id, exp(logs.s - tops.s) u, coalesce(exp(logs.b - tops.b), 0) b FROM logs, tops),
    scored AS (SELECT p.*, u / (SELECT sum(u) FROM powers) AS unigram,
               b / (SELECT sum(b) FROM powers) AS bigram FROM text_posts p JOIN powers USING (id)),
    marked AS (SELECT *, isodow(date) IN (6, 7, 1) AS inside, CASE WHEN isodow(date) IN (6, 7, 1)
               THEN {_monday("date")} ELSE date END AS day FROM scored),
    days AS (SELECT DISTINCT date AS day FROM marked WHERE NOT inside UNION
             SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 7 DAYS)) AS DATE)
             FROM marked WHERE inside),
    totals AS (SELECT days.day, coalesce(sum(favorite_count), 0) AS favorite_count,
               coalesce(sum(retweet_count), 0) AS retweet_count FROM days LEFT JOIN marked USING (day)
               GROUP BY days.day),
    {_PRICES.strip()},
    features AS (SELECT * FROM prices JOIN totals ON day = date
                 WHERE date < DATE '2024-02-01' AND date >= (SELECT min(date) FROM scored)),
    scaled AS (SELECT date, {", ".join(
        f"({c} - (SELECT min({c}) FROM features)) / nullif((SELECT max({c}) - min({c}) FROM features), 0) AS {c}"
        for c in [*LABELS.values(), "favorite_count", "retweet_count"])} FROM features),
    cells AS (SELECT f.date, u."user", coalesce(sum(unigram), 0) AS unigram, coalesce(sum(bigram), 0) AS bigram
              FROM features f CROSS JOIN (SELECT DISTINCT "user" FROM scored) u
              LEFT JOIN marked m ON m.day = f.date AND m."user" = u."user" GROUP BY ALL),
    long AS (SELECT * FROM scaled UNPIVOT INCLUDE NULLS (value FOR twitter_ticker IN ({", ".join(
        [*LABELS.values(), "favorite_count", "retweet_count"])}))
        UNION ALL SELECT date, 'unigram_' || "user" AS twitter_ticker, unigram AS value FROM cells
        UNION ALL SELECT date, 'bigram_' || "user" AS twitter_ticker, bigram AS value FROM cells)"""


def _cut(step: str, source: str, suffixes) -> str:
    """A step that parts each word before the longest of some suffixes."""
    return f"""{step} AS MATERIALIZED (SELECT *, left(w, length(w) - length(x)) h FROM (SELECT *, regexp_extract(w, '({"|".join(suffixes)})$', 1) x FROM {source}))"""


def _when(values) -> str:
    return "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


# Fixed values of the published stemming algorithm.
_STEM_WORDS = "skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli singly singl sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes".split()
_STEM_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
_STEM_2 = dict(zip(*[iter("""tional tion enci ence anci ance abli able entli ent izer ize ization ize ational ate ation ate ator ate alism al aliti al
    alli al fulness ful ousli ous ousness ous iveness ive iviti ive biliti ble bli ble ogi og fulli ful lessli less""".split())] * 2)) | {"li": ""}
_STEM_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEM_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_SHORT = "regexp_full_match({0}, '.*[^aeiouy][aeiouy][^aeiouywxY]|[aeiouy][^aeiouy]')"

#: (word, stem) of every word of ``toks``, step by step.
_STEMS = f"""g AS (SELECT DISTINCT unnest(t) word FROM toks),
    a AS (SELECT word, string_split(regexp_replace(word, '^''', ''), '') l FROM g),
    b AS (SELECT word, array_to_string(list_transform(l, lambda c, i: CASE WHEN c = 'y' AND (i = 1 OR regexp_matches(l[i - 1], '[aeiouy]'))
          THEN 'Y' ELSE c END), '') w FROM a),
    c AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN regexp_matches(w, '^commun') THEN 6
          WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END r1 FROM b),
    d AS (SELECT word, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]') THEN
          r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END r2,
          regexp_replace(w, '(''s''|''s|'')$', '') w FROM c),
    {_cut("e", "d", ["sses", "ied", "ies", "us", "ss", "s"])},
    f AS (SELECT word, r1, r2, CASE WHEN x = 'sses' THEN h || 'ss' WHEN x IN ('ied', 'ies') THEN h || CASE WHEN length(h) > 1 THEN 'i' ELSE 'ie' END
          WHEN x = 's' AND regexp_matches(left(h, greatest(length(h) - 1, 0)), '[aeiouy]') THEN h ELSE w END w FROM e),
    {_cut("h1", "f", ["eedly", "eed", "edly", "ed", "ingly", "ing"])},
    i AS (SELECT word, r1, r2, CASE WHEN w IN ({", ".join(f"'{k}'" for k in _STEM_KEPT)}) THEN w END fixed, CASE WHEN x = '' THEN w
          WHEN x IN ('eed', 'eedly') THEN CASE WHEN length(h) >= r1 THEN h || 'ee' ELSE w END WHEN NOT regexp_matches(h, '[aeiouy]') THEN w
          WHEN regexp_matches(h, '(at|bl|iz)$') THEN h || 'e' WHEN regexp_matches(h, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(h, length(h) - 1)
          WHEN length(h) <= r1 AND {_SHORT.format("h")} THEN h || 'e' ELSE h END w FROM h1),
    j AS (SELECT word, r1, r2, fixed, regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i') w FROM i),
    {_cut("k", "j", _STEM_2)},
    l2 AS (SELECT word, r1, r2, fixed, CASE WHEN x = '' OR length(h) < r1 OR (x = 'ogi' AND NOT regexp_matches(h, 'l$'))
           OR (x = 'li' AND NOT regexp_matches(h, '[cdeghkmnrt]$')) THEN w ELSE h || {_when(_STEM_2)} END w FROM k),
    {_cut("m", "l2", _STEM_3)},
    n AS (SELECT word, r1, r2, fixed, CASE WHEN x = '' OR length(h) < CASE WHEN x = 'ative' THEN r2 ELSE r1 END THEN w ELSE h || {_when(_STEM_3)} END w FROM m),
    {_cut("o", "n", _STEM_4)},
    p1 AS (SELECT word, r1, r2, fixed, CASE WHEN x = '' OR length(h) < r2 OR (x = 'ion' AND NOT regexp_matches(h, '[st]$')) THEN w ELSE h END w FROM o),
    q AS (SELECT word, fixed, CASE WHEN (w LIKE '%e' AND (length(w) > r2 OR (length(w) > r1 AND NOT {_SHORT.format("left(w, length(w) - 1)")})))
          OR (w LIKE '%ll' AND length(w) > r2) THEN left(w, length(w) - 1) ELSE w END w FROM p1),
    stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word {" ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in zip(_STEM_WORDS[::2], _STEM_WORDS[1::2]))}
          ELSE lower(coalesce(fixed, w)) END stem FROM q)"""
_STEMMED = f"""WITH {_EXPLODED}, {_STEMS}, s AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY i) d FROM w JOIN stems USING (word) GROUP BY doc_id)
    SELECT doc_id, CAST(len(t) AS BIGINT) AS words, md5(coalesce(d, '')) AS digest FROM toks LEFT JOIN s USING (doc_id)"""


ORACLE = {
    # entities
    "hashtags": f"WITH {_TEXT_POSTS} SELECT id, {_joined('text', f'#[{WORD}]+')} AS hashtags FROM text_posts",
    "mentions": f"SELECT doc_id, {_joined('text', f'@[{WORD}]+')} AS usernames FROM documents",
    "links": f"""WITH l AS (SELECT page_id, {_joined('html', f'(?i)http[^{SPACE}]+|www[^{SPACE}]+')} AS x
        FROM pages) SELECT page_id, CAST(length(x) AS INT) AS size, md5(x) AS links FROM l""",
    "emoji": f"WITH {_TEXT_POSTS} SELECT id, {_joined('text', EMOJI)} AS emojis FROM text_posts",
    "emoji_names": f"WITH {_TEXT_POSTS} SELECT id, {_emoji_names()} AS emoji_text FROM text_posts",
    "flat_posts": f"""WITH {_TEXT_POSTS} SELECT "group", "user", id,
        'https://twitter.com/i/web/status/' || id AS url, favorite_count, retweet_count,
        md5(text) AS text FROM text_posts WHERE "group" <> 'view'""",
    "cast_columns": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, TRY_CAST(source AS DOUBLE) AS source,
        CAST(n_chars AS DOUBLE) AS n_chars FROM documents""",
    "quarantined": """WITH raw AS (SELECT coalesce(nullif(lang, 'en'), CAST(doc_id AS VARCHAR)) id_str
        FROM documents) SELECT id_str, CASE WHEN TRY_CAST(id_str AS BIGINT) IS NULL THEN 'bad'
        ELSE 'good' END AS kind, count(*) AS records FROM raw GROUP BY ALL""",
    # text
    "strip_noise": f"SELECT doc_id, md5({_noise('lower(text)')}) AS digest FROM documents",
    "strip_noise_spaced": f"SELECT doc_id, md5({_noise_spaced('lower(text)')}) AS digest FROM documents",
    "drop_stop_words": f"SELECT doc_id, md5({_without('lower(text)', STOP_WORDS)}) AS digest FROM documents",
    "strip_emoji": f"""WITH {_TEXT_POSTS}
        SELECT id, md5(regexp_replace(text, '{EMOJI}', '', 'g')) AS digest FROM text_posts""",
    "fold_accents": f"""SELECT doc_id, md5({_no_accents(_no_punctuation('lower(text)'))}) AS digest
        FROM documents""",
    "clean_tokens": f"""WITH {_WORDS} SELECT doc_id, CAST(len(t) AS BIGINT) AS words,
        md5(coalesce(array_to_string(t, ' '), '')) AS digest FROM toks""",
    "clean_tokens_pages": f"""WITH {_tokens("pages", "page_id", "html")}
        SELECT page_id, CAST(len(t) AS BIGINT) AS words,
        md5(coalesce(array_to_string(t, ' '), '')) AS digest FROM toks""",
    "clean_tokens_posts": f"""WITH {_TEXT_POSTS}, {_tokens("text_posts", "id", "text")}
        SELECT id, CAST(len(t) AS BIGINT) AS words,
        md5(coalesce(array_to_string(t, ' '), '')) AS digest FROM toks""",
    "mapped_text": """SELECT doc_id, md5(coalesce(array_to_string(list_transform(
        regexp_extract_all(text, '(?s).{1,512}'), lambda p: '<' || p || '>'), ''), '')) AS digest
        FROM documents""",
    # n-grams
    "ngrams": f"""WITH {_WORDS}, g AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN
        list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) ELSE [] END gs
        FROM toks) SELECT doc_id, CAST(len(gs) AS BIGINT) AS grams,
        md5(coalesce(array_to_string(gs, '|'), '')) AS digest FROM g""",
    "unigram_freq": _frequency(1),
    "unigram_freq_of_total": _frequency(1, "(SELECT sum(frequency) FROM g)"),
    "bigram_freq": _frequency(2),
    "trigram_freq": _frequency(3),
    "quadgram_freq": _frequency(4),
    "pentagram_freq": _frequency(5),
    "first_last_words": f"""WITH {_WORDS}
        SELECT 'first' AS side, t[1] AS word, count(*) AS frequency FROM toks WHERE len(t) > 0 GROUP BY ALL
        UNION ALL
        SELECT 'last' AS side, t[-1] AS word, count(*) AS frequency FROM toks WHERE len(t) > 0 GROUP BY ALL""",
    # scores
    "unigram_score": f"""WITH {_UNI}, s AS (SELECT doc_id, sum(ln(c / v)) s FROM w JOIN uni USING (word), v
        GROUP BY doc_id)
        SELECT doc_id, round(coalesce(s, 0), 4) AS unigram_logprob FROM toks LEFT JOIN s USING (doc_id)""",
    "bigram_score": _bigram("bi.c / uni.c"),
    "post_scores": f"""WITH {_BIGRAM_BASE},
        s AS (SELECT doc_id, sum(ln(c / v)) s FROM w JOIN uni USING (word), v GROUP BY doc_id),
        chain AS (SELECT doc_id, sum(ln(bi.c / uni.c)) b FROM pairs JOIN bi USING (w1, w2)
                  JOIN uni ON uni.word = w1 GROUP BY doc_id)
        SELECT doc_id, round(coalesce(s, 0), 4) AS unigram_logprob, round(b + e, 4) AS bigram_logprob
        FROM toks LEFT JOIN s USING (doc_id) LEFT JOIN chain USING (doc_id)
        LEFT JOIN edges USING (doc_id)""",
    "bigram_score_smoothed": _bigram("(bi.c + 1) / (uni.c + v)"),
    "trigram_score": f"""WITH {_EXPLODED},
        tri AS (SELECT a.doc_id, a.word w1, b.word w2, c.word w3 FROM w a
            JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1
            JOIN w c ON a.doc_id = c.doc_id AND c.i = a.i + 2),
        pairs AS (SELECT a.word w1, b.word w2, count(*) c FROM w a
            JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 GROUP BY ALL),
        tc AS (SELECT w1, w2, w3, count(*) c FROM tri GROUP BY ALL),
        s AS (SELECT doc_id, sum(ln(tc.c / pairs.c)) s FROM tri JOIN tc USING (w1, w2, w3)
            JOIN pairs USING (w1, w2) GROUP BY doc_id)
        SELECT doc_id, round(s, 4) AS trigram_logprob FROM toks LEFT JOIN s USING (doc_id)""",
    "relative_score": f"""WITH {_UNI}, m AS (SELECT doc_id, avg(c / v) m FROM w JOIN uni USING (word), v
        GROUP BY doc_id)
        SELECT doc_id, round(coalesce(m, 0) / (SELECT sum(m) FROM m), 10) AS relative_probability
        FROM toks LEFT JOIN m USING (doc_id)""",
    "score_share": f"""WITH {_UNI}, s AS (SELECT doc_id, coalesce(sum(ln(c / v)), 0) s
        FROM toks LEFT JOIN w USING (doc_id) LEFT JOIN uni USING (word), v GROUP BY doc_id),
        p AS (SELECT doc_id, exp(s - (SELECT max(s) FROM s)) p FROM s)
        SELECT doc_id, round(p / (SELECT sum(p) FROM p), 8) AS share,
        round(s - (SELECT max(s) FROM s) - (SELECT ln(sum(p)) FROM p), 4) AS log_share FROM p JOIN s USING (doc_id)""",
    "tf_idf": f"""WITH {_EXPLODED}, tf AS (SELECT doc_id, word AS term, count(*) AS frequency FROM w GROUP BY ALL),
        idf AS (SELECT term, ln(((SELECT count(*) FROM toks) + 1) / (count(*) + 1)) v FROM tf GROUP BY term)
        SELECT doc_id, term, frequency, round(frequency * v, 6) AS tf_idf FROM tf JOIN idf USING (term)""",
    "share_of_total": f"""WITH {_POSTS} SELECT id,
        round(value / (SELECT sum(value) FROM posts), 12) AS value_share,
        round(retweet_count / (SELECT sum(retweet_count) FROM posts), 12) AS retweet_count_share
        FROM posts""",
    # users and days
    "oldest_users": f"""WITH {_POSTS}, f AS (SELECT "user", min(ts) AS ts FROM posts GROUP BY 1)
        SELECT "user", rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS first_post
        FROM f ORDER BY ts, "user" LIMIT 5""",
    "posts_per_user": f"""WITH {_POSTS} SELECT "user", count(*) AS posts FROM posts GROUP BY 1""",
    "posts_per_group": f"""WITH {_POSTS} SELECT "group", count(*) AS posts FROM posts GROUP BY 1""",
    "distinct_users": f"""WITH {_POSTS} SELECT count(DISTINCT "user") AS users FROM posts""",
    "local_day": f"WITH {_POSTS} SELECT id, {_DAY} FROM posts",
    "posts_per_day_name": f"""WITH {_POSTS}
        SELECT dayname(date) AS day, count(*) AS posts FROM posts GROUP BY 1""",
    "daily_totals": f"WITH {_POSTS} SELECT {_DAY}, {_COUNT_SUMS} FROM posts GROUP BY posts.date",
    "daily_by_user": f"""WITH {_POSTS} SELECT {_DAY}, "user", round(sum(value), 4) AS unigram,
        {_COUNT_SUMS} FROM posts GROUP BY posts.date, "user" """,
    "daily_pivot": f"WITH {_WIDE} SELECT {_DAY}, {_rounded(_ROLLED_NAMES)} FROM wide",
    "weekend_roll": f"WITH {_ROLLED} SELECT {_DAY}, {_rounded(_ROLLED_NAMES)} FROM rolled",
    "weekend_roll_by_user": f"""WITH {_POSTS},
        d AS (SELECT date, "user", sum(value) AS unigram, {_COUNT_SUMS} FROM posts GROUP BY date, "user"),
        block AS (SELECT {_monday("date")} AS monday, * EXCLUDE (date) FROM d
                  WHERE isodow(date) IN (6, 7, 1)),
        calendar AS (SELECT "user", CAST(unnest(generate_series(min(monday), max(monday),
                     INTERVAL 7 DAYS)) AS DATE) AS date FROM block GROUP BY "user"),
        rolled AS (SELECT c.date, c."user", coalesce(sum(unigram), 0) AS unigram,
            coalesce(CAST(sum(favorite_count) AS BIGINT), 0) AS favorite_count,
            coalesce(CAST(sum(retweet_count) AS BIGINT), 0) AS retweet_count FROM calendar c
            LEFT JOIN block b ON b.monday = c.date AND b."user" = c."user" GROUP BY ALL)
        SELECT {_DAY}, "user", round(unigram, 4) AS unigram, favorite_count, retweet_count FROM (
            SELECT * FROM d WHERE isodow(date) NOT IN (6, 7, 1) UNION ALL BY NAME SELECT * FROM rolled) x""",
    "latest_days": f"""WITH {_POSTS} SELECT CAST(posts.date AS VARCHAR) AS date, {_COUNT_SUMS} FROM posts
        GROUP BY posts.date ORDER BY posts.date DESC LIMIT 5""",
    # prices and features
    "prices_daily": f"WITH {_CLOSES} SELECT {_DAY}, ticker_name, close FROM closes",
    "price_range": f"""WITH {_CLOSES} SELECT {_DAY}, ticker_name, close FROM closes
        WHERE closes.date >= DATE '2024-01-05' AND closes.date < DATE '2024-01-20'""",
    "prices_wide": f"WITH {_PRICES} SELECT {_DAY}, * EXCLUDE (date) FROM prices",
    "latest_price": """SELECT event_type AS ticker_name, value AS close,
        rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS ts
        FROM events WHERE ts = (SELECT max(ts) FROM events)""",
    "latest_price_per_ticker": """WITH l AS (SELECT event_type AS ticker_name, arg_max(value, ts) AS close,
        max(ts) AS ts FROM events GROUP BY 1)
        SELECT ticker_name, close, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS ts
        FROM l""",
    "features": f"WITH {_FEATURES} SELECT {_DAY}, {_rounded(_FEATURE_NAMES)} FROM features",
    "minmax": f"""WITH {_FEATURES} SELECT {_DAY}, {_scaled(_SCALED, "features")},
        {_rounded(_CELL_NAMES, 8)} FROM features""",
    "minmax_stats": f"WITH {_FEATURES} " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM features"
        for c in _SCALED
    ),
    "minmax_ref": f"""WITH {_FEATURES}, totals AS (SELECT date, {_COUNT_SUMS} FROM posts GROUP BY date)
        SELECT {_DAY}, {_scaled(["favorite_count", "retweet_count"], "features")} FROM totals""",
    "latest_features": f"""WITH {_FEATURES},
        day AS (SELECT {_LOCAL} AS date FROM events ORDER BY ts DESC LIMIT 1),
        last AS (SELECT event_type, arg_max(value, ts) AS close FROM events GROUP BY 1),
        latest AS (SELECT (SELECT date FROM day) AS date, {", ".join(
            f"max(CASE WHEN event_type = '{t}' THEN close END) AS {label}" for t, label in LABELS.items()
        )} FROM last),
        now AS (SELECT * FROM latest JOIN rolled USING (date))
        SELECT {_DAY}, {_scaled(_SCALED, "features")}, {_rounded(_CELL_NAMES, 8)} FROM now""",
    "target": f"""WITH {_CLOSES} SELECT {_DAY}, ticker_name, close,
        {_target(5, "close", "PARTITION BY ticker_name ORDER BY closes.date")} FROM closes""",
    "target_wide": f"""WITH {_PRICES} SELECT {_DAY}, * EXCLUDE (date),
        {_target(3, "px_view", "ORDER BY prices.date")} FROM prices""",
    # keys and items
    "features_long": f"WITH {_LONG} SELECT {_DAY}, twitter_ticker, round(value, 4) AS value FROM long",
    "keyed_long": f"""WITH {_LONG} SELECT {_DAY}, twitter_ticker, round(value, 4) AS value,
        CASE WHEN long.date < DATE '2024-01-15' THEN 'old-' || twitter_ticker
        ELSE {_uuid("CAST(long.date AS VARCHAR)")} END AS uuid FROM long""",
    "items": f"""WITH {_TOTALS_LONG} SELECT {_uuid("CAST(long.date AS VARCHAR)")} AS uuid_s,
        CAST(date AS VARCHAR) AS date_s, twitter_ticker AS ticker_s, value AS value_n FROM long""",
    # rosters and increments
    "roster_long": f"""WITH {_ROSTER} SELECT "group", "user" FROM roster""",
    "roster_keep": f"""WITH {_ROSTER} SELECT "group", "user", id FROM posts
        SEMI JOIN roster USING ("group", "user")""",
    "roster_pruned": f"""WITH {_ROSTER} SELECT "group", "user", id FROM posts
        ANTI JOIN roster USING ("group", "user")""",
    "incremental_new": f"""WITH {_SPLIT} SELECT "group", "user", id FROM fresh""",
    "incremental_append": f"""WITH {_SPLIT} SELECT "group", "user", id FROM fresh
        UNION ALL SELECT "group", "user", id FROM history""",
    "id_marks": f"""WITH {_POSTS} SELECT "group", "user", max(id) AS max_id, min(id) AS min_id
        FROM posts GROUP BY "group", "user" """,
    "since": f"""WITH {_POSTS} SELECT "group", "user", id FROM posts
        WHERE ts > TIMESTAMP '2024-01-10 12:00:00'
        AND id <= (SELECT max(id) FROM posts WHERE "user" = (SELECT max("user") FROM posts))""",
    "user_concat": f"""WITH {_POSTS} SELECT "group", id, CAST(favorite_count AS DOUBLE) AS favorite_count
        FROM posts
        WHERE "group" IN ('click', 'view') UNION ALL BY NAME
        SELECT id, "group", CAST(retweet_count AS DOUBLE) AS retweet_count FROM posts WHERE "group" NOT IN ('click', 'view')""",
    "distinct_posts": f"""WITH {_POSTS} SELECT DISTINCT "user", id FROM posts""",
    # streams
    "stream_ingest": f"""WITH {_TEXT_POSTS} SELECT "group", "user", id, favorite_count,
        {_joined('text', f'#[{WORD}]+')} AS hashtags, {_joined('text', EMOJI)} AS emojis,
        {_joined('text', f'@[{WORD}]+')} AS usernames,
        {_joined('text', f'(?i)http[^{SPACE}]+|www[^{SPACE}]+')} AS links, md5(text) AS text
        FROM text_posts WHERE "group" <> 'view'""",
    "stream_dedup": f"""WITH {_TEXT_POSTS} SELECT "group", "user", id, md5(text) AS text FROM text_posts
        WHERE "group" <> 'view'""",
    "stream_upsert": f"""WITH {_TOTALS_LONG} SELECT {_DAY}, twitter_ticker,
        value * CASE WHEN long.date >= DATE '2024-01-25' THEN 3 WHEN long.date >= DATE '2024-01-10' THEN 2 ELSE 1 END AS value,
        {_uuid("CAST(long.date AS VARCHAR)")} AS uuid FROM long""",
    "pipeline_long": f"""WITH {_PIPELINE} SELECT {_DAY}, twitter_ticker, round(value, 10) AS value,
        {_uuid("CAST(long.date AS VARCHAR)")} AS uuid FROM long""",
    # files, stages and tables
    "user_csv": """SELECT coalesce(lang, 'none') AS "group", coalesce(source, 'none') AS "user", doc_id AS id, md5(text) AS text,
        n_chars AS favorite_count FROM documents""",
    "user_files": """WITH d AS (SELECT doc_id, coalesce(lang, 'none') g, coalesce(source, 'none') u, text, n_chars, doc_id % 7 k,
            CASE WHEN regexp_matches(text, '[,"\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END q FROM documents)
        SELECT g AS "group", u AS "user", CASE WHEN k BETWEEN 1 AND 3 THEN -1 ELSE doc_id END AS id, md5(CASE k
            WHEN 1 THEN 'x' || doc_id || ',,,' || n_chars || ',,,,,,,' || q WHEN 2 THEN doc_id || ',,,many,,,,,,,' || q
            WHEN 3 THEN doc_id || ',2024-01-01' ELSE text END) AS text, CASE WHEN k BETWEEN 1 AND 3 THEN NULL ELSE n_chars END::DOUBLE
            AS favorite_count, CASE k WHEN 1 THEN 'id' WHEN 2 THEN 'favorite_count' WHEN 3 THEN 'fields' END AS cause FROM d
        UNION ALL SELECT DISTINCT g, u, -1, md5('77,"it never ends'), NULL, 'quote' FROM d""",
    "roster_files": f"""WITH {_ROSTER} SELECT "group", "user" FROM roster""",
    "ticker_table": "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', '{label}')" for t, label in LABELS.items()) + ") x(ticker_name, ticker_label)",
    "stage_copy": f"WITH {_POSTS} SELECT {_DAY}, {_COUNT_SUMS} FROM posts GROUP BY posts.date",
    "item_files": f"""WITH {_TOTALS_LONG} SELECT {_uuid("CAST(long.date AS VARCHAR)")} AS uuid_s,
        CAST(date AS VARCHAR) AS date_s, twitter_ticker AS ticker_s, value AS value_n FROM long""",
    "versioned_posts": f"""WITH {_POSTS}, v AS (SELECT *, unnest([1, 2, 3]) version FROM posts)
        SELECT CAST(version AS BIGINT) AS version, "group", count(*) AS posts, round(sum(value), 4) AS value FROM v
        WHERE (version > 1 OR value < 50) AND (version < 3 OR "group" <> 'click' OR value < 10) GROUP BY ALL""",
    "delivered_items": f"""WITH {_POSTS}, t AS (SELECT DISTINCT date, 'unigram_' || "user" AS twitter_ticker FROM posts),
        u AS (SELECT {_uuid()} AS uuid FROM t)
        SELECT uuid, CASE WHEN left(uuid, 1) IN ('0', '7') THEN 2 ELSE 1 END::BIGINT AS attempt FROM u""",
    "saved_table": "SELECT lang, count(*) AS documents FROM documents GROUP BY lang",
    "sql_view": "SELECT source, max(n_chars) AS longest FROM documents GROUP BY source",
    "scored_posts": f"""WITH {_BIGRAM_BASE},
        s AS (SELECT doc_id, sum(ln(c / v)) s FROM w JOIN uni USING (word), v GROUP BY doc_id)
        SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS words, CAST(greatest(len(t) - 1, 0) AS BIGINT) AS bigrams,
        CAST(greatest(len(t) - 4, 0) AS BIGINT) AS pentagrams, round(coalesce(s, 0), 4) AS unigram_logprob
        FROM toks LEFT JOIN s USING (doc_id)""",
    "unscored_left_out": f"WITH {_WORDS} SELECT doc_id FROM toks WHERE len(t) > 1",
    "parsed_posts": f"""WITH {_TEXT_POSTS}, roster AS (SELECT DISTINCT "group", "user" FROM posts WHERE value >= 60)
        SELECT "group", "user", id, md5(text) AS text FROM text_posts SEMI JOIN roster USING ("group", "user")
        WHERE "group" <> 'view'""",
    # models, by what must hold for each row
    "word_vectors": f"WITH {_EXPLODED} SELECT DISTINCT word, 8 AS size FROM w",
    "cooccurrence_vectors": f"""WITH {_EXPLODED},
        once AS (SELECT a.word a, b.word b FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i IN (a.i + 1, a.i + 2)),
        n AS (SELECT word, other, count(*) n FROM (SELECT a AS word, b AS other FROM once UNION ALL SELECT b, a FROM once) GROUP BY ALL),
        m AS (SELECT word, sum(n) m FROM n GROUP BY word),
        weights AS (SELECT n.word, n.other, ln(n.n::DOUBLE * (SELECT sum(m) FROM m) / (a.m::DOUBLE * b.m)) g FROM n JOIN m a USING (word)
                    JOIN m b ON b.word = n.other WHERE n.n * (SELECT sum(m) FROM m) > a.m * b.m),
        words AS (SELECT DISTINCT word FROM w),
        x0 AS (SELECT word, {", ".join(f"('0x' || substr(md5(word || ':{k}:0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5 AS x{k}" for k in (0, 1))} FROM words),
        x1 AS (SELECT g.word, sum(g * x0) x0, sum(g * x1) x1 FROM weights g JOIN x0 ON x0.word = g.other GROUP BY ALL),
        x2 AS (SELECT g.word, sum(g * x0) x0, sum(g * x1) x1 FROM weights g JOIN x1 ON x1.word = g.other GROUP BY ALL),
        gram AS (SELECT sum(x0 * x0) p, sum(x0 * x1) q, sum(x1 * x1) r FROM x2),
        x AS (SELECT word, coalesce(x0, 0) x0, coalesce(x1, 0) x1 FROM words LEFT JOIN x2 USING (word)),
        f AS (SELECT x0 f0, x1 f1 FROM x ORDER BY word LIMIT 1)
        SELECT word, round((r * x0 * x0 - 2 * q * x0 * x1 + p * x1 * x1) / (p * r - q * q), 8) + 0 AS own,
        round((r * x0 * f0 - q * (x0 * f1 + x1 * f0) + p * x1 * f1) / (p * r - q * q), 8) + 0 AS with_first FROM x, gram, f""",
    "hard_clusters": "SELECT vec_id, TRUE AS nearest FROM embeddings",
    "stem_tokens": _STEMMED,
    "dictionary_stems": _STEMMED,
    "stem_dictionary": f"WITH {_WORDS}, {_STEMS} SELECT word, stem FROM stems",
    "incremental_bigrams": _frequency(2),
    "users_between": f"""WITH {_POSTS} SELECT "group", count(DISTINCT "user") AS users, TRUE AS close FROM posts
        WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL""",
    "fuzzy_clusters": "SELECT vec_id, 1.0::DOUBLE AS total, TRUE AS follows, TRUE AS still FROM embeddings",
    "soft_clusters": "SELECT vec_id, 1.0::DOUBLE AS total, TRUE AS bounded FROM embeddings",
    "principal_components": """SELECT round(sum(v), 6) AS variance FROM (SELECT var_samp(CAST(x AS DOUBLE)) v
        FROM (SELECT unnest(embedding) x, generate_subscripts(embedding, 1) k FROM embeddings) GROUP BY k)""",
}
