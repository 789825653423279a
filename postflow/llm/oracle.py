"""DuckDB SQL for those queries that SQL can express, by the plain definition of each result."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') s
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM t WHERE len(w) >= 35)),
    often AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
    hits AS (SELECT doc_id, i FROM g SEMI JOIN often USING (s)),
    words AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) i FROM t),
    marked AS (SELECT doc_id, i, word, max(CASE WHEN h.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id
               ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) gone
               FROM words LEFT JOIN hits h USING (doc_id, i)),
    kept AS (SELECT doc_id, sum(gone) n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) k
             FROM marked GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""

_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_CLASS}') w
              FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
          '{_CLASS}') w FROM benchmark),
    items AS (SELECT item, least(len(w), 13) k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
              lambda i: array_to_string(w[i:i + 12], ' '))) s FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT k FROM items),
    g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') s
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, sizes WHERE len(w) >= k)),
    hits AS (SELECT DISTINCT doc_id, i, g.k, item FROM g JOIN items ON items.s = g.s AND items.k = g.k),
    covered AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM hits)
                GROUP BY doc_id),
    found AS (SELECT doc_id, list_sort(list(DISTINCT item)) items FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
        sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
        coalesce(n > 0 AND 20 * n >= len(w), FALSE) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

_OP6 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
    good AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id a, b.vec_id b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id a, vec_id b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    own AS (SELECT a vec_id, min(b) component_id FROM reach GROUP BY a),
    counts AS (SELECT a vec_id, count(*) n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
    FROM own LEFT JOIN counts USING (vec_id)"""


def _weight(level: str) -> str:
    return f"""(SELECT greatest(1.0, least(1000.0, CASE WHEN v > 0 THEN p * (1 - p) / v - 1 ELSE 1000.0 END)) FROM (
        SELECT p, (squares - (m - 1) * p * (1 - p)) / nullif(spread, 0) v FROM (SELECT sum(bad) / sum(n) p, count(*) m,
        sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) squares, sum(n) - sum(n * n) / sum(n) spread
        FROM {level} WHERE n > 0)))"""


_RULES = [
    ("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("org", "/", "allow"),
]


def _rule(what) -> str:
    return "CASE " + " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{what(host, path, verdict)}'"
        for host, path, verdict in _RULES
    ) + " END"


_OP8 = f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')
            host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL
              THEN 0 END) bad FROM labels GROUP BY doc_id),
    counted AS (SELECT host, CAST(count(bad) AS DOUBLE) n, CAST(coalesce(sum(bad), 0) AS DOUBLE) bad
                FROM p LEFT JOIN marks ON doc_id = page_id GROUP BY host),
    split AS (SELECT *, string_split(host, '.') l FROM counted),
    sized AS (SELECT *, CASE WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
              THEN 2 ELSE 1 END k FROM split),
    hosts AS (SELECT host, n, bad, array_to_string(l[greatest(len(l) - k, 0) + 1:], '.') suffix,
              array_to_string(l[greatest(len(l) - k, 1):], '.') AS domain FROM sized),
    domains AS (SELECT suffix, domain, sum(n) n, sum(bad) bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) n, sum(bad) bad FROM domains GROUP BY ALL),
    s1 AS (SELECT suffix, (bad + {_weight("suffixes")} * (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) FROM suffixes))
           / (n + {_weight("suffixes")}) above FROM suffixes),
    d1 AS (SELECT suffix, domain, (bad + {_weight("domains")} * above) / (n + {_weight("domains")}) above
           FROM domains JOIN s1 USING (suffix)),
    h1 AS (SELECT host, (bad + {_weight("hosts")} * above) / (n + {_weight("hosts")}) m, n + {_weight("hosts")} size
           FROM hosts JOIN d1 USING (suffix, domain)),
    bounds AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (size + 1)) bound FROM h1)
    SELECT page_id, host, path, {_rule(lambda host, path, verdict: host + path)} AS rule,
        coalesce({_rule(lambda host, path, verdict: verdict)}, CASE WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM p JOIN bounds USING (host)"""

_MARKS = ["<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|end_of_text|>", "<|im_start|>",
          "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<s>", "</s>"]


def _escaped(text: str) -> str:
    text = rf"replace({text}, '\', '\\')"
    for mark in _MARKS:
        text = rf"replace({text}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return text


_SAID = "</s>[INST] ok [/INST]"
_OP11 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
    e AS (SELECT *, {_escaped("r")} || {_escaped("x")} s FROM t)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
        CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
        CAST(17 + sum(length(s) + 48) AS BIGINT) AS formatted_chars, CAST(17 + sum(strlen(s) + 48) AS BIGINT) AS formatted_bytes
    FROM e GROUP BY conv_id"""

_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda crc, b: list_reduce([CAST(i AS BIGINT) for i in range(8)], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)),
    4294967295), 4294967295)"""
_OP12 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) p, code, chars
        FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) code,
              length(coalesce(text, '')) chars FROM conversations WHERE conv_id IS NOT NULL)),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 head, {_CRC} % 6 h FROM t),
    r AS (SELECT c.conv_id, p, code, chars FROM c JOIN t ON t.conv_id = head WHERE p <= h
          UNION ALL SELECT conv_id, 5 + p, code, chars FROM c JOIN t USING (conv_id) WHERE p > h),
    s AS (SELECT conv_id, list(code ORDER BY p) codes, list(chars ORDER BY p) chars FROM r GROUP BY conv_id),
    x AS (SELECT conv_id, coalesce(codes, []) codes, coalesce(chars, []) chars FROM c LEFT JOIN s USING (conv_id)),
    m AS (SELECT conv_id, d, array_to_string(codes[1:d], '') k, CASE WHEN d > 0 THEN chars[d] ELSE 0 END ch, d = len(codes) AS ends
          FROM (SELECT *, unnest(range(0, len(codes) + 1)) d FROM x)),
    n AS (SELECT k, d, min(conv_id) conv_id, count(*) n, max(ch) ch,
          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) e FROM m GROUP BY k, d),
    kids AS (SELECT left(k, 32 * (d - 1)) k, count(*) kids FROM n WHERE d > 0 GROUP BY ALL),
    below AS (SELECT left(k, 32 * a) k, sum((n - 1) * ch) saved, count(*) FILTER (kids IS NULL) leaves
              FROM (SELECT *, unnest(range(0, d + 1)) a FROM n LEFT JOIN kids USING (k)) GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children,
        leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.e AS ends_sha256
    FROM n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN n p ON n.d > 0 AND p.k = left(n.k, 32 * (n.d - 1))"""


def _clusters(k: int, rounds: int) -> str:
    def nearest(t):
        return f"""(SELECT id, vec_id, v, d % {k} c, d // {k} away FROM (SELECT id, any_value(vec_id) vec_id, any_value(v) v,
            min(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {k} + c) d
            FROM kept, c{t} GROUP BY id))"""

    steps = [f"a0 AS MATERIALIZED {nearest(0)}"]
    for t in range(1, rounds + 1):
        steps += [
            f"""c{t} AS MATERIALIZED (SELECT c, coalesce(m, w) w FROM c{t - 1} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) m
            FROM (SELECT c, i, sum(x)::BIGINT s, count(*) n FROM (SELECT c, unnest(v) x, generate_subscripts(v, 1) i FROM a{t - 1})
            GROUP BY c, i) GROUP BY c) USING (c))""",
            f"a{t} AS MATERIALIZED {nearest(t)}",
        ]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () id, vec_id,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 c, v w FROM (SELECT *, sha256('2:' || vec_id) h FROM kept
            ORDER BY h LIMIT {k})), {", ".join(steps)}
        SELECT vec_id, CAST(c AS INT) AS cluster, away AS distance, CAST(sum(away) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(away) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE = {
    "op1_substring_dedup": _OP1, "op5_contamination": _OP5, "op6_embedding_dedup": _OP6, "op8_urls": _OP8,
    "op11_chat": _OP11, "op12_prefix_trie": _OP12, "op13_centroid_clusters": _clusters(40, 5),
}
