import numpy as np
import pandas as pd
import pytest
from helpers import fold

from postflow.llm import langid, urls
from postflow.llm.queries import URL_RULES, language_profiles

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, language_profiles(docs), keep=("lang",)).toPandas()
    held_out = found[[fold(i, 4) == 2 for i in found.doc_id]]
    assert len(held_out) > 30 and (held_out.lang == held_out.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_odd_texts(table, prose):
    english = [(1000 + i, "the house and the garden of the old man with the thing") for i in range(5)]
    docs = table([*prose, *english, (None, "the garden"), (7, None)])
    profiles = langid.learn(docs.selectExpr("doc_id", "text", "case when doc_id >= 1000 then 'en' end as lang"))
    assert profiles.langs == ["en"]
    found = langid.predict(docs, profiles).collect()
    assert len(found) == len(prose) + 7
    texts = dict(prose)
    for r in found:
        if r.doc_id is not None and r.doc_id < 1000 and not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
    nothing = langid.Profiles([], np.zeros((0, langid.SIZE), np.float32))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), profiles).count() == 0
    assert langid.learn(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).langs == []


def test_bundles_are_sums_of_bound_letters():
    letters = langid._letter_vectors(np.array([32, 97, 98]), 256)
    blank, a, b = letters
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    found, has = langid.bundles(["A--b", None, "1"], 256)
    assert np.array_equal(found[0], bind(blank, a, blank) + bind(a, blank, b) + bind(blank, b, blank))
    assert has.tolist() == [True, False, False]
    assert langid.bundles(["ab" * 500], 256)[0].shape == (1, 256)


def test_learning_from_a_bounded_number(table):
    docs = table([(i, "some words here") for i in range(400)]).selectExpr("doc_id", "text", "'en' as lang")
    assert langid.learn(docs, most=50).langs == ["en"]


HOSTS = [
    ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("x://org/", "org", "/", "org/", "allow"),
    ("http://b.org", "b.org", "", None, None),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/http://y.org/", "x.com", "/de/http://y.org/", "com/de/", "block"),
    ("http://xcom/de/", "xcom", "/de/", None, None),
    ("http://ÄB.com?q=/de/", "Äb.com", "", None, None),
    ("no scheme/x", "", "", None, None),
    (None, "", "", None, None),
    ("http:///only/path", "", "/only/path", None, None),
    ("a\nb://h\n.org/p\nq", "h\n.org", "/p\nq", "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, h[0], "x", 1) for i, h in enumerate(HOSTS)], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([], "id long, bad int")
    found = sorted(urls.filter_urls(pages, labels, URL_RULES).collect(), key=lambda r: r.page_id)
    for r, (_, host, path, rule, verdict) in zip(found, HOSTS, strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.filter_urls(pages.limit(0), labels, URL_RULES).count() == 0


def test_domains(spark):
    cases = {"a.b.example.com": ("com", "example.com"), "a.b.co.uk": ("co.uk", "b.co.uk"), "com": ("com", "com"), "co.uk": ("co.uk", "co.uk"), "": ("", ""), "a..b": ("b", ".b")}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    for r in df.select("h", urls.suffix_of(df.h).alias("s"), urls.domain_of(df.h).alias("d")).collect():
        assert (r.s, r.d) == cases[r.h]


def weight(rows):
    n, bad = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    p, spread = bad.sum() / n.sum(), n.sum() - (n**2).sum() / n.sum()
    v = ((bad**2 / n).sum() - bad.sum() ** 2 / n.sum() - (len(n) - 1) * p * (1 - p)) / spread if spread > 0 else 0
    return min(1000, max(1, p * (1 - p) / v - 1)) if v > 0 else 1000


def test_reputation_by_hand(spark):
    rng = np.random.default_rng(1)
    rate = {"a.x.com": 0.9, "b.x.com": 0.8, "y.com": 0.1, "z.org": 0.05, "w.z.org": 0.1, "v.net": None}
    rows = [(h, int(rng.random() < p) if p is not None and rng.random() < 0.7 else None) for h, p in rate.items() for _ in range(80)]
    found = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    df = pd.DataFrame(rows, columns=["host", "bad"])
    hosts = df.groupby("host").bad.agg(["count", "sum"])
    hosts["domain"] = [".".join(h.split(".")[-2:]) for h in hosts.index]
    hosts["suffix"] = [h.split(".")[-1] for h in hosts.index]
    domains = hosts.groupby(["suffix", "domain"])[["count", "sum"]].sum().reset_index("suffix")
    suffixes = domains.groupby("suffix")[["count", "sum"]].sum()
    w = [weight(x[x["count"] > 0][["count", "sum"]].to_numpy()) for x in (suffixes, domains, hosts)]
    p0 = hosts["sum"].sum() / hosts["count"].sum()
    for h, r in hosts.iterrows():
        s, d = suffixes.loc[r["suffix"]], domains.loc[r["domain"]]
        p1 = (s["sum"] + w[0] * p0) / (s["count"] + w[0])
        p2 = (d["sum"] + w[1] * p1) / (d["count"] + w[1])
        p3 = (r["sum"] + w[2] * p2) / (r["count"] + w[2])
        assert found[h].mean == pytest.approx(p3)
        assert found[h].sd == pytest.approx((p3 * (1 - p3) / (r["count"] + w[2] + 1)) ** 0.5)
    assert found["a.x.com"].mean > 0.7 > 0.3 > found["y.com"].mean


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.com/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)] + [(None, 1), (3, 1)], "id long, bad int")
    found = urls.filter_urls(pages, labels).collect()
    assert len(found) == 200 and all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in found)


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    found = urls.filter_urls(pages, spark.createDataFrame([(1, 1)], "id long, bad int"), URL_RULES)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
