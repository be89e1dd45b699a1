import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import language as L

EN, FR = "the cat and the dog went with the man ", "le chat et la souris sont avec un homme "


def docs(spark):
    return spark.createDataFrame([(i, EN * 5, "en") if i % 2 else (i, FR * 5, "fr") for i in range(40)], "doc_id int, text string, lang string")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id int, url string, html string")


def page(text, lang=None):
    return f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def test_texts_decide_when_they_are_long(spark):
    rows = [(i, f"http://a{i % 3}.com/{i}", page((EN if i % 2 else FR) * 4)) for i in range(12)]
    found = {r["id"]: r for r in L.identify(pages(spark, rows), docs(spark)).collect()}
    assert all(found[i]["lang"] == ("en" if i % 2 else "fr") == found[i]["text_lang"] and found[i]["confidence"] > 0.9 for i in found)


def test_markup_and_host_decide_when_there_is_no_text(spark):
    rows = [(i, "http://fr.site.fr/x", page(FR * 4, "fr")) for i in range(20)] + [(50 + i, "http://en.site.uk/x", page(EN * 4, "en")) for i in range(20)]
    rows += [(100, "http://fr.site.fr/empty", page("")), (101, "http://new.uk/", page("", "en")), (102, None, page("", "fr"))]
    found = {r["id"]: r for r in L.identify(pages(spark, rows), docs(spark)).collect()}
    assert (found[100]["lang"], found[101]["lang"], found[102]["lang"]) == ("fr", "en", "fr")
    assert found[100]["text_lang"] is None


def test_posteriors_equal_brute_force(spark):
    """The fused posterior against the same rule on plain arrays."""
    rows = [(i, f"http://h{i % 2}.x.{'fr' if i % 3 else 'uk'}/", page((EN if i % 4 else FR) * 2 if i % 5 else "", "fr" if i % 2 else None)) for i in range(24)]
    found = {r["id"]: r for r in L.identify(pages(spark, rows), docs(spark)).collect()}
    model = L.text_model(docs(spark))
    text = np.array([model.likelihoods(L.main_text(h)) for _, _, h in rows])
    soft = np.exp(text) / np.exp(text).sum(axis=1, keepdims=True)
    host = np.array([u.split("/")[2] for _, u, _ in rows])
    suffix = np.array([h.split(".")[-1] for h in host])
    domain = np.array([".".join(h.split(".")[-2:]) for h in host])
    declared = np.array(["fr" if "lang=fr" in h else "" for _, _, h in rows])
    k = soft.shape[1]
    for n in range(len(rows)):
        rest = np.arange(len(rows)) != n  # all evidence but the page's own
        own = lambda col, v: soft[(col == v) & rest].sum(axis=0)  # noqa: B023, E731
        q = (soft[rest].sum(axis=0) + 1) / (rest.sum() + k)
        for level in (domain, host):
            q = (own(level, level[n]) + L.SMOOTHING * q) / (((level == level[n]) & rest).sum() + L.SMOOTHING)
        p = np.exp(text[n]) * q * (own(suffix, suffix[n]) + 0.5) / (soft[rest].sum(axis=0) + 0.5 * max(2, len(set(suffix))))
        if declared[n]:
            p = p * (own(declared, "fr") + 0.5) / (own(declared, "fr") + 0.5 * 2)
        p /= p.sum()
        assert found[n]["lang"] == model.langs[p.argmax()] and abs(found[n]["confidence"] - p.max()) < 1e-6


def test_more_languages_than_any_list(spark):
    rng = np.random.default_rng(2)
    words = [[f"{chr(0x4E00 + 40 * k + int(i))}{chr(0x4E00 + 40 * k + int(j))}" for i, j in rng.integers(0, 40, (30, 2))] for k in range(70)]
    texts = spark.createDataFrame([(k * 3 + n, " ".join(rng.permutation(words[k])), f"l{k:02}") for k in range(70) for n in range(3)], "doc_id int, text string, lang string")
    found = L.identify(pages(spark, [(k, f"http://h{k}.com/", page(" ".join(words[k]))) for k in range(70)]), texts).collect()
    assert all(r["lang"] == f"l{r['id']:02}" for r in found)


def test_only_the_language_attribute_declares(spark):
    rows = [(1, "http://a.com/", "<html data-lang=fr lang='en-GB'><p>x"), (2, "http://a.com/", "<html xml:lang=fr data-lang=fr><p>x")]
    assert {r["id"]: r["declared"] for r in L.identify(pages(spark, rows), docs(spark)).collect()} == {1: "en", 2: None}


def test_all_pages(spark):
    found = L.query(spark, SF).collect()
    assert len(found) == 50 and all(r["lang"] == r["declared"] for r in found)


def test_edge_rows_and_no_labels(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "http://h.com:80/", page(EN))]
    odd = pages(spark, rows).withColumns({"lang": F.lit(1), "host": F.lit(2), "soft": F.lit(3), "whole": F.lit(5), "domain": F.lit(6), "id": F.lit(4)})
    assert len(L.identify(odd, docs(spark)).collect()) == 4
    assert L.identify(odd.limit(0), docs(spark)).collect() == []
    assert {r["lang"] for r in L.identify(odd, docs(spark).limit(0)).collect()} == {None}
