import itertools
import math

from remitspark.llm import urls

SCHEMA = "page_id long, url string, html string, host string, rule string, bucket string, word string"
RULES = urls.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/en/12", "x://com/fr/a", "x://a.com/de/", "http://b.com/de",
    "http://org", "http://org?/x", "http://Ünï.ÄB.org/é", "a://b://c.org/es/", "http://user@www.bad-words.com:80/de/x#/y", "http://www.goodname.net/en/3", "http://badword.net/de/4", "http://" + "x" * 300 + ".net/",
]


def test_parts_rules_and_messy_rows(spark):
    rows = [(i, u, f"<p>good name bad words {i}</p>", "h", "r", "b", "w") for i, u in enumerate(URLS)] + [(None, URLS[5], None, "", "", "", ""), (3, URLS[5], "", "", "", "", "")]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] not in (None, 3):
            host, path = parts(URLS[r["page_id"]])
            rule, verdict = ruled(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_classifier_learns_from_the_ruled_urls(spark):
    good, bad = ["sunnygarden", "gardenfarm", "sunnyfarm"], ["cheappills", "pillsdeal", "cheapdeal"]
    rows = [(i, f"http://{bad[i % 3]}.com/de/{i}", "sunny garden farm cheap pills deal") for i in range(40)]
    rows += [(100 + i, f"http://{good[i % 3]}.com/fr/{i}", None) for i in range(40)]
    rows += [(200, "http://dealpills.net/xx/1", None), (201, "http://farmgarden.net/xx/1", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[200], got[201]) == ("block", "allow")


def test_words_outside_of_tags(spark):
    df = spark.createDataFrame([("<a href='x'>One two</a> one <", ), ("two>three <b", ), ("four", ), (None, )], "text string").coalesce(1)
    assert {r["word"]: r["n"] for r in urls.lexicon(df).collect()} == {"one": 2, "two": 2, "three": 1, "four": 1}


def test_segmentation_as_brute_force(spark):
    lexicon = {"the": 40, "them": 9, "men": 8, "me": 20, "n": 1, "theme": 3, "hem": 2, "ü": 4}
    total = sum(lexicon.values())
    names = ["themen", "thememe", "menthe", "xthe", "üme", "n"]

    def price(w):
        return math.log(lexicon[w] / total) if w in lexicon else math.log(10 / total) - len(w) * math.log(10)

    def best(name):
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            splits.append([name[a:b] for a, b in zip(edges, edges[1:])])
        return max(sum(map(price, s)) for s in splits)

    got = urls.split_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(lexicon.items()), "word string, n long"))
    for r in got.collect():
        assert "".join(r["words"]) == r["name"]
        assert math.isclose(sum(map(price, r["words"])), best(r["name"]))


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
