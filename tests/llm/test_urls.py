import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aislemetrics.llm import urls
from aislemetrics.llm.queries import QUERIES, URL_RULES


def parts(url):
    after = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruling(host, path):
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


class Loop:
    """The model, counted and smoothed anew."""

    def __init__(self, texts, order, share):
        self.order = order
        every = [Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1) if t[i : i + k] != "\x02") for k in range(1, order + 1)]
        self.grams = {g: n for counts in every for g, n in counts.items() if n >= share * sum(counts.values())}

    def p(self, context, character):
        p = 1 / 256
        for size in range(min(self.order - 1, len(context)) + 1):
            here = context[len(context) - size :]
            after = {g: n for g, n in self.grams.items() if len(g) == size + 1 and g.startswith(here)}
            if not after:
                break
            kept, whole = sum(after.values()), max(self.grams.get(here, 0), sum(after.values()))
            p = (after.get(here + character, 0) + (len(after) + whole - kept) * p) / (whole + len(after))
        return p


def loop_score(text, good, bad):
    return sum(math.log(good.p(text[:i], text[i]) / bad.p(text[:i], text[i])) for i in range(1, len(text))) / (len(text) - 1)


def marked(url):
    return "\x02" + (url or "").partition("://")[2].lower() + "\x03"


LABELLED = [(f"http://good.example/{w}/{n}", "allow") for n, w in enumerate(["news", "notes", "guide", "map"] * 6)]
LABELLED += [(f"http://spin.example/{w}{n}", "block") for n, w in enumerate(["casino", "bets", "win", "spin"] * 6)]


@pytest.mark.parametrize("share", [0.0, 0.01])
def test_scores_against_a_loop(spark, share):
    labelled = spark.createDataFrame(LABELLED, "url string, side string")
    grams, at = urls.fit(labelled, 4, share)
    good, bad = (Loop([marked(u) for u, s in LABELLED if s == side], 4, share) for side in ("allow", "block"))
    assert grams == {"allow": good.grams, "block": bad.grams}
    probes = [None, "", "http://", "http://good.example/news", "http://spin.example/casino9", "ftp://zz/é", LABELLED[3][0]]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(probes)], "page_id int, url string, model int")
    made = {r.page_id: r.score for r in urls.score(pages, {0: grams}, ("page_id",), 4).collect()}
    for i, url in enumerate(probes):
        assert made[i] == pytest.approx(loop_score(marked(url), good, bad), abs=1e-8)
    # The bound is the best of the grid for scores of each half by the other half's models.
    half = {r.url: r.half for r in labelled.select("url", F.pmod(F.xxhash64("url"), F.lit(2)).alias("half")).collect()}
    crossed = []
    for url, side in LABELLED:
        others = [Loop([marked(u) for u, s in LABELLED if s == x and half[u] != half[url]], 4, share) for x in ("allow", "block")]
        crossed.append((round(loop_score(marked(url), *others), 9), side))
    def split(bound):
        return sum((x < bound) * (1 if s == "block" else -1) for x, s in crossed)

    assert split(at) == max(split(k * urls.STEP) for k in range(-4000, 4001))


def test_probabilities_sum_to_one():
    texts = [marked(u) for u, s in LABELLED if s == "allow"]
    grams = Loop(texts, 4, 0.0).grams
    model = urls.CharacterModel(grams, 4)
    symbols = [chr(c) for c in range(256)]
    for context in ("\x02", "\x02g", "ood", "zzz", "/new", ""):
        assert sum(model.probability(context, c) for c in symbols) == pytest.approx(1, abs=1e-9)


def test_unseen_hosts_are_told_apart(spark):
    held = [(i, f"https://m.{w}-{k}.example/{w}/{i}") for i, (w, k) in enumerate([("casino", "win"), ("news", "guide")] * 5)]
    pages = spark.createDataFrame([(i, u) for i, u in held] + [(100 + i, u) for i, (u, _) in enumerate(LABELLED)], "page_id int, url string")
    rules = [("allow", "good.example", "/"), ("block", "spin.example", "/")]
    made = {r.page_id: r.verdict for r in urls.judge_urls(pages, rules).collect()}
    assert [made[i] for i, _ in held] == ["block", "allow"] * 5


def test_query(spark, folder):
    source = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op12_url_filter"](spark, folder).collect()
    assert sorted(r.page_id for r in rows) == sorted(source)
    sides, kept, lost = {"allow": [], "block": []}, [], []
    for r in rows:
        host, path = parts(source[r.page_id])
        rule = ruling(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2])
        if rule:
            assert r.verdict == rule[0]
            sides[rule[0]].append(marked(source[r.page_id]))
        else:
            (kept if r.verdict == "allow" else lost).append(r.score)
    assert kept and lost and min(kept) > max(lost)
    good, bad = (Loop(sides[side], urls.ORDER, urls.SHARE) for side in ("allow", "block"))
    for r in rows[::25]:
        assert r.score == pytest.approx(loop_score(marked(source[r.page_id]), good, bad), abs=1e-7)


def test_odd_rows(spark):
    long = "http://a.org/" + "x" * 200_000
    odd = [
        (1, None),
        (2, ""),
        (3, "no host here"),
        (4, "http://"),
        (5, "HTTP://WWW.Example.ORG/es/a?b=http://other.com/fr/"),
        (5, "HTTP://WWW.Example.ORG/es/a?b=http://other.com/fr/"),
        (6, "http://a.org"),  # no path, so the rule org/ does not fit
        (7, "http://notorg/x"),
        (8, "http://x.com/de/#http://y.org/"),
        (9, "http://example.org/en/12"),
        (10, long),
        (None, "http://É.com/fr/\n?z"),
        (11, "a\nb://C.com/fr/q"),
    ]
    frame = spark.createDataFrame([(*row, "h", "r", 1, 2) for row in odd], "page_id long, url string, host string, rule string, half int, score int")
    rows = urls.judge_urls(frame, URL_RULES).collect()
    assert len(rows) == len(odd)
    got = sorted(((r.page_id or 0), r.host, r.path, r.rule) for r in rows)
    want = []
    for i, url in odd:
        host, path = parts(url)
        rule = ruling(host, path)
        want.append((i or 0, host, path, rule and rule[1] + rule[2]))
    assert got == sorted(want)
    assert {r.verdict for r in rows} <= {"allow", "block"}
    assert urls.judge_urls(frame.limit(0), URL_RULES).collect() == []
    # Without rejected URLs nothing is rejected.
    only = urls.judge_urls(frame, [("allow", "org", "/")]).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_ties_of_rules_block(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    (row,) = urls.judge_urls(frame, [("allow", "a.b", "/"), ("block", "a.b", "/")]).collect()
    assert (row.rule, row.verdict) == ("a.b/", "block")
