"""URL filter: host and path rules, and for what no rule decides, a ratio of two character models.

Two variable-order Markov models over the characters of a URL (what follows ``://``, lower-cased) are counted, one from
accepted and one from rejected URLs.  A gram of 1 to ``ORDER`` characters is kept where it makes up at least ``SHARE`` of
all grams of its length, so a model has at most ``1 / SHARE`` grams of any length however many URLs there are, and a context
is as long as the kept grams let it be.  Probabilities are smoothed as Witten and Bell do, interpolated with those of the
context one character shorter, down to a uniform base; what the dropped grams counted goes to the shorter context.

A URL's score is the mean over its characters and its end of log p_accepted - log p_rejected.  The bound on it is calibrated
by cross-fitting: labelled URLs are dealt into two halves, each is scored by the models of the other, and the bound is the
score that divides accepted from rejected ones best.  The verdicts then take the models of both halves together.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, is never learnt from, and is
judged by the end mark alone; repeated URLs are counted and judged as often as they stand; of rules of one length the one
that blocks wins; on a tie of bounds the least counts; where accepted or rejected URLs are missing there is no ratio, all
scores are zero, and what no rule decides is allowed; an empty table gives an empty result.  Texts of any length are read
whole.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import Memo, bounded_batches, map_rows
from aislemetrics.session import materialise

# Longest gram: a character and the five before it.
ORDER = 6
# Least share of its length's grams that a kept gram makes up; at most 1 / SHARE of each length are broadcast.
SHARE = 1 / 20_000
# Probability of any character before anything is known.
BASE = 1 / 256
# The bound is sought on a grid of scores from -SPAN to SPAN.
STEP, SPAN = 0.002, 8.0
# Grams a counting task holds before it hands them on.
HELD = 400_000
# Marks no URL has: before its first and after its last character.
START, END = "\x02", "\x03"

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def match_rules(pages: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with columns host and path, and the columns rule and ruling of the longest of ``rules`` that fits.

    A rule is (allow or block, host, path): it fits the host and its subdomains where the path starts with the rule's.
    """
    # Longest first; a rule is a condition of its own, so the list is a policy of hundreds, not a table of hosts.
    ordered = sorted(set(rules), key=lambda rule: (-len(rule[1] + rule[2]), rule[0] != BLOCK, rule))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in reversed(ordered):
        under = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = under & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruling = F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def _marked(url: str | None) -> str:
    """The characters that the models see, with their marks."""
    return f"{START}{(url or '').partition('://')[2].lower()}{END}"


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(side, half, size, gram, n): grams of 1 to ``order`` characters that end at any character but the start mark.

    ``labelled`` has url, side and half.  Tasks sum what they hold before they hand it on.
    """
    bounded_batches(labelled.sparkSession)

    def run(batches):
        def out():
            for (side, half), counts in held.items():
                grams = list(counts)
                columns = {
                    "side": pa.array([side] * len(grams), pa.string()),
                    "half": pa.array([half] * len(grams), pa.int32()),
                    "size": pa.array(list(map(len, grams)), pa.int32()),
                    "gram": pa.array(grams, pa.string()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)
            held.clear()

        held: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for batch in batches:
            for url, side, half in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                text, counts = _marked(url), held[side, half]
                for size in range(1, order + 1):  # the start mark alone is no gram
                    counts.update([text[at : at + size] for at in range(size == 1, len(text) - size + 1)])
                if sum(map(len, held.values())) >= HELD:
                    yield from out()
        yield from out()

    tasks = labelled.select("url", "side", "half").mapInArrow(run, "side string, half int, size int, gram string, n long")
    return tasks.groupBy("side", "half", "size", "gram").agg(F.sum("n").alias("n"))


def kept_grams(counts: DataFrame, share: float = SHARE) -> DataFrame:
    """Of each side's grams (side, size, gram, n) those that make up at least ``share`` of the side's grams of their size."""
    sums = counts.groupBy("side", "size", "gram").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("side", "size").agg(F.sum("n").alias("total"))
    return sums.join(whole, ["side", "size"]).where(F.col("n") >= F.col("total") * share).drop("total")


class CharacterModel:
    """log p(character | the characters before it), from kept grams and their counts."""

    def __init__(self, grams: dict[str, int], order: int = ORDER):
        self.order, self.grams = order, grams
        self.seen: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        for gram, n in grams.items():
            context = gram[:-1]
            self.seen[context] = self.seen.get(context, 0) + n
            self.kinds[context] = self.kinds.get(context, 0) + 1
        # Every kept gram's count, as a context, is that of all its followers, kept or not.
        self.whole = {context: max(grams.get(context, 0), n) for context, n in self.seen.items()}

    def probability(self, context: str, character: str) -> float:
        p = BASE
        for size in range(min(self.order - 1, len(context)) + 1):
            here = context[len(context) - size :] if size else ""
            if here not in self.seen:
                break
            whole, kinds = self.whole[here], self.kinds[here]
            p = (self.grams.get(here + character, 0) + (kinds + whole - self.seen[here]) * p) / (whole + kinds)
        return p


def ratio_table(grams: dict[str, dict[str, int]], order: int = ORDER) -> Memo:
    """log p_accepted - log p_rejected of the last character of a text of at most ``order`` characters, by that text."""
    accepted, rejected = CharacterModel(grams[ALLOW], order), CharacterModel(grams[BLOCK], order)
    return Memo(lambda t: math.log(accepted.probability(t[:-1], t[-1]) / rejected.probability(t[:-1], t[-1])), longest=order)


def score(pages: DataFrame, models: dict[int, dict[str, dict[str, int]]], carry: tuple[str, ...], order: int = ORDER) -> DataFrame:
    """``carry`` and the score of every url, by the models that its column ``model`` names; zero where a side is empty.

    The models are bounded by ``kept_grams`` and sent to the tasks with the function.
    """
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def start():
        tables = {k: ratio_table(g, order) if g.get(ALLOW) and g.get(BLOCK) else None for k, g in shared.value.items()}

        def work(urls, names):
            scores = []
            for url, name in zip(urls, names, strict=True):
                text, table = _marked(url), tables.get(name)
                if table is None:
                    scores.append(0.0)
                    continue
                total = sum(table[text[max(0, at - order) : at]] for at in range(2, len(text) + 1))
                scores.append(round(total / (len(text) - 1), 9))
            return [scores]

        return work

    return map_rows(pages, "score double", ["url", "model"], start, carry)


def bound(scored: DataFrame) -> float:
    """The score from which on URLs are accepted: that of the grid's steps which divides the sides (columns score, side) best,
    the least on a tie; zero without either side.  At most one row a step comes to the driver."""
    step = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "score")) / STEP).cast("int")
    rows = (
        scored.groupBy(step.alias("step"))
        .agg(F.count_if(F.col("side") == ALLOW).alias("good"), F.count_if(F.col("side") == BLOCK).alias("bad"))
        .orderBy("step")
        .collect()
    )
    good, bad = sum(row.good for row in rows), sum(row.bad for row in rows)
    if not good or not bad:
        return 0.0
    best, at, lost, caught = 0.0, rows[0].step * STEP, 0, 0
    for row in rows:
        lost, caught = lost + row.good, caught + row.bad
        if caught / bad - lost / good > best:
            best, at = caught / bad - lost / good, (row.step + 1) * STEP
    return at


def _collected(grams: DataFrame) -> dict[str, dict[str, int]]:
    """The kept grams by side: at most ``ORDER / SHARE`` of each."""
    sides: dict[str, dict[str, int]] = {ALLOW: {}, BLOCK: {}}
    found = grams.select("side", "gram", "n").toPandas()
    for side, gram, n in zip(found["side"], found["gram"], found["n"].astype(int), strict=True):
        sides[side][gram] = n
    return sides


def fit(labelled: DataFrame, order: int = ORDER, share: float = SHARE) -> tuple[dict[str, dict[str, int]], float]:
    """Grams of the two models, and the calibrated bound, from all of ``labelled`` (url, side: allow or block)."""
    half = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    labelled = labelled.select("url", "side", half.alias("half")).where("url is not null and instr(url, '://') > 0")
    counts = materialise(gram_counts(labelled, order), "url-grams")
    # Each half is scored by the grams of the other.
    models = {k: _collected(kept_grams(counts.where(F.col("half") == 1 - k), share)) for k in (0, 1)}
    scored = score(labelled.withColumn("model", F.col("half")), models, ("side",), order)
    return _collected(kept_grams(counts, share)), bound(scored)


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    url_col: str = "url",
    carry: tuple[str, ...] = ("page_id",),
    order: int = ORDER,
    share: float = SHARE,
) -> DataFrame:
    """``carry``, host, path, rule, verdict and score of every page.

    The models learn from the URLs that ``rules`` decide: those they allow are the accepted ones, those they block the rejected.
    """
    urls = pages.select(*carry, F.col(url_col).alias("url"))
    ruled = match_rules(urls.select(*carry, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    grams, at = fit(ruled.where("ruling is not null").select("url", F.col("ruling").alias("side")), order, share)
    both = (*carry, "host", "path", "rule", "ruling")
    scored = score(ruled.withColumn("model", F.lit(0)), {0: grams}, both, order)
    learnt = F.when(F.col("score") >= F.lit(at), ALLOW).otherwise(BLOCK)
    return scored.select(*carry, "host", "path", "rule", F.coalesce("ruling", learnt).alias("verdict"), "score")
