import hashlib
import re

import numpy as np
import pytest

from aislemetrics.llm import pii, tagger
from aislemetrics.llm.queries import QUERIES


def brute(text):
    """The fixed patterns as they are written, by the plain regular expressions."""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(number):
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(number))]
        return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(kind, *m.span()) for kind, rule, check in rules for m in re.finditer(rule, text) if check(m[0])]


def test_patterns_on_odd_texts():
    rng = np.random.default_rng(1)
    signs = list("aZ9") + ["@", ".", "-", "+", " ", "(", ")", "4111 1111 1111 1111", "256", "a@b.c", "1.2.3.4", "_", "é", "0001"]
    for _ in range(4_000):
        text = "".join(rng.choice(signs) for _ in range(rng.integers(0, 14)))
        assert pii.base_spans(text) == brute(text), text
    long = "a" * 200_000 + "@ " + "1" * 200_000 + " +" + "(" * 200_000
    assert pii.base_spans(long) == []


def test_whole_table(spark, folder, documents):
    for row in QUERIES["op8_personal_data"](spark, folder).collect():
        base = brute(documents[row.doc_id])
        joined = [":".join(map(str, span)) for span in base]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert set(joined) <= set(spans) and len(spans) == len(set(spans))


@pytest.fixture(scope="module")
def model(documents):
    texts = [documents[i] for i in sorted(documents)]
    return tagger.train(*pii.examples(texts[:300]), tags=5)


def test_held_out_accuracy(model, documents):
    codes, gold = pii.examples([documents[i] for i in sorted(documents)][500:800], count=600, seed=77)
    lengths = np.full(600, codes.shape[1])
    tags = tagger._viterbi(model.moves, tagger.emissions(model, codes.T.astype(np.intp), lengths), lengths).T
    assert (tags == gold).mean() > 0.97
    assert (tags == gold)[gold > 0].mean() > 0.9 and (tags == gold)[tags > 0].mean() > 0.9


def test_adds_what_the_patterns_miss(model):
    filler = "and the other things that were said here "
    text = filler * 12 + "write to anna.k [at] mail3 [dot] example [dot] com soon, " + filler + "from 93[.]197[.]161[.]72 " + filler
    ((base, more),) = pii._found(model, [text])
    assert base == [] and {text[a:b] for _, a, b in more} == {"anna.k [at] mail3 [dot] example [dot] com", "93[.]197[.]161[.]72"}


PEOPLE = ["anna", "bob", "maria", "jean", "li", "oluwaseun", "christopher"]
FAMILIES = ["kowalski", "smith", "garcia", "vandenberg", "wu", "schwarzenegger"]
HOSTS = ["mailserver", "gmail", "web", "uni-bonn", "corp42", "company", "x1"]
# Kind and writing: f a first name, l a family name, h a host, # a digit, i a part of an address; the rest stands for itself.
FORMS = [
    ("email", "{f}.{l} [at] {h} [dot] com"),
    ("email", "{f}.{l} (at) {h}.com"),
    ("email", "{f}_{l}[at]{h}.org"),
    ("email", "{f}.{l}[at]{h}(dot)co(dot)uk"),
    ("email", "{f}{l} {{at}} {h} {{dot}} net"),
    ("ip", "{i}[.]{i}[.]{i}[.]{i}"),
    ("ip", "{i}(dot){i}(dot){i}(dot){i}"),
    ("ip", "{i} [.] {i} [.] {i} [.] {i}"),
    ("phone", "020 #### ####"),
    ("phone", "01 ## ## ## ##"),
    ("phone", "(###) ###-####"),
    ("phone", "###.###.####"),
    ("phone", "030-####-####"),
]


def written(rng, form):
    part = {name: rng.choice(values) for name, values in (("f", PEOPLE), ("l", FAMILIES), ("h", HOSTS))}
    while "{i}" in form:
        form = form.replace("{i}", str(rng.randint(0, 255)), 1)
    return "".join(rng.choice("0123456789") if c == "#" else c for c in form).format(**part)


@pytest.mark.parametrize("kind, form", FORMS)
def test_recall_of_records_not_drawn_by_the_generator(model, documents, kind, form):
    """Names and hosts of other lists, set between words of texts that were not trained on."""
    import random

    rng = random.Random(form)
    texts = [documents[i] for i in sorted(documents)][300:800]
    placed = []
    for _ in range(100):
        words = rng.choice(texts).split(" ")
        cut = rng.randrange(len(words) + 1)
        before, record = " ".join(words[max(0, cut - 40) : cut]) + " ", written(rng, form)
        placed.append((kind, len(before), len(before) + len(record), before + record + " " + " ".join(words[cut : cut + 40])))
    found = pii._found(model, [text for *_, text in placed])
    assert sum(tuple(span) in more for (*span, _), (_, more) in zip(placed, found, strict=True)) >= 80


def test_recall_over_all_forms(model, documents):
    import random

    rng = random.Random(1)
    texts = [documents[i] for i in sorted(documents)][300:800]
    caught = []
    for kind, form in FORMS * 60:
        before, record = rng.choice(texts)[-200:].lstrip() + " ", written(rng, form)
        ((_, more),) = pii._found(model, [before + record + " " + rng.choice(texts)[:100]])
        caught.append((kind, len(before), len(before) + len(record)) in more)
    assert np.mean(caught) >= 0.95


def test_clean_texts_are_left_alone(model, documents):
    texts = [documents[i] for i in sorted(documents)][300:]
    assert sum(bool(more) for _, more in pii._found(model, texts)) <= len(texts) / 500
    rows = ["in 1990 1991 1992 and 1993 it was", "sums of 12 345 678 or 3 141 592 were paid", "4 8 15 16 23 42", "meet (at) noon. dot", "on 2021-03-14 10:22:07"]
    assert [more for _, more in pii._found(model, rows)] == [[]] * len(rows)


def whole_tags(model, text):
    """Windowed nowhere: emissions of the whole text, and a search through every character of it."""
    codes = tagger.classes_of(text)
    emit = tagger.emissions(model, codes[:, None].astype(np.intp), np.array([len(codes)]))
    return emit, tagger._viterbi(model.moves, emit, np.array([len(codes)]))[:, 0]


def test_search_goes_through_uncertain_characters_only_and_does_not_differ(model):
    text = "some text (a) of v1.2 and 33-44, anna.k [at] mail3 [dot] com. 555-010-7788"
    texts = [text[at:] + " and then " + text[: 50 - at] for at in range(0, 60, 3)] + ["", "x", "12.3.4"]
    for text, tags in zip(texts, tagger.tag_texts(model, texts), strict=True):
        assert not text or (tags == whole_tags(model, text)[1]).all()


def test_what_is_left_out_of_the_search_is_zero():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 40))
        moves, emit = rng.normal(0, 1.5, (4, 4)).astype(np.float32), rng.normal(0, 2, (n, 4)).astype(np.float32)
        emit[:, 0] += rng.uniform(0, 6)
        full = tagger._viterbi(moves, emit[:, :, None], np.array([n]))[:, 0]
        at = np.flatnonzero(tagger._uncertain(moves, emit))
        tags, (first, last) = np.zeros(n, np.uint8), np.zeros((2, n), bool)
        first[0] = last[-1] = True
        if len(at):
            tags[at] = tagger._segments(moves, at, emit[at], first, last)
        assert (tags == full).all()


def test_texts_are_tagged_alike_whatever_stands_beside_them(model, monkeypatch):
    record = "anna.k [at] mail3 [dot] com"
    texts = ["", record, "x", ("some words and " * 90)[:-1] + " " + record, "", record + " and more " * 200]
    together = tagger.tag_texts(model, texts)
    monkeypatch.setattr(tagger, "TOGETHER_CHARS", 1)
    for text, a, b in zip(texts, together, tagger.tag_texts(model, texts), strict=True):
        assert len(a) == len(text) and (a == b).all()


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    emit, moves = rng.normal(size=(5, 3, 4)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([5, 4, 2, 1])
    best = tagger._viterbi(moves, emit, lengths)
    for j, n in enumerate(lengths):
        paths = itertools.product(range(3), repeat=int(n))
        score = lambda p: sum(emit[t, p[t], j] for t in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        assert tuple(best[:n, j]) == max(paths, key=score)


def test_gradients():
    rng = np.random.default_rng(3)
    model = tagger.new_tagger(3, rng, units=3)
    for way in (model.forward, model.backward):  # well inside the linear parts
        way.table[:], way.recurrent[:] = way.table * 0.1 + 0.25, way.recurrent * 0.1
    model = tagger.Tagger(*(tagger.Direction(*(x.astype(np.float64) for x in (w.table, w.recurrent, w.out))) for w in (model.forward, model.backward)), model.bias.astype(float), rng.normal(size=(3, 3)))
    codes, gold = rng.integers(0, tagger.CLASSES, (6, 4)), rng.integers(0, 3, (6, 4))

    def loss():
        emit = tagger.emissions(model, codes, np.full(4, 6))
        return tagger._crf(model.moves, emit.astype(float), gold)[0]

    keep = ([], [])
    emit = tagger.emissions(model, codes, np.full(4, 6), keep)
    _, by_emit, by_moves = tagger._crf(model.moves, emit.astype(float), gold)
    grads = [*tagger._backprop(model.forward, codes, keep[0], by_emit), *tagger._backprop(model.backward, codes, keep[1], by_emit)]
    grads += [by_emit.sum(axis=(0, 2)), by_moves]
    for p, g in zip(model.parameters(), grads):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            step, old = 1e-2, p[at]
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 5e-3


LONG_RECORD = "abcdefghi_klmno [at] abcdefgh7 [dot] example [dot] com"


def test_a_long_record_at_every_border(model):
    """Records of 54 characters that the patterns do not know, with a window's border at each of their characters."""
    filler = "so it was and then more of it was said by them all " * 60
    assert len(LONG_RECORD) == 54 and tagger.OVERLAP >= 2 * len(LONG_RECORD)
    border = tagger.WINDOW - tagger.OVERLAP // 2
    texts = [filler[: border - 70 + shift] + " " + LONG_RECORD + " " + filler[:300] for shift in range(0, 72)]
    whole = filler[:200] + " " + LONG_RECORD + " " + filler[:300]
    assert (whole_tags(model, whole)[1][201 : 201 + 54] == 1).all()
    for text, tags in zip(texts, tagger.tag_texts(model, texts), strict=True):
        at = text.index(LONG_RECORD)
        assert (tags[at : at + 54] == 1).all()


def test_redaction():
    spans = [("email", 3, 8), ("phone", 10, 14), ("card", 11, 20)]
    text = "to a@b.c, +12 345 678 90 x"
    assert pii.redacted(text, spans) == "to [EMAIL], [PHONE]" + text[20:]
    assert pii.redacted(None, []) is None


def test_odd_documents(odd_docs, no_docs, model):
    rows = pii.digests(pii.personal_data(odd_docs, model)).collect()
    assert len(rows) == odd_docs.count()
    assert [(r.n_email, r.n_phone) for r in rows if r.n_email] == [(1, 1)]
    clean = pii.redacted_documents(odd_docs, model)
    assert clean.dtypes == odd_docs.dtypes
    found = clean.collect()
    assert [r.text for r in found if r.doc_id is None and r.text] == ["mail me at [EMAIL] or [PHONE] now"]
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)
    assert [r.n_chars for r in found if r.text is None] == [5, 5]
    assert pii.redacted_documents(no_docs, pii.fit(no_docs)).count() == 0
