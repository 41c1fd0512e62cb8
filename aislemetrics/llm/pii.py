"""Personal data: fixed patterns, and a trained character tagger that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers.  The tagger is trained on labelled windows: texts
of a bounded sample of the documents, with the spans that the patterns find in them, and records of each kind, also written
in ways the patterns do not know, set into such texts.  It reads every whole text in overlapping windows; its spans are added
where they touch no span of a pattern and pass the checks of their kind once their writing is made plain.

Defined cases: a null or empty text has no spans; repeated rows and null ids come back as they are; an empty table gives an
empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm import tagger
from aislemetrics.llm.common import least_hashed, map_rows

KINDS = ("email", "ip", "card", "phone")
# Documents in the training sample (those of least hash), characters taken from each, windows drawn, and their length.
SAMPLE, SAMPLE_CHARS, EXAMPLES, EXAMPLE_CHARS = 400, 4_000, 6_000, 112

_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _is_ip(text: str) -> bool:
    # A part beyond 255 has a non-zero digit before its last three, or more than 255 in them.
    return all(not part[:-3].strip("0") and int(part[-3:]) <= 255 for part in text.split("."))


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @ outwards, so that no long word is scanned twice."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _USER:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append(("email", start, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns by kind as listed, then start; code points, end exclusive."""
    if not text:
        return []
    found = _emails(text)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])] if "." in text else []
    found += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


# Ways of writing that the patterns do not know, and the plain form of each.
_PLAIN = [(re.compile(r"\s*[\[({]\s*at\s*[\])}]\s*", re.I), "@"), (re.compile(r"\s*[\[({]\s*(dot|\.)\s*[\])}]\s*", re.I), ".")]
_NATIONAL = re.compile(r"\(?[0-9]{2,5}\)?[\x20.-]?[0-9]{2,4}([\x20.-][0-9]{2,4}){1,3}")


def _passes(kind: str, text: str) -> bool:
    plain = text
    for pattern, sign in _PLAIN:
        plain = pattern.sub(sign, plain)
    if kind == "email":
        return _EMAIL.fullmatch(plain) is not None
    if kind == "ip":
        return _IP.fullmatch(plain) is not None and _is_ip(plain)
    if kind == "card":
        return re.fullmatch(r"[0-9]([\x20./-]?[0-9])+", plain) is not None and _is_card(plain)
    return _NATIONAL.fullmatch(plain) is not None and 9 <= len(_digits(plain)) <= 15


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of one tag that touch no base span and pass their kind's check."""
    if not tags.any():
        return []
    turns = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0])).astype(np.int16)))
    found = []
    for start, end in zip(turns[:-1].tolist(), turns[1:].tolist()):
        if tags[start]:
            part = text[start:end]
            start, end = start + len(part) - len(part.lstrip(" \n,;:.")), end - len(part) + len(part.rstrip(" \n,;:."))
            kind = KINDS[tags[start] - 1] if start < end else ""
            if kind and _passes(kind, text[start:end]) and all(end <= b or start >= e for _, b, e in base):
                found.append((kind, start, end))
    return found


# ---- training examples ----


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def _card_number(rng: random.Random) -> str:
    body = rng.choice("3456") + _number(rng, rng.choice([12, 14, 14, 14]))
    return next(body + last for last in "0123456789" if _luhn(body + last))


def _word(rng: random.Random, words: list[str], most: int = 14) -> str:
    """A word of the sample's texts or as many letters by chance, so that neither spelling nor length gives a record away."""
    return rng.choice(words)[:most] if rng.random() < 0.5 else _name(rng, rng.randint(1, most))


def _written(rng: random.Random, sign: str) -> str:
    """``sign`` ("at", "dot" or ".") in brackets, with or without spaces about them."""
    left, right = rng.choice(["[]", "()", "{}"])
    space = rng.choice(["", " "])
    return space + left + sign + right + space


# Digits in the groups of national phone numbers.
_GROUPS = [(3, 3, 4), (3, 3, 4), (3, 3, 4), (3, 4, 4), (2, 4, 4), (4, 3, 3), (4, 3, 4), (5, 3, 3), (2, 2, 2, 2, 2), (3, 2, 2, 2), (4, 2, 2, 2)]


def _record(rng: random.Random, kind: str, words: list[str]) -> str:
    """One record of a kind, about two in five of them written in a way the patterns know."""
    plain = rng.random() < 0.4
    if kind == "email":
        more = rng.choice(["", _number(rng, rng.randint(1, 4)), _word(rng, words), _word(rng, words)])
        user = _word(rng, words) + (rng.choice(["", ".", "_", "-"]) + more if more else "")
        host = _word(rng, words) + rng.choice(["", "", _number(rng, rng.randint(1, 2)), "-" + _word(rng, words, 8)])
        ends = rng.choice([["com"], ["com"], ["org"], ["net"], ["example", "com"], ["co", "uk"], [_name(rng, 2)], [_name(rng, 3)], [_name(rng, 5), "de"]])
        at, dot = ("@", ".") if plain else (_written(rng, "at"), _written(rng, rng.choice(["dot", "dot", "."])) if rng.random() < 0.7 else ".")
        return user + at + dot.join([host, *ends])
    if kind == "ip":
        return ("." if plain else _written(rng, rng.choice([".", "dot"]))).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = _card_number(rng)
        sign = rng.choice(["", " ", "-"]) if plain else rng.choice([".", "/"])
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    gap = rng.choice([" ", "-", "."] if plain else [" ", "-", ".", "."])
    if plain:
        area = rng.choice([f" ({_number(rng, 3)}) ", f"{gap}{_number(rng, 3)}{gap}"])
        return f"+{_number(rng, rng.choice([1, 2]))}{area}{_number(rng, 3)}{rng.choice(['-', gap])}{_number(rng, 4)}"
    groups = [_number(rng, n) for n in rng.choice(_GROUPS)]
    if rng.random() < 0.25:
        return f"({groups[0]}){rng.choice(['', ' '])}{gap.join(groups[1:])}"
    # Rows of numbers are written with spaces too; a phone number so written begins with 0, as it does where it is dialled.
    return gap.join([("0" if gap == " " or rng.random() < 0.5 else groups[0][0]) + groups[0][1:], *groups[1:]])


def _decoy(rng: random.Random) -> str:
    """What looks like a record and is none: dates, versions, prices, rows of numbers, tokens, times, handles."""
    return rng.choice(
        [
            f"20{_number(rng, 2)}-0{rng.randint(1, 9)}-1{_number(rng, 1)}",
            f"{_number(rng, 1)}.{_number(rng, 1)}",
            f"v{_number(rng, 1)}.{_number(rng, 2)}.{_number(rng, 1)}",
            f"${_number(rng, 2)},{_number(rng, 3)}.{_number(rng, 2)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40]))),
            f"1{_number(rng, 1)}:{_number(rng, 2)}:{_number(rng, 2)}",
            _number(rng, rng.randint(1, 8)),
            f"@{_name(rng, 6)}",
            f"({_name(rng, 4)}) [{_name(rng, 3)}]",
            f"{_number(rng, 3)}-{_number(rng, 2)}",
            f"http://{_name(rng, 6)}.example.org/{_name(rng, 3)}/{_number(rng, 4)}",
            " ".join(rng.choice(["19", "20"]) + _number(rng, 2) for _ in range(rng.randint(2, 5))),
            " ".join(rng.choice("123456789") + _number(rng, rng.randint(0, 3)) for _ in range(rng.randint(2, 6))),
            f"{rng.choice('123456789')}{_number(rng, rng.randint(0, 2))} {_number(rng, 3)} {_number(rng, 3)}",
        ]
    )


def examples(texts: list[str], count: int = EXAMPLES, size: int = EXAMPLE_CHARS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Classes and gold tags (``count``, ``size``) of windows cut from ``texts`` with records and decoys set in."""
    rng = random.Random(seed)
    texts = [text for text in texts if text.strip()] or ["text"]
    words = sorted({word.lower() for text in texts for word in re.findall("[A-Za-z]+", text)}) or ["text"]
    codes, gold = np.zeros((count, size), np.uint8), np.zeros((count, size), np.uint8)
    for row in range(count):
        line, spans = "", []
        while len(line) < 3 * size:
            text = rng.choice(texts)
            at = rng.randrange(max(1, len(text) - size))
            words = text[at : at + size].split(" ")
            cut = rng.randrange(len(words) + 1)
            line += " ".join(words[:cut]) + " "
            kind = rng.choice([*KINDS, *KINDS, "", "", "", "decoy", "decoy"])
            if kind in KINDS:
                record = _record(rng, kind, words)
                spans.append((kind, len(line), len(line) + len(record)))
                line += record
            elif kind:
                line += _decoy(rng)
            line += rng.choice([" ", " ", ", ", ". ", "\n"]) + " ".join(words[cut:]) + " "
        tags = np.zeros(len(line), np.uint8)
        for kind, start, end in [*spans, *base_spans(line)]:
            tags[start:end] = KINDS.index(kind) + 1
        at = rng.randrange(len(line) - size + 1)
        codes[row], gold[row] = tagger.classes_of(line)[at : at + size], tags[at : at + size]
    return codes, gold


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tagger.Tagger:
    """The tagger trained on a sample of at most ``sample`` documents and ``chars`` characters from each."""
    text = F.col(text_col)
    offset = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length(text) - chars)).cast("int") + 1
    parts = docs.where(text.isNotNull()).select("doc_id", F.substring(text, offset, F.lit(chars)).alias("text"))
    rows = least_hashed(parts, "doc_id", sample).collect()
    return tagger.train(*examples([row.text for row in rows]), tags=len(KINDS) + 1)


# ---- operators ----


def _found(model: tagger.Tagger, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    plain = [text or "" for text in texts]
    base = [base_spans(text) for text in plain]
    tags = tagger.tag_texts(model, plain)
    return [(own, added_spans(text, tag, own)) for text, tag, own in zip(plain, tags, base)]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (KINDS.index(span[0]), span[1], span[2]))


def personal_data(docs: DataFrame, model: tagger.Tagger, text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: the patterns' spans, and all spans, as arrays of (kind, start, end)."""
    struct = "array<struct<kind: string, start: int, end: int>>"

    def as_rows(spans: list[Span]) -> list[dict]:
        return [{"kind": kind, "start": start, "end": end} for kind, start, end in spans]

    def start():
        def work(texts):
            found = _found(model, texts)
            return [[as_rows(base) for base, _ in found], [as_rows(_ordered(base + more)) for base, more in found]]

        return work

    return map_rows(docs, f"base {struct}, spans {struct}", [text_col], start)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the kind of the first in brackets."""
    if not spans:
        return text
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redacted_documents(docs: DataFrame, model: tagger.Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans taken out of its texts, and n_chars, if there, counted anew; a null text stays null."""

    def start():
        return lambda texts: [[redacted(text, base + more) for text, (base, more) in zip(texts, _found(model, texts))]]

    others = [name for name in docs.columns if name != text_col]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    clean = map_rows(packed, "clean string", ["text"], start, ("row",))
    columns = {name: F.col("row").getField(name) for name in others} | {text_col: F.col("clean")}
    if "n_chars" in others:
        columns["n_chars"] = F.coalesce(F.length("clean"), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.select(*(columns[name].alias(name) for name in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what ``personal_data`` returns; counts of the base."""

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
