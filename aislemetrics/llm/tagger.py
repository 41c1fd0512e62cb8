"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of overlapping windows.

Arrays are laid out (units, windows), so that every step is a few operations on long rows.  Gates are clipped to [0, 1] and
states to [-1, 1] instead of bent by exponentials, which a step for a thousand windows repays many times over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Characters that have a class of their own; letters count without case, digits from 1 as one.  Fixed values.
ALPHABET = "abcdefghijklmnopqrstuvwxyz01 \n\t@.,-+_%()[]{}<>:;/\\#=*&'\"!?|$"
OTHER, BEYOND_ASCII = len(ALPHABET), len(ALPHABET) + 1
CLASSES = len(ALPHABET) + 2
UNITS = 8
# Length of a window and how much neighbours share.
WINDOW, OVERLAP = 640, 112
# Windows, and characters of whole texts, decoded together; bounds memory, as does one text where it is longer.
TOGETHER, TOGETHER_CHARS = 2_048, 1_000_000

_CLASS_OF = np.full(129, OTHER, np.uint8)
for _code in range(128):
    _at = ALPHABET.find("1" if chr(_code) in "123456789" else chr(_code).lower())
    if _at >= 0:
        _CLASS_OF[_code] = _at
_CLASS_OF[128] = BEYOND_ASCII


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _CLASS_OF[np.minimum(codes, 128)]


@dataclass
class Direction:
    """One LSTM: input weights by class, recurrent weights (rows: input, forget, output, state), and emission weights."""

    table: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray


@dataclass
class Tagger:
    forward: Direction
    backward: Direction
    bias: np.ndarray
    moves: np.ndarray

    @property
    def tags(self) -> int:
        return len(self.bias)

    def parameters(self) -> list[np.ndarray]:
        ways = (self.forward, self.backward)
        return [array for way in ways for array in (way.table, way.recurrent, way.out)] + [self.bias, self.moves]


def new_tagger(tags: int, rng: np.random.Generator, units: int = UNITS) -> Tagger:
    def way() -> Direction:
        table = rng.normal(0, 0.25, (4 * units, CLASSES))
        table[: 3 * units] += 0.5
        table[units : 2 * units] += 0.25
        recurrent = rng.normal(0, 0.15, (4 * units, units))
        return Direction(*(x.astype(np.float32) for x in (table, recurrent, rng.normal(0, 0.3, (tags, units)))))

    return Tagger(way(), way(), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32))


def _run(way: Direction, codes: np.ndarray, order: range, keep: list | None, active: np.ndarray, emit: np.ndarray, first: bool):
    """Add a direction's emissions to ``emit`` (steps, tags, windows); ``keep`` collects what training needs."""
    size, n = way.recurrent.shape[1], codes.shape[1]
    h, c = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
    z, part, one = np.empty((4 * size, n), np.float32), np.empty((4 * size, n), np.float32), np.empty((size, n), np.float32)
    for t in order:
        k = int(active[t])
        zk, hk, ck, ok = z[:, :k], h[:, :k], c[:, :k], one[:, :k]
        np.take(way.table, codes[t, :k], axis=1, out=zk, mode="clip")
        np.matmul(way.recurrent, hk, out=part[:, :k])
        zk += part[:, :k]
        if keep is not None:
            raw, before = zk.copy(), (hk.copy(), ck.copy())
        gates, state = zk[: 3 * size], zk[3 * size :]
        np.clip(gates, 0, 1, out=gates)
        np.clip(state, -1, 1, out=state)
        ck *= zk[size : 2 * size]
        np.multiply(zk[:size], state, out=ok)
        ck += ok
        np.clip(ck, -1, 1, out=ok)
        np.multiply(ok, zk[2 * size : 3 * size], out=hk)
        if keep is not None:
            keep.append((t, raw, zk.copy(), *before, ck.copy(), hk.copy()))
        if first:
            np.matmul(way.out, hk, out=emit[t, :, :k])
        else:
            emit[t, :, :k] += way.out @ hk


def emissions(model: Tagger, codes: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
    """(steps, tags, windows) of ``codes`` (steps, windows); the windows stand by falling length."""
    steps, n = codes.shape
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    emit = np.zeros((steps, model.tags, n), np.float32)
    _run(model.forward, codes, range(steps), keep and keep[0], active, emit, True)
    _run(model.backward, codes, range(steps - 1, -1, -1), keep and keep[1], active, emit, False)
    emit += model.bias[:, None]
    return emit


def _viterbi(moves: np.ndarray, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags (steps, windows)."""
    steps, tags, n = emit.shape
    back = np.zeros((steps, tags, n), np.uint8)
    score = emit[0].copy()
    for t in range(1, steps):
        paths = score[:, None, :] + moves[:, :, None]
        back[t] = paths.argmax(axis=0)
        score = np.where(t < lengths, paths.max(axis=0) + emit[t], score)
    best = np.zeros((steps, n), np.uint8)
    tag = score.argmax(axis=0)
    every = np.arange(n)
    for t in range(steps - 1, -1, -1):
        best[t] = np.where(t < lengths, tag, 0)
        if t:
            tag = np.where(t < lengths, back[t, tag, every], tag)
    return best


def _uncertain(moves: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Where a text's best path may have a tag other than 0; ``emit`` is (characters, tags).

    A run of other tags on the best path scores no less than zeros in its place.  Its gain is at most the sum of its
    characters' best gains, each with the dearest move inside a run, and the moves into and out of it; so a character is
    certainly 0 if no run about it reaches a gain of 0, which two running extremes of the gains' sums tell.
    """
    inside = float(moves[1:, 1:].max() - moves[0, 0])
    enter, leave = float(moves[0, 1:].max() - moves[0, 0]), float(moves[1:, 0].max() - moves[0, 0])
    best = emit[:, 1].copy()
    for tag in range(2, emit.shape[1]):
        np.maximum(best, emit[:, tag], out=best)
    gain = (best - emit[:, 0]).astype(np.float64) + inside
    # A run at an end of the text has no move there.
    gain[0] -= enter
    gain[-1] -= leave
    total = np.cumsum(gain)
    before = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))
    after = np.maximum.accumulate(total[::-1])[::-1]
    return after - before + enter + leave - inside >= -1e-2


def _segments(moves: np.ndarray, at: np.ndarray, emit: np.ndarray, first_of_text: np.ndarray, last_of_text: np.ndarray) -> np.ndarray:
    """Best tags of the uncertain characters, which stand ``at`` rising places of the texts laid end to end.

    Between two runs of them stand characters that are certainly 0, so a run is decided by itself, from 0 to 0 unless it
    begins or ends its text.
    """
    starts, ends = first_of_text[at], last_of_text[at]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | starts[1:]])
    lengths = np.diff(np.r_[first, len(at)])
    emit[first[~starts[first]]] += moves[0]
    last = first + lengths - 1
    emit[last[~ends[last]]] += moves[:, 0]
    tags = np.zeros(len(at), np.uint8)
    order = np.argsort(-lengths, kind="stable")
    for begin in range(0, len(order), TOGETHER):
        group = order[begin : begin + TOGETHER]
        own = lengths[group]
        steps = np.arange(own[0])[:, None]
        index = np.minimum(first[group] + steps, len(at) - 1)
        found = _viterbi(moves, emit[index].transpose(0, 2, 1), own)
        tags[index[steps < own]] = found[steps < own]
    return tags


def _tag_together(model: Tagger, texts: list[str], window: int, overlap: int) -> list[np.ndarray]:
    codes = [classes_of(text) for text in texts]
    offsets = np.concatenate(([0], np.cumsum([len(item) for item in codes], dtype=np.int64)))
    step = window - overlap
    places = [
        (min(window, len(item) - at), i, at) for i, item in enumerate(codes) for at in range(0, max(1, len(item) - overlap), step) if len(item)
    ]
    places.sort(key=lambda place: -place[0])
    emit = np.empty((offsets[-1], model.tags), np.float32)
    for begin in range(0, len(places), TOGETHER):
        group = places[begin : begin + TOGETHER]
        lengths = np.array([place[0] for place in group])
        grid = np.zeros((int(lengths[0]), len(group)), np.intp)
        for j, (size, i, at) in enumerate(group):
            grid[:size, j] = codes[i][at : at + size]
        part = emissions(model, grid, lengths)
        for j, (size, i, at) in enumerate(group):
            low = overlap // 2 if at else 0
            high = size if at + size == len(codes[i]) else size - (overlap - overlap // 2)
            place = offsets[i] + at
            emit[place + low : place + high] = part[low:high, :, j]
    tags = np.zeros(offsets[-1], np.uint8)
    first, last, open_ = (np.zeros(offsets[-1], bool) for _ in range(3))
    for start, end in zip(offsets[:-1], offsets[1:]):
        if start < end:
            first[start], last[end - 1] = True, True
            open_[start:end] = _uncertain(model.moves, emit[start:end])
    at = np.flatnonzero(open_)
    if len(at):
        tags[at] = _segments(model.moves, at, emit[at], first, last)
    return [tags[start:end] for start, end in zip(offsets[:-1], offsets[1:])]


def tag_texts(model: Tagger, texts: list[str], window: int = WINDOW, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Tags of every character of every whole text, by one Viterbi search over the text.

    Windows overlap by twice the longest record or more.  Each character takes its emissions from the window in which it lies
    deepest, and the search runs over all of a text's characters.  Most are certainly 0 on the best path, so the search need
    only go through the others, run by run.
    """
    tags: list[np.ndarray] = []
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > TOGETHER_CHARS:
            tags += _tag_together(model, held, window, overlap)
            held, size = [], 0
        held.append(text)
        size += len(text)
    return tags + (_tag_together(model, held, window, overlap) if held else [])


# ---- training ----


def _crf(moves: np.ndarray, emit: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of the gold paths and its gradients by emissions and by moves."""
    steps, tags, n = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for t in range(1, steps):
        alpha[t] = emit[t] + total(alpha[t - 1][:, None] + moves[:, :, None], 0)
    for t in range(steps - 2, -1, -1):
        beta[t] = total(moves[:, :, None] + (emit[t + 1] + beta[t + 1])[None], 1)
    z = total(alpha[-1], 0)
    every, t = np.arange(n), np.arange(steps)[:, None]
    by_emit = np.exp(alpha + beta - z)
    pairs = alpha[:-1, :, None] + moves[None, :, :, None] + (emit + beta)[1:, None] - z
    by_moves = np.exp(pairs).sum(axis=(0, 3))
    gold_score = emit[t, gold, every].sum(axis=0) + moves[gold[:-1], gold[1:]].sum(axis=0)
    by_emit[t, gold, every] -= 1
    np.subtract.at(by_moves, (gold[:-1], gold[1:]), 1)
    return float((z - gold_score).mean()), by_emit / n, by_moves / n


def _backprop(way: Direction, codes: np.ndarray, kept: list, by_emit: np.ndarray) -> list[np.ndarray]:
    """Gradients of (table, recurrent, out), through the steps a direction kept."""
    size = way.recurrent.shape[1]
    d_table, d_rec, d_out = (np.zeros_like(x) for x in (way.table, way.recurrent, way.out))
    dh, dc = (np.zeros((size, codes.shape[1]), np.float32) for _ in range(2))
    for t, raw, gate, h_before, c_before, c, h in reversed(kept):
        d_out += by_emit[t] @ h.T
        dh = dh + way.out.T @ by_emit[t]
        i, f, o, g = (gate[j * size : (j + 1) * size] for j in range(4))
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.concatenate([dc * g, dc * c_before, dh * np.clip(c, -1, 1), dc * i])
        # Outside the linear part a trickle is let through, so that a gate can come back.
        dz[: 3 * size] *= np.where((raw[: 3 * size] > 0) & (raw[: 3 * size] < 1), 1, 0.05)
        dz[3 * size :] *= np.where(np.abs(raw[3 * size :]) < 1, 1, 0.05)
        np.add.at(d_table.T, codes[t], dz.T)
        d_rec += dz @ h_before.T
        dh, dc = way.recurrent.T @ dz, dc * f
    return [d_table, d_rec, d_out]


def train(windows: np.ndarray, gold: np.ndarray, tags: int, rounds: int = 9, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Fit a tagger to ``windows`` (examples, steps) of classes and ``gold`` tags by Adam on the CRF loss."""
    rng = np.random.default_rng(seed)
    model = new_tagger(tags, rng)
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    count = 0
    total = rounds * -(-len(windows) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            codes, goal = windows[chosen].T.astype(np.intp), gold[chosen].T.astype(np.intp)
            keep: tuple[list, list] = ([], [])
            emit = emissions(model, codes, np.full(len(chosen), codes.shape[0]), keep)
            _, by_emit, by_moves = _crf(model.moves, emit.astype(np.float64), goal)
            by_emit = by_emit.astype(np.float32)
            grads = _backprop(model.forward, codes, keep[0], by_emit) + _backprop(model.backward, codes, keep[1], by_emit)
            grads += [by_emit.sum(axis=(0, 2)), by_moves.astype(np.float32)]
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            count += 1
            pace = rate * min(1.0, 2 * (1 - (count - 1) / total)) * np.sqrt(1 - 0.999**count) / (1 - 0.9**count)
            for p, g, m, v in zip(model.parameters(), grads, first, second):
                g = g / max(1.0, norm / 5)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model
