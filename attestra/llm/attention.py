"""A small causal self-attention model in numpy: one layer, one head, trained with Adam.

It reads a stream of words, each as its class and the sum of the embeddings of
all its subword ids, and predicts the next one's class.  Streams are cut into
windows of 2 * SPAN places that overlap by half; a window scores its second
half, so every place is scored once, with SPAN to 2 * SPAN places before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN, WIDTH = 16, 16
BATCH, MICRO = 128, 128
_FAR, _LARGE = np.float32(-1e9), 60


@dataclass
class Model:
    """Weights; inputs are ``classes`` + 2 symbols (the last two: end, begin), outputs ``classes`` + 1; f is what each subword id of a word adds to its class."""

    e: np.ndarray
    f: np.ndarray
    p: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    u: np.ndarray
    b: np.ndarray

    @staticmethod
    def new(classes: int, seed: int = 1, ids: int = 0) -> Model:
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d = WIDTH
        return Model(w(classes + 2, d), np.zeros((max(1, ids), d), np.float32), 0.1 * w(2 * SPAN, d), w(d, d), w(d, d), w(d, d), w(d, d), w(d, classes + 1), np.zeros(classes + 1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.e, self.f, self.p, self.q, self.k, self.v, self.o, self.u, self.b]

    def plus(self, moved: np.ndarray, f: np.ndarray) -> Model:
        """This model moved by what :meth:`Pass.moved` gives."""
        out, at = [], 0
        for i, w in enumerate(self.weights()):
            out.append(w + f if i == 1 else w + moved[at : at + w.size].reshape(w.shape))
            at += 0 if i == 1 else w.size
        return Model(*[x.astype(np.float32) for x in out])


#: place S + j may look at places up to itself
MASK = np.where(np.arange(2 * SPAN)[None, :] <= SPAN + np.arange(SPAN)[:, None], np.float32(0), _FAR)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every window's second half, and of its stream's start, for streams with these offsets."""
    lens = np.diff(offsets)
    count = -(-lens // SPAN)
    start = np.repeat(offsets[:-1], count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return start + nth * SPAN, start


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every range, one after the other."""
    return np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Adds rows of WIDTH numbers to those of ``out`` at ``at``, however often a place is named."""
    np.add.at(out.reshape(-1), (at.ravel()[:, None] * WIDTH + np.arange(WIDTH)).ravel(), rows.ravel())
    return out


def numbered(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of these numbers below n, in order, and which of them each is."""
    place = np.zeros(n, np.int64)
    place[values] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found))
    return found, place[values]


def word_vectors(f: np.ndarray, pieces: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each word the sum of its pieces' rows, and a last row of zeros for what isn't a word; every word has a piece."""
    out = np.zeros((len(lens) + 1, f.shape[1]), np.float32)
    begins = np.cumsum(lens) - lens
    f.take(pieces[begins], 0, out[:-1], "clip")
    longer = np.flatnonzero(lens > 1)
    rest = lens[longer] - 1
    return _add(out, np.repeat(longer, rest), f.take(pieces[ranges(begins[longer] + 1, rest)], 0))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product of each matrix of ``a`` with ``b``, as one product."""
    return (a.reshape(-1, a.shape[-1]) @ b).reshape(*a.shape[:-1], b.shape[1])


def _exp(s: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp, in place, and each row's sum; large numbers less the row's greatest, which no quotient of the two shows."""
    large = s.size and max(s.max(), -s.min()) > _LARGE
    if mask is not None:
        s += mask
    if large:
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    return s, _times(s, np.ones((s.shape[-1], 1), np.float32))


class Blocks:
    """Streams in blocks of SPAN places: what each place reads (a row of a table of inputs, of which the last is "begin") and has to predict.

    A window is a block and the one before it; ``rows`` begins with a block of nothing.
    """

    def __init__(self, stream: np.ndarray, offsets: np.ndarray, read: np.ndarray, begin: int):
        n = len(stream)
        before = np.full(n, begin, np.int64)
        before[1:] = read[:-1]
        before[offsets[:-1][np.diff(offsets) > 0]] = begin
        at, start = windows(offsets)
        self.first = at == start
        place = at[:, None] + np.arange(SPAN)
        self.inside = place < np.repeat(offsets[1:], -(-np.diff(offsets) // SPAN))[:, None]
        self.place = np.minimum(place, n - 1)
        self.target = stream[self.place]
        self.rows = np.full((len(at) + 1, SPAN), begin, np.int64)
        self.rows[1:] = np.where(self.inside, before[self.place], begin)


def _inputs(stream: np.ndarray, words: np.ndarray | None, n: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place's row of a table of inputs, and the rows' symbols: a row for each of n words, one for what is none, and "begin"; without words, a row for each symbol."""
    if words is None:
        return stream, np.arange(classes + 2)
    symbols = np.full(n + 2, classes)
    symbols[words] = stream
    symbols[-1] = classes + 1
    return words, symbols


def _forward(m: Model, h: np.ndarray, first: np.ndarray, prev: slice, cur: slice):
    """h: blocks of inputs, of which ``cur`` are scored and ``prev`` are those before them; first: blocks that have none."""
    both = np.concatenate([m.q * np.float32(1 / np.sqrt(WIDTH)), m.k, m.v], 1)
    z, at = _times(h, both), m.p @ both
    q = z[cur, :, :WIDTH] + at[SPAN:, :WIDTH]
    kv = np.empty((len(q), 2 * SPAN, 2 * WIDTH), np.float32)
    np.add(z[prev, :, WIDTH:], at[:SPAN, WIDTH:], out=kv[:, :SPAN])
    np.add(z[cur, :, WIDTH:], at[SPAN:, WIDTH:], out=kv[:, SPAN:])
    mask = np.broadcast_to(MASK, (len(q), *MASK.shape))
    if first.any():
        mask = mask.copy()
        mask[first, :, :SPAN] = _FAR
    a, total = _exp(np.matmul(q, kv[:, :, :WIDTH].transpose(0, 2, 1)), mask)
    a /= total
    c = np.matmul(a, kv[:, :, WIDTH:])
    y = h[cur] + m.p[SPAN:]
    y += _times(c, m.o)
    logits = _times(y, m.u)
    logits += m.b
    return both, q, kv, a, c, y, logits


def score(m: Model, stream: np.ndarray, offsets: np.ndarray, words: np.ndarray | None = None, vectors: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each place's symbol (classes, then end) given those before it in its stream.

    ``stream`` holds the symbols to predict; each stream's input starts with
    "begin" and goes on with what was predicted, and its word's vector: ``words``
    are rows of ``vectors``, whose last row is for no word.  A word has one symbol.
    """
    out = np.zeros(len(stream))
    if not len(stream):
        return out
    read, symbols = _inputs(stream, words, 0 if vectors is None else len(vectors) - 1, len(m.e) - 2)
    table = m.e[symbols]
    if words is not None:
        table[:-1] += vectors
    blocks = Blocks(stream, offsets, read, len(table) - 1)
    for a in range(0, len(blocks.first), BATCH):
        some = slice(a, a + BATCH)
        logits = _forward(m, table.take(blocks.rows[a : a + BATCH + 1], 0), blocks.first[some], slice(None, -1), slice(1, None))[-1]
        own = np.take_along_axis(logits, blocks.target[some, :, None], 2)
        large = max(logits.max(), -logits.min()) > _LARGE
        if large:
            own -= logits.max(2, keepdims=True)
        own = own - np.log(_exp(logits)[1])
        inside = blocks.inside[some]
        out[blocks.place[some][inside]] = own[:, :, 0][inside] / np.log(10)
    return out


def train(
    streams: list[np.ndarray], classes: int, steps: int = 600, batch: int = 96, rate: float = 0.01, seed: int = 1,
    words: list[np.ndarray] | None = None, pieces: np.ndarray | None = None, lens: np.ndarray | None = None, ids: int = 0,
) -> Model:
    """A model fitted on streams of symbols (classes, then ``classes`` for the end).

    ``words``: which word each symbol is, len(lens) for none; word i has the next lens[i] of ``pieces``, numbers below ``ids``.
    """
    m, r = Model.new(classes, seed, ids), np.random.default_rng(seed)
    lens, pieces = (np.zeros(0, np.int64) if x is None else x for x in (lens, pieces))
    own = None if words is None else np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
    streams = [s for s in streams if len(s)]
    if not streams:
        return m
    stream = np.concatenate(streams)
    m.b[:] = np.log((np.bincount(stream, minlength=classes + 1) + 1.0) / (len(stream) + classes + 1))
    corpus = Corpus(stream, np.append(0, np.cumsum([len(s) for s in streams])), own, pieces, lens, classes)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in m.weights()]
    for step in range(1, steps + 1):
        pick = r.integers(0, len(corpus.blocks.first), batch)
        _adam(m.weights(), corpus.gradients(m, pick), moments, step, rate * min(1.0, step / 20) * (1 - step / (steps + 1)))
    return m


class Corpus:
    """Streams to learn from: word i has the next lens[i] of ``pieces``."""

    def __init__(self, stream: np.ndarray, offsets: np.ndarray, words: np.ndarray | None, pieces: np.ndarray, lens: np.ndarray, classes: int):
        read, self.symbols = _inputs(stream, words, len(lens), classes)
        self.blocks = Blocks(stream, offsets, read, len(self.symbols) - 1)
        self.pieces, self.lens, self.begins = pieces, lens, np.cumsum(lens) - lens

    def gradients(self, m: Model, pick: np.ndarray | slice) -> list[np.ndarray]:
        """Of the mean loss over these blocks, in the order of the weights; a slice is of neighbours, which are computed once."""
        b = self.blocks
        if isinstance(pick, slice):
            low, high = pick.start, min(pick.stop, len(b.first))
            rows, runs = b.rows[low : high + 1], [(a, min(a + MICRO, high)) for a in range(low, high, MICRO)]
            cuts = [(slice(a - low, z - low + 1), slice(a, z), slice(None, -1), slice(1, None)) for a, z in runs]
        else:
            rows, n = np.concatenate([b.rows[pick], b.rows[pick + 1]]), len(pick)
            cuts = [(slice(None), pick, slice(None, n), slice(n, None))]
        own, rows = numbered(rows, len(self.symbols))
        words = own[own < len(self.lens)] if len(self.lens) else own[:0]
        lens = self.lens[words]
        at_piece = self.pieces[ranges(self.begins[words], lens)]
        table = m.e[self.symbols[own]]
        table[: len(words)] += word_vectors(m.f, at_piece, lens)[:-1]
        weight = np.float32(1 / max(1, b.inside[pick].sum()))
        total, d_table = None, np.zeros_like(table)
        for held, scored, prev, cur in cuts:
            *found, d_rows = _gradients(m, table.take(rows[held], 0), b.target[scored], b.inside[scored] * weight, b.first[scored], prev, cur)
            total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
            _add(d_table, rows[held], d_rows)
        d_e = _add(np.zeros_like(m.e), self.symbols[own], d_table)
        d_f = _add(np.zeros_like(m.f), at_piece, np.repeat(d_table[: len(words)], lens, axis=0))
        return [d_e, d_f, *total]


def _gradients(m: Model, h: np.ndarray, target: np.ndarray, weight: np.ndarray, first: np.ndarray, prev: slice, cur: slice) -> list[np.ndarray]:
    """Of the loss, places by their ``weight``: of p, q, k, v, o, u and b, and of the inputs h."""
    both, q, kv, a, c, y, logits = _forward(m, h, first, prev, cur)
    scale = np.float32(1 / np.sqrt(WIDTH))
    flat = lambda z: z.reshape(-1, z.shape[-1])
    g, total = _exp(logits)
    g *= weight[:, :, None] / total
    flat(g)[np.arange(target.size), target.ravel()] -= weight.ravel()
    d_u, d_b = flat(y).T @ flat(g), np.ones(target.size, np.float32) @ flat(g)
    d_y = _times(g, m.u.T)
    d_o = flat(c).T @ flat(d_y)
    d_c = _times(d_y, m.o.T)
    d_s = np.matmul(d_c, kv[:, :, WIDTH:].transpose(0, 2, 1))
    d_s -= _times(d_c * c, np.ones((WIDTH, 1), np.float32))
    d_s *= a
    d_q = np.matmul(d_s, kv[:, :, :WIDTH])
    d_kv = np.empty_like(kv)
    np.matmul(d_s.transpose(0, 2, 1), q, out=d_kv[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), d_c, out=d_kv[:, :, WIDTH:])
    # of the three products of every block, from the windows that it is in
    d_z = np.zeros((len(h), SPAN, 3 * WIDTH), np.float32)
    d_z[cur, :, :WIDTH] = d_q
    d_z[cur, :, WIDTH:] = d_kv[:, SPAN:]
    d_z[prev, :, WIDTH:] += d_kv[:, :SPAN]
    d_h = _times(d_z, both.T)
    d_h[cur] += d_y
    # and of the places' own part of them
    over = lambda z: (np.ones(len(z), np.float32) @ z.reshape(len(z), -1)).reshape(z.shape[1:])
    d_at = np.zeros((2 * SPAN, 3 * WIDTH), np.float32)
    d_at[:, WIDTH:] = over(d_kv)
    d_at[SPAN:, :WIDTH] = over(d_q)
    d_p = d_at @ both.T
    d_p[SPAN:] += over(d_y)
    d_both = flat(h).T @ flat(d_z) + m.p.T @ d_at
    return [d_p, d_both[:, :WIDTH] * scale, d_both[:, WIDTH : 2 * WIDTH], d_both[:, 2 * WIDTH :], d_o, d_u, d_b, d_h]


def _adam(weights: list[np.ndarray], grads: list[np.ndarray], moments: list[tuple[np.ndarray, np.ndarray]], step: int, rate: float) -> None:
    for weight, g, (first, second) in zip(weights, grads, moments, strict=True):
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        weight -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class Pass:
    """One pass of Adam from a trained model over parts of a corpus: every place is a target once."""

    def __init__(self, model: Model, rate: float = 0.003, batch: int = 512, seed: int = 2):
        self.start, self.model = model, Model(*[w.copy() for w in model.weights()])
        self.rate, self.batch, self.random, self.steps = rate, batch, np.random.default_rng(seed), 0
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
        #: Places learned from, and how many of them each subword id stood in front of or at.
        self.places, self.counts = 0, np.zeros(len(model.f), np.int64)

    def learn(self, stream: np.ndarray, offsets: np.ndarray, words: np.ndarray, pieces: np.ndarray, lens: np.ndarray) -> None:
        """As :func:`train`, streams one after the other; Adam's numbers of subword ids that aren't here stand still."""
        if not len(stream):
            return
        m = self.model
        ids, own = numbered(pieces, len(m.f))
        here = Model(m.e, m.f[ids], *m.weights()[2:])  # all but f are shared and change in place
        moments = [self.moments[0], tuple(x[ids] for x in self.moments[1]), *self.moments[2:]]
        corpus = Corpus(stream, offsets, words, own, lens, len(m.e) - 2)
        starts = np.arange(0, len(corpus.blocks.first), self.batch)
        for low in self.random.permutation(starts).tolist():
            self.steps += 1
            grads = corpus.gradients(here, slice(low, low + self.batch))
            _adam(here.weights(), grads, moments, self.steps, self.rate * min(1.0, self.steps / 20) / (1 + self.steps / 200))
        m.f[ids] = here.f
        for whole, part in zip(self.moments[1], moments[1], strict=True):
            whole[ids] = part
        self.places += len(stream)
        self.counts += np.bincount(pieces, np.repeat(np.bincount(words, minlength=len(lens) + 1)[:-1], lens), len(self.counts)).astype(np.int64)

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """How far the pass has moved the weights: of all but f in a row, and of f."""
        by = [a - b for a, b in zip(self.model.weights(), self.start.weights(), strict=True)]
        return np.concatenate([x.ravel() for i, x in enumerate(by) if i != 1]), by[1]
