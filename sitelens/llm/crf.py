"""A linear-chain conditional random field over the words of texts, trained and applied in numpy.

A word's features are itself (lexicon), its affixes of up to four characters and the two- and three-character grams of the
word between its ends; they are hashed to BUCKETS weights for each label, or fewer where there are many labels. Transitions are one weight for each pair of labels.
The score of a labelling is the sum of both; forward-backward gives the probability of each label at each word.
"""

from __future__ import annotations

import zlib

import numpy as np

BUCKETS = 1 << 17
#: Words of a lane: texts are cut into lanes, worked on side by side and joined by their transfer matrices.
LANE = 32
#: Labels up to which transfer matrices pay; with more, texts are worked on side by side, word after word.
LANE_LABELS = 64


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Numbers of the hashed features of a lower-case word; buckets is a power of two."""
    own = f"^{word}$"
    names = ["w" + word]
    names += ["p" + word[:k] for k in range(1, min(4, len(word)) + 1)]
    names += ["s" + word[-k:] for k in range(1, min(4, len(word)) + 1)]
    names += [own[i : i + 2] for i in range(len(own) - 1)]
    names += [own[i : i + 3] for i in range(len(own) - 2)]
    crc = zlib.crc32
    return [crc(n.encode()) & (buckets - 1) for n in names]


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Sum of the feature weights of each word, a row a word."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    lists = [features(w, len(weights)) for w in words]
    flat = np.concatenate([np.array(x) for x in lists])
    first = np.cumsum([0] + [len(x) for x in lists[:-1]])
    return np.add.reduceat(weights[flat], first, axis=0)


def forward_backward(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the labels (S x T x L) and of pairs of neighbours summed over places (L x L), and the log of each
    sequence's sum over labellings, for S sequences of T words."""
    s, t, n = emission.shape
    top = emission.max(axis=2)
    e = np.exp(emission - top[:, :, None])
    a = np.exp(transition)
    alpha = np.empty((s, t, n))
    scale = np.empty((s, t))
    state = e[:, 0]
    for k in range(t):
        state = e[:, 0] if k == 0 else (state @ a) * e[:, k]
        scale[:, k] = state.sum(axis=1)
        state = state / scale[:, k, None]
        alpha[:, k] = state
    beta = np.ones((s, t, n))
    pairs = np.zeros((n, n))
    for k in range(t - 2, -1, -1):
        ahead = beta[:, k + 1] * e[:, k + 1] / scale[:, k + 1, None]
        beta[:, k] = ahead @ a.T
        pairs += (alpha[:, k].T @ ahead) * a
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return gamma, pairs, np.log(scale).sum(axis=1) + top.sum(axis=1)


def train(streams: list[list[str]], buckets: int = BUCKETS, steps: int = 240, batch: int = 192, half: int = 16, rate: float = 0.25, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from one stream of words for each label. Every sequence is two pieces of `half` words; in half of
    the sequences they come from different labels, as in text that switches between languages. Adagrad on the negative log
    likelihood of batches; all draws are seeded."""
    n = len(streams)
    random = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    pieces = []
    for own in streams:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in own]
        ids = (ids * (-(-half // max(1, len(ids)))))[: max(half, len(ids) // half * half)]
        pieces.append(np.array(ids, dtype=np.int64).reshape(-1, half))
    lists = [features(w, buckets) for w in vocabulary]
    size = np.array([len(x) for x in lists])
    flat = np.concatenate([np.array(x) for x in lists])
    first = np.cumsum(size) - size
    weights, seen = np.zeros((buckets, n)), np.full((buckets, n), 1e-6)
    transition, seen_t = np.zeros((n, n)), np.full((n, n), 1e-6)
    for _ in range(steps):
        left = random.integers(0, n, batch)
        other = (left + random.integers(1, max(2, n), batch)) % n
        right = np.where(random.random(batch) < 0.5, other, left)
        gold = np.repeat(np.stack([left, right], axis=1), half, axis=1)
        ids = np.stack([np.concatenate([pieces[a][random.integers(len(pieces[a]))], pieces[b][random.integers(len(pieces[b]))]]) for a, b in zip(left, right, strict=True)])
        used, where = np.unique(ids, return_inverse=True)
        spread = np.concatenate([flat[first[w] : first[w] + size[w]] for w in used])
        at = np.cumsum(size[used]) - size[used]
        e = np.add.reduceat(weights[spread], at, axis=0)[where.reshape(ids.shape)]
        gamma, pairs, _ = forward_backward(e, transition)
        gap = gamma.reshape(-1, n).copy()
        gap[np.arange(len(gap)), gold.reshape(-1)] -= 1.0
        by_word = np.zeros((len(used), n))
        np.add.at(by_word, where.reshape(-1), gap)
        by_feature = np.repeat(by_word, size[used], axis=0) / batch
        touched, back = np.unique(spread, return_inverse=True)
        g = np.zeros((len(touched), n))
        np.add.at(g, back, by_feature)
        g += decay * weights[touched]
        seen[touched] += g * g
        weights[touched] -= rate * g / np.sqrt(seen[touched])
        held = np.zeros((n, n))
        np.add.at(held, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1.0)
        gt = (pairs - held) / batch
        seen_t += gt * gt
        transition -= rate * gt / np.sqrt(seen_t)
    return weights, transition


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label probabilities of every word (N x L). first: where each text begins, ascending; no text is empty. Texts are cut into
    lanes of LANE words. The transfer matrix of each lane is the product of its steps; carried from lane to lane of a text, it
    gives what enters each lane from either side, and then all lanes run forward and backward at once."""
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels))
    if labels > LANE_LABELS:
        return side_by_side(emission, first, transition)
    size = np.diff(np.append(first, n))
    lanes = -(-size // LANE)
    lane0 = np.cumsum(lanes) - lanes
    total = int(lanes.sum())
    within = np.arange(n) - np.repeat(first, size)
    lane = np.repeat(lane0, size) + within // LANE
    step = within % LANE
    e = np.ones((LANE, total, labels))
    e[step, lane] = np.exp(emission - emission.max(axis=1, keepdims=True))
    here = np.zeros((LANE, total), dtype=bool)
    here[step, lane] = True
    a = np.exp(transition - transition.max())
    # transfer: product over the steps of a lane of a * e; places past the end of a text change nothing
    transfer = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    starts = np.zeros(total, dtype=bool)
    starts[lane0] = True
    for k in range(LANE):
        on = here[k]
        moved = (transfer[on].reshape(-1, labels) @ a).reshape(-1, labels, labels)
        if k == 0:
            moved[starts[on]] = np.eye(labels)  # a text begins with any label
        m = moved * e[k, on][:, None, :]
        transfer[on] = m / m.max(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((total, labels)), np.ones((total, labels))
    live = np.flatnonzero(lanes > 1)
    k = 1
    while len(live):
        at = lane0[live] + k
        v = np.einsum("ni,nij->nj", enter[at - 1], transfer[at - 1])
        enter[at] = v / v.max(axis=1, keepdims=True)
        back = lane0[live] + lanes[live] - 1 - k
        v = np.einsum("nij,nj->ni", transfer[back + 1], leave[back + 1])
        leave[back] = v / v.max(axis=1, keepdims=True)
        k += 1
        live = live[lanes[live] > k]
    alpha = np.empty_like(e)
    state = enter
    for k in range(LANE):
        moved = state @ a
        if k == 0:
            moved = np.where(starts[:, None], 1.0, moved)
        new = moved * e[k]
        new /= new.max(axis=1, keepdims=True)
        state = np.where(here[k][:, None], new, state)
        alpha[k] = state
    out = np.empty((LANE, total, labels))
    back = leave
    for k in range(LANE - 1, -1, -1):
        out[k] = alpha[k] * back
        new = (back * e[k]) @ a.T
        new /= new.max(axis=1, keepdims=True)
        back = np.where(here[k][:, None], new, back)
    found = out[step, lane]
    return found / found.sum(axis=1, keepdims=True)


def side_by_side(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The same as marginals() in memory of N x L: all texts step by step, the longest first."""
    n, labels = emission.shape
    size = np.diff(np.append(first, n))
    by = np.argsort(-size, kind="stable")
    begin, size = first[by], size[by]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    a = np.exp(transition - transition.max())
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts of more than so many words
    out = np.empty_like(e)
    state = np.ones((len(size), labels))
    for t, m in enumerate(live.tolist()):
        at = begin[:m] + t
        state = (state[:m] @ a if t else state) * e[at]
        state /= state.max(axis=1, keepdims=True)
        out[at] = state
    back = np.ones((len(size), labels))
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        out[at] *= back[:m]
        new = (back[:m] * e[at]) @ a.T
        back[:m] = new / new.max(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)
