"""Interpolated Kneser-Ney models over characters, one per class, in sorted arrays.

A text is lower-cased; letters and digits keep their identity, everything else
is one space. An n-gram is packed into 64 bits, eight bits a character, and
never reaches over the space before its word, so a word's start is a context
of its own. All n-grams of an order lie in one sorted array with a row of log
probabilities, a column per class; a context has a row of backoff weights. A
lookup is a binary search, the longest known n-gram first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Ids from OTHER on are shared by letters that aren't among the most frequent ones: one id per 256 code points, modulo OTHERS.
SPACE, OTHER, OTHERS, CODES = 1, 224, 32, 0x110000


@dataclass
class CharModel:
    classes: list
    order: int
    alphabet: np.ndarray  # code point -> id
    grams: list = field(default_factory=list)  # per length: sorted packed n-grams
    logp: list = field(default_factory=list)  # per length: natural log probability by class
    contexts: list = field(default_factory=list)  # per length: sorted packed contexts
    backoff: list = field(default_factory=list)  # per length: log weight of what the context leaves to shorter ones


def alphabet_of(texts: list[str]) -> np.ndarray:
    """Ids for the most frequent letters and digits; other letters share an id with those near them, all else is a space."""
    letters = np.fromiter((chr(i).isalnum() for i in range(CODES)), bool, CODES)
    table = np.where(letters, OTHER + (np.arange(CODES) >> 8) % OTHERS, SPACE).astype(np.uint8)
    seen = np.zeros(CODES, np.int64)
    for t in texts:
        at, n = np.unique(points(t), return_counts=True)
        seen[at] += n
    seen[~letters] = 0
    best = np.argsort(-seen, kind="stable")[: OTHER - 2]
    best = best[seen[best] > 0]
    table[best] = np.arange(2, 2 + len(best), dtype=np.uint8)
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str | None, alphabet: np.ndarray) -> np.ndarray:
    """Ids of a text's characters with one space before each word; empty without letters or digits."""
    if not text:
        return np.empty(0, np.uint8)
    ids = alphabet[points(text)]
    keep = np.empty(len(ids), bool)
    keep[:1] = ids[:1] != SPACE
    np.not_equal(ids[1:], SPACE, out=keep[1:])
    keep[1:] |= ids[:-1] != SPACE
    ids = ids[keep]
    if len(ids) and ids[-1] == SPACE:
        ids = ids[:-1]
    return np.concatenate((np.array([SPACE], np.uint8), ids)) if len(ids) else ids


def packed(ids: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the packed n-gram that ends there and its length: at most order, not over the last space before it."""
    n = len(ids)
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(ids == SPACE, at, 0))
    # a space itself is seen from the word before it
    if n:
        last[1:] = np.where(ids[1:] == SPACE, last[:-1], last[1:])
    length = np.minimum(at - last + 1, order).astype(np.uint8)
    code = ids.astype(np.uint64)
    for k in range(1, order):
        shifted = np.zeros(n, np.uint64)
        shifted[k:] = ids[:-k].astype(np.uint64) << np.uint64(8 * k) if n > k else 0
        code |= shifted
    masks = np.array([(1 << (8 * k)) - 1 for k in range(order + 1)], np.uint64)
    return code & masks[length], length


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True) if len(codes) else (np.empty(0, np.uint64), np.empty(0, np.int64))


def at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted in the sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return i, keys[i] == wanted


def fit(texts: dict, order: int, shared: bool, least: int = 1) -> CharModel:
    """A model per class of texts.

    With `shared`, all lengths but a position's longest are counted over all
    classes together, so a rare expression falls back to what the classes
    have in common; otherwise each class has its own. Lengths below the
    longest count the distinct characters before an n-gram, as Kneser-Ney
    asks, except at the start of a word, where there is none. N-grams seen
    fewer than `least` times in all classes together are left out of the
    longest length.
    """
    classes = sorted(texts)
    model = CharModel(classes, order, alphabet_of([t for c in classes for t in texts[c]]))
    k = len(classes)
    full: list[list] = [[] for _ in range(order + 1)]  # per length: per class packed n-grams
    lower: list[list] = [[] for _ in range(order + 1)]
    masks = [(1 << (8 * n)) - 1 for n in range(order + 1)]
    if not classes:
        return model
    for c in classes:
        codes, lengths = [], []
        for t in texts[c]:
            ids = symbols(t, model.alphabet)
            if len(ids) > 1:
                code, length = packed(ids, order)
                codes.append(code[1:])
                lengths.append(length[1:])
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        length = np.concatenate(lengths) if lengths else np.empty(0, np.uint8)
        for n in range(1, order + 1):
            full[n].append(counted(code[length == n]))
            if n < order:
                # types one character longer, of any position that reaches so far
                longer = np.unique(code[length > n] & np.uint64(masks[n + 1]))
                lower[n].append(counted(longer & np.uint64(masks[n])))
    if shared:
        for n in range(1, order):
            types = np.unique(np.concatenate([x[0] for x in full[n + 1]] + [x[0] for x in full_longer(full, n + 1, order, masks)]))
            lower[n] = [counted(types & np.uint64(masks[n]))] * k
    below_grams, below_logp = np.empty(0, np.uint64), None
    for n in range(1, order + 1):
        sets = [merged(full[n][i], lower[n][i] if n < order else None, n, order) for i in range(k)]
        keys = np.unique(np.concatenate([s[0] for s in sets]))
        counts = np.zeros((len(keys), k))
        for i, (g, c) in enumerate(sets):
            counts[np.searchsorted(keys, g), i] = c
        if n == order or shared:
            keep = counts.sum(1) >= (least if n == order else 1)
            keys, counts = keys[keep], counts[keep]
        ctx, where = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(ctx), k)), np.zeros((len(ctx), k))
        np.add.at(total, where, counts)
        np.add.at(kinds, where, counts > 0)
        ones, twos = (counts == 1).sum(0), (counts == 2).sum(0)
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if n == 1:
            base = np.full((len(keys), k), 1.0 / 256)
        else:
            base = np.exp(lookup(model, n - 1, keys & np.uint64(masks[n - 1])))
        p = np.maximum(counts - discount, 0) / np.maximum(total, 1)[where] + gamma[where] * base
        model.grams.append(keys)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(ctx)
        model.backoff.append(np.log(gamma).astype(np.float32))
    return model


def full_longer(full: list, n: int, order: int, masks: list) -> list:
    """N-grams of length n as the ends of longer ones."""
    return [(np.unique(g & np.uint64(masks[n])), None) for m in range(n + 1, order + 1) for g, _ in full[m]]


def merged(own: tuple, types: tuple | None, n: int, order: int) -> tuple:
    """Counts of an order: tokens where it is a position's longest, kinds of characters before it where it is not."""
    if types is None or not len(types[0]):
        return own
    if not len(own[0]):
        return types
    keys = np.concatenate((own[0], types[0]))
    counts = np.concatenate((own[1], types[1]))
    out, where = np.unique(keys, return_inverse=True)
    return out, np.bincount(where, weights=counts)


def lookup(model: CharModel, n: int, code: np.ndarray) -> np.ndarray:
    """Log probabilities by class of the last character of each n-gram of length n."""
    out = np.zeros((len(code), len(model.classes)), np.float32)
    open_ = np.arange(len(code))
    for m in range(n, 0, -1):
        i, found = at(model.grams[m - 1], code)
        out[open_[found]] += model.logp[m - 1][i[found]]
        open_, code = open_[~found], code[~found]
        if not len(open_):
            return out
        i, known = at(model.contexts[m - 1], code >> np.uint64(8))
        out[open_[known]] += model.backoff[m - 1][i[known]]
        code = code & np.uint64((1 << (8 * (m - 1))) - 1)
    out[open_] += np.float32(np.log(1.0 / 256))
    return out


def score_positions(model: CharModel, ids: np.ndarray) -> np.ndarray:
    """Log probabilities by class at every character after the first space."""
    code, length = packed(ids, model.order)
    code, length = code[1:], length[1:]
    out = np.empty((len(code), len(model.classes)), np.float32)
    for n in np.unique(length):
        here = np.flatnonzero(length == n)
        out[here] = lookup(model, int(n), code[here])
    return out


def blocks_of(texts: list, alphabet: np.ndarray, most: int = 1 << 20):
    """Texts joined into blocks of about `most` characters: (indices, ids, ends). Each text starts with its own space; longer texts are blocks of their own."""
    idx, parts, size = [], [], 0
    for i, t in enumerate(texts):
        ids = symbols(t, alphabet)
        if size and size + len(ids) > most:
            yield idx, parts
            idx, parts, size = [], [], 0
        idx.append(i)
        parts.append(ids)
        size += len(ids)
    if idx:
        yield idx, parts
