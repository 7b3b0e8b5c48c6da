r"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags all tokens of a text as begin, inside or outside of a secret: words of ASCII letters and digits, words of
characters beyond ASCII, and single signs; white space lies between tokens. It sees each token's shape and word, the
*unit* around it (letters, digits and +/_.=- without a break), the words before and after and features of the whole
file, and is decoded by Viterbi over the text. Tokens of fixed spans are outside in every allowed tagging; tokens and
units are cut at the ends of those spans, so that what is glued to one is tagged by itself.

Most tokens are outside in every best tagging, which shows from their own scores and the next token's: retagging such a
token outside, and a following inside as begin, always gains (`Field.sure`). The tokens between them are decoded, all
stretches of a batch at a time; that is the same as decoding the whole text.

Training: windows of at most `sample` documents (those of the smallest hashes; the fraction follows from the number of
rows), tagged by the fixed patterns (of an assignment its value), and a fixed number of artificial texts with common
credentials, passwords and words that are none. At most `windows` windows (of `WINDOW` tokens) with a secret and as many
without one are learnt from: those of the smallest hashes of document and window, whatever the order of rows. Each window with a secret is taken also with the words around hidden, so
that shape alone can tell. The field is fitted by gradient ascent on its log-likelihood (forward-backward).

Nulls: a null text counts as empty and has no spans. Every input row gives a row; ids may repeat or be null. Positions
are code points, ends exclusive. With no windows to learn from, the artificial texts are all there is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that tell of a secret nearby; only features, nothing is left out for want of them.
TELLING = ("password", "passwd", "passphrase", "passcode", "pwd", "pass", "pin", "secret", "secrets", "token", "key", "apikey", "api", "auth", "authorization", "bearer", "credential", "credentials", "login", "private")
DIMS, BATCH = 1 << 15, 200_000
#: Tokens of a training window, and windows with a secret and without one that are learnt from at most.
WINDOW, WINDOWS = 24, 10_000
O, B, I = range(3)

SPACE, LOWER, UPPER, DIGIT, JOIN, SIGN, BEYOND = range(7)
KIND = np.array([SPACE if (c := chr(i)).isspace() else LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else JOIN if c in "+/_.=-" else SIGN for i in range(128)] + [BEYOND], np.uint8)
GROUP = np.array([0, 1, 1, 1, 2, 2, 3], np.uint8)
SPACES = np.array([i for i in range(128, 0x3001) if chr(i).isspace()], np.uint32)
PRIME = 0x9E3779B97F4A7C15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run of hex digits is what [0-9a-f]+ matches; shorter ones fail
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def file_features(text: str) -> list[str]:
    n = len(text) or 1
    return [f"file:len{min(int(math.log2(n)), 16)}", f"file:line{min(int(math.log2(n / (text.count(chr(10)) + 1) + 1)), 12)}", f"file:eq{min(8, int(1000 * text.count('=') / n))}", f"file:brace{'{' in text and '}' in text}"]


def _powers(n: int, of: int, held: dict = {}) -> np.ndarray:  # noqa: B006
    """of**0 to of**(n - 1), modulo 2**64."""
    if n > len(held.get(of, ())):
        whole = np.full(max(n, 2 * BATCH), of, np.uint64)
        whole[0] = 1
        whole = np.cumprod(whole, dtype=np.uint64)
        if n > 10 * BATCH:  # too long to keep
            return whole
        held[of] = whole
    return held[of][:n]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Feature numbers of the values x, for the salt."""
    h = (x.astype(np.uint64) + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int32)


class Tokens:
    """The tokens of some texts, cut also at the places of `cuts` (a list for each text): place, text and feature numbers of each."""

    def __init__(self, texts: list[str], cuts: list[list[int]] | None = None):
        self.texts = texts
        self.offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = KIND[np.minimum(code, 128)]
        beyond = np.flatnonzero(kind == BEYOND)
        kind[beyond[np.isin(code[beyond], SPACES)]] = SPACE
        group, cut = GROUP[kind], np.zeros(len(code) + 1, bool)
        for at, places in zip(self.offsets.tolist(), cuts or [[]] * len(texts), strict=True):
            for c in places:
                cut[at + c] = True
        edge = np.ones(len(code) + 1, bool)
        edge[1:-1] = (group[1:] != group[:-1]) | (group[1:] == 2) | cut[1:-1]
        edge = np.flatnonzero(edge)
        k = np.flatnonzero(group[edge[:-1]]) if len(code) else np.zeros(0, int)
        self.start, self.end = edge[k], edge[k + 1] if len(code) else k
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.code, self.kind, self.cut = code, kind, cut

    def __len__(self) -> int:
        return len(self.start)

    def columns(self) -> Iterator[tuple[bool, np.ndarray]]:
        """For each feature: does it tell of words around, and its number at each token."""
        start, end, text, code, kind, n = self.start, self.end, self.text, self.code, self.kind, len(self)
        here, sums = np.arange(n), lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        low = code + (kind == UPPER) * np.uint32(32)
        whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(len(low), PRIME), dtype=np.uint64)])
        inverse = _powers(len(low) + 1, pow(PRIME, -1, 1 << 64))
        word = (whole[end] - whole[start]) * inverse[start]
        digit, upper, lower = (sums(kind == k) for k in (DIGIT, UPPER, LOWER))
        hexa = sums((kind == DIGIT) | ((code >= 97) & (code <= 102)))
        change = sums(np.concatenate([[False], kind[1:] != kind[:-1]]))
        first_kind, count = kind[start], lambda of, a, b: of[b] - of[a]
        shape = np.where(GROUP[first_kind] == 1, 100 + (first_kind * 4 + kind[end - 1]).astype(int) * 64 + np.minimum(change[end] - change[start + 1], 7) * 8 + (count(digit, start, end) > 0) * 4 + (count(upper, start, end) > 0) * 2 + (count(lower, start, end) > 0), np.where(GROUP[first_kind] == 2, 10_000 + code[start].astype(int), 20_000))

        new = np.ones(n, bool)
        new[1:] = text[1:] != text[:-1]
        opening = np.maximum.accumulate(np.where(new, here, 0))  # the first token of the text
        gap = np.full(n + 1, 3)
        gap[1:n] = np.where(new[1:], 3, np.minimum(start[1:] - end[:-1], 2))
        joined = (first_kind >= LOWER) & (first_kind <= JOIN)
        new[1:] |= (start[1:] != end[:-1]) | ~joined[1:] | ~joined[:-1] | self.cut[start[1:]]
        unit, head = np.cumsum(new) - 1, np.flatnonzero(new)
        tail = np.concatenate([head[1:], [n]])
        a, b = start[head], end[tail - 1]
        size, parts, shares = b - a, tail - head, [count(of, a, b) for of in (digit, upper, lower)]
        form = sum((x > 0) << k for k, x in enumerate(shares)) + np.minimum(parts, 4) * 8 + np.minimum(size // 4, 6) * 64
        turns = change[b] - change[a + 1]
        prefix = (whole[np.minimum(a + 3, b)] - whole[a]) * inverse[a]
        telling = sums(np.isin(word, _telling()))
        near = np.minimum(telling[:n] - telling[np.maximum(head[unit] - 4, opening)], 2)
        was = lambda of, at: np.where(at >= opening, of[np.maximum(at, 0)], of.dtype.type(1))
        then = lambda of: np.where(gap[1:] < 3, np.append(of[1:], of.dtype.type(1)), of.dtype.type(1))

        own = [shape, np.minimum(end - start, 48) // 2, np.minimum(here - head[unit], 4), word, was(shape, here - 1) * 4 + gap[:n], then(shape) * 4 + gap[1:]]
        own += [x[unit] for x in (np.minimum(size // 2, 32), *(x * 5 // size for x in shares), turns * 8 // size, (count(hexa, a, b) == size) * 33 + np.minimum(size // 4, 16), np.minimum(parts, 8), prefix, form, kind[a] * 8 + np.minimum(turns, 7))]
        yield from ((False, _mix(x, k)) for k, x in enumerate(own))
        around = lambda: (was(word, here - 1), was(word, here - 2), then(word), *(was(word, head[unit] - k) for k in (1, 2, 3)), near, near * 4096 + form[unit], near * 65_536 + shape)
        yield from ((True, _mix(x, 100 + k)) for k, x in enumerate(around()))
        of_file = np.array([[zlib.crc32(f.encode()) % DIMS for f in file_features(t)] for t in self.texts], np.int32).reshape(-1, 4)
        yield from ((False, of_file[text, k]) for k in range(4))


def _telling(held: list = []) -> np.ndarray:  # noqa: B006
    if not held:
        held.append(np.array([sum((ord(c) + 1) * pow(PRIME, k, 1 << 64) for k, c in enumerate(w)) & (1 << 64) - 1 for w in TELLING], np.uint64))
    return held[0]


def _artificial(n: int) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start, end, is it a secret) of made-up credentials and passwords, and of numbers, names and words that are none; the same at each call."""
    r = random.Random(17)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    words = "able army bank blue bread bridge castle chair cloud correct dance dragon earth falcon garden hammer horse hunter island jungle kettle letter lemon maple market monkey mountain needle ocean orange paper pencil planet rabbit river school shadow silver staple battery summer table tiger tower valley window winter yellow zebra".split()
    prose = "required the of a and valid not wrong used stored here to changed in missing optional long very state-of-the-art well-known up-to-date and/or INTRODUCTION WARNING COPYRIGHT NATO one-to-one".split()
    secret = (
        lambda: "sk_live_" + pick(alnum, 24), lambda: "ghp_" + pick(alnum, 36), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24), lambda: pick("0123456789abcdef", r.choice((18, 32, 40, 64))),
        lambda: base64.b64encode(r.randbytes(30)).decode(), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40), lambda: "AIza" + pick(alnum + "-_", 35), lambda: pick(alnum, r.choice((20, 32, 40))),
        lambda: "/" + pick(alnum + "/+", 40), lambda: pick(alnum[:26], r.choice((16, 20, 24, 32))),
    )
    word = (lambda: r.choice(words) + pick("0123456789", r.choice((1, 2, 3, 4))), lambda: "-".join(r.choice(words) for _ in range(r.choice((3, 4, 5)))), lambda: r.choice(words).title() + pick("0123456789", 2) + r.choice("!#$@"), lambda: pick(alnum, r.choice((7, 8, 10, 12))), lambda: pick(alnum[:26], r.choice((12, 16, 20))))
    plain = (
        lambda: pick("0123456789", r.choice((8, 10, 13, 16))), lambda: f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        lambda: f"{r.randrange(100, 999)}-{r.randrange(1000, 9999)}", lambda: "v" + ".".join(str(r.randrange(40)) for _ in range(3)) + "-beta", lambda: "get" + pick("abcdeinorst", 5).title() + "Value", lambda: f"www.{pick('abcdeinorst', 6)}{r.randrange(99)}.example", lambda: f"/{pick('abcdeinorst', 6)}/{r.randrange(9999)}.html", lambda: f"{pick('abcdeinorst', 6)}_{r.randrange(999)}",
        lambda: "-".join(r.choice(words) for _ in range(r.choice((2, 3, 4)))), lambda: r.choice(words) + pick("0123456789", 1), lambda: r.choice(words).upper(), lambda: r.choice(prose),
    )
    telling = ("pwd is ", "pwd: ", "password is ", "my password is ", "passphrase ", "passphrase: ", "passphrase is ", "key ", "key: ", "key = ", "login pwd=", "pass: ", "the secret ", "secret key is ", "credentials ", "auth = ", 'token "')
    for k in range(n):
        is_secret = k % 2 == 0
        if k % 4 == 0:
            lead, body = r.choice(telling), r.choice(word)()
        elif is_secret:
            lead, body = r.choice((*telling, "the of and ", "is ", "")), r.choice(secret)()
        elif k % 4 == 1:
            lead, body = r.choice(telling), f"{r.choice(prose)} {r.choice(prose)} {r.choice(words)}"
        else:
            lead, body = r.choice(("the of and ", "is ", f"{r.choice(words)} {r.choice(words)}: ", "")), r.choice(plain)()
        begin = " ".join(r.choice(words + prose) for _ in range(r.randrange(5)))
        lead = f"{begin} {lead}" if begin else lead
        yield f"{lead}{body} {r.choice(prose)} {r.choice(words)}", len(lead), len(lead) + len(body), is_secret


def _chains(texts: list[str], spans: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, window, feature numbers, tags) of all windows of the texts, those with a secret also with the words around hidden (as feature 0)."""
    tokens = Tokens(texts)
    columns = list(tokens.columns())
    feats, around = np.stack([c for _, c in columns], 1), np.array([a for a, _ in columns])
    tags = np.zeros(len(tokens), np.uint8)
    for k, found in enumerate(spans):
        for a, b in found:
            inside = slice(*np.searchsorted(tokens.start, (tokens.offsets[k] + a, tokens.offsets[k] + b)))
            tags[inside] = I
            tags[inside][:1] = B
    edges = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        for w, at in enumerate(range(edges[k], edges[k + 1], WINDOW)):
            part = slice(at, min(at + WINDOW, edges[k + 1]))
            some = tags[part].copy()
            if some[0] == I:
                some[0] = B
            yield k, w, feats[part], some
            if some.any():
                yield k, ~w, np.where(around, 0, feats[part]), some


def _values(text: str) -> list[tuple[int, int]]:
    """The fixed spans, of assignments only the value, without those that overlap an earlier one."""
    spans, out = [], []
    for a, b, kind in base_spans(text):
        spans.append((ASSIGN.match(text, a).start(2) if kind == "assign" else a, b))
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _sampled_windows(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Of the windows of (hash, text) with a secret, and of those without one, the `most` of the smallest ranks: rank, secret, feats, tags.

    The rank is a hash of the document's hash, the window and whether its words around are hidden, so windows of all places in the table and in a text are alike.
    """
    held: dict[bool, list[tuple]] = {True: [], False: []}
    bound = {True: 1 << 60, False: 1 << 60}
    cut = lambda of: heapq.nsmallest(most, of)
    while some := list(itertools.islice(rows, 50)):
        for k, w, feats, tags in _chains([text for _, text in some], [_values(text) for _, text in some]):
            rank = int.from_bytes(hashlib.blake2b(f"{some[k][0]}:{w}".encode(), digest_size=7).digest())
            secret = bool(tags.any())
            if rank <= bound[secret]:
                held[secret].append((rank, secret, feats.astype(np.uint16).tobytes(), tags.tobytes()))
            if len(held[secret]) >= 2 * most:
                held[secret] = cut(held[secret])
                bound[secret] = held[secret][-1][0]
    for of in held.values():
        yield from cut(of)


class Field:
    """A linear-chain conditional random field over sparse features: weights (features x 3) and transitions (start + 3) x 3."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """chains: feature numbers (tokens x features) and tags. Feature 0 stands for what is hidden and has no weight."""
        size, longest = len(chains), max(len(t) for _, t in chains)
        tags, there = np.zeros((size, longest), int), np.zeros((size, longest), bool)
        for i, (_, ts) in enumerate(chains):
            tags[i, : len(ts)], there[i, : len(ts)] = ts, True
        cols = np.ascontiguousarray(np.concatenate([f for f, _ in chains]).T, np.intp)
        weights, moves = np.zeros((DIMS, 3)), np.zeros((4, 3))
        moves[[O, 3], I] = -20.0  # inside never follows outside or the start
        free = moves > -20

        def sums(of: np.ndarray) -> np.ndarray:
            """For each feature the sum of the rows of `of` where it is."""
            out = np.zeros((DIMS, 3))
            for t, each in enumerate(np.ascontiguousarray(of.T)):
                out[:, t] = sum(np.bincount(col, each, DIMS) for col in cols)
            out[0] = 0
            return out

        gold_w = sums(np.eye(3)[tags[there]])
        gold_m = np.zeros((4, 3))
        np.add.at(gold_m, (np.full(size, 3), tags[:, 0]), 1)
        for k in range(1, longest):
            np.add.at(gold_m, (tags[:, k - 1][there[:, k]], tags[:, k][there[:, k]]), 1)
        square_w, square_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
        lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
        for _ in range(rounds):
            score = np.zeros((size, longest, 3))
            score[there] = sum(weights.take(col, axis=0) for col in cols)
            ahead = np.zeros_like(score)
            ahead[:, 0] = moves[3] + score[:, 0]
            for k in range(1, longest):
                new = lse(ahead[:, k - 1, :, None] + moves[None, :3], 1) + score[:, k]
                ahead[:, k] = np.where(there[:, k, None], new, ahead[:, k - 1])
            total = lse(ahead[:, -1], 1)
            back = np.zeros_like(score)
            want_m = np.zeros_like(moves)
            for k in range(longest - 1, 0, -1):
                on = there[:, k]
                pair = np.exp(ahead[on, k - 1, :, None] + moves[None, :3] + (score[on, k] + back[on, k])[:, None, :] - total[on, None, None])
                want_m[:3] += pair.sum(axis=0)
                back[on, k - 1] = lse(moves[None, :3] + (score[on, k] + back[on, k])[:, None, :], 2)
            share = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
            want_m[3] += share[:, 0].sum(axis=0)
            grad_w, grad_m = (gold_w - sums(share[there])) / size - decay * weights, np.where(free, (gold_m - want_m) / size, 0)
            square_w += grad_w**2
            square_m += grad_m**2
            weights += rate * grad_w / np.sqrt(square_w)
            moves += np.where(free, rate * grad_m / np.sqrt(square_m), 0)
        return cls(weights, moves)

    def score(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens), 3))
        for _, numbers in tokens.columns():
            out += self.weights.take(numbers, axis=0)
        return out

    def sure(self, score: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that are outside in every best tagging: to tag one begin or inside costs more than outside, whatever comes before and after.

        Where inside follows, the tagging is held against outside, then begin. last: is the token the last one of its text.
        """
        m, out = self.moves, np.ones(len(score), bool)
        ahead = np.vstack([score[1:], np.zeros((1, 3))])
        for tag in (B, I):
            entry = (m[:, tag] - m[:, O]).max()
            gain = score[:, tag] - score[:, O] + entry
            apart = max(0.0, *(m[tag, n] - m[O, n] for n in (O, B)))
            onward = m[tag, I] - m[O, B] + max(0.0, *(m[I, n] - m[B, n] for n in range(3)))
            out &= (gain + apart < -1e-6) & (last | (gain + onward + ahead[:, I] - ahead[:, B] < -1e-6))
        return out

    def tags(self, score: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best tagging of each text, by Viterbi; text: whose token it is, in order."""
        n = len(score)
        out = np.zeros(n, np.uint8)
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = last[:-1] = text[1:] != text[:-1]
        open_ = ~self.sure(score, last)
        if not open_.any():
            return out
        # stretches of open tokens; sure ones and ends of texts lie between
        begin = np.flatnonzero(open_ & (first | ~np.concatenate([[False], open_[:-1]])))
        stop = np.flatnonzero(open_ & (last | ~np.concatenate([open_[1:], [False]]))) + 1
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        begin, stop = begin[order], stop[order]
        size = stop - begin
        at = np.concatenate([[0], np.cumsum(np.bincount(size)[::-1].cumsum()[::-1][1:])])  # of each step, where its rows of `came` are
        came = np.zeros((at[-1], 3), np.uint8)
        best = self.moves[np.where(first[begin], 3, O)] + score[begin]
        for k in range(1, size[0]):
            live = at[k + 1] - at[k]
            come = best[:live, :, None] + self.moves[None, :3]
            came[at[k] : at[k + 1]] = come.argmax(axis=1)
            best[:live] = come.max(axis=1) + score[begin[:live] + k]
        tag = (best + np.where(last[stop - 1], 0.0, self.moves[:3, O][:, None]).T).argmax(axis=1)
        for k in range(size[0] - 1, -1, -1):
            live = at[k + 1] - at[k]
            out[begin[:live] + k] = tag[:live]
            if k:
                tag[:live] = came[np.arange(at[k], at[k + 1]), tag[:live]]
        return out


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 20_000, artificial: int = 2000, windows: int = WINDOWS) -> Field:
    """Fit the field on windows of at most about `sample` documents: at most `windows` with a secret and as many without one, those of the smallest ranks, come to the driver."""
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.xxhash64(key, text), F.coalesce(F.col(text), F.lit("")))
    of_tasks = written(map_rows(some, "rank long, secret boolean, feats binary, tags binary", lambda rows: _sampled_windows(rows, windows), flush=500), "windows")
    # ranks are even over 56 bits; counts of their first 12 say below which bound the smallest are, so tasks send few others
    counts = {(r[0], r[1]): r[2] for r in of_tasks.groupBy("secret", F.shiftright("rank", 44)).count().collect()}
    chains = []
    for secret in (True, False):
        sums = itertools.accumulate(counts.get((secret, k), 0) for k in range(1 << 12))
        bound = next((k for k, n in enumerate(sums) if n >= windows), 1 << 12) + 1
        for *_, feats, tags in of_tasks.where((F.col("secret") == secret) & (F.col("rank") < bound << 44)).orderBy("rank", "feats", "tags").limit(windows).collect():
            tags = np.frombuffer(tags, np.uint8)
            chains.append((np.frombuffer(feats, np.uint16).reshape(len(tags), -1).astype(np.int32), tags))
    made = list(_artificial(artificial))
    chains += [(feats, tags) for _, _, feats, tags in _chains([t for t, *_ in made], [[(a, b)] if is_secret else [] for _, a, b, is_secret in made])]
    return Field.fit(chains)


def field_spans_of(texts: list[str], field: Field, taken: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """For each text, the spans of the field that overlap none of its `taken` ones."""
    tokens = Tokens(texts, [[p for a, b, _ in spans for p in (a, b)] for spans in taken])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(tokens):
        return out
    score = field.score(tokens)
    held = np.zeros(len(tokens.cut) + 1, int)
    for at, spans in zip(tokens.offsets.tolist(), taken, strict=True):
        for a, b, _ in spans:
            held[at + a] += 1
            held[at + b] -= 1
    score[np.cumsum(held)[tokens.start] > 0, 1:] = -1e9
    tags = field.tags(score, tokens.text)
    begin = np.flatnonzero(tags == B)
    if len(begin):
        rest = np.append(np.flatnonzero((tags != I) | np.concatenate([[True], tokens.text[1:] != tokens.text[:-1]])), len(tags))
        stop = rest[np.searchsorted(rest, begin, "right")] - 1  # the last token of each span
        whose = tokens.text[begin]
        for k, a, b in zip(whose.tolist(), (tokens.start[begin] - tokens.offsets[whose]).tolist(), (tokens.end[stop] - tokens.offsets[whose]).tolist(), strict=True):
            out[k].append((a, b, "crf"))
    return out


def field_spans(text: str, field: Field, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the field that overlap none of `taken`."""
    return field_spans_of([text], field, [taken])[0]


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, base and added spans as array<struct<kind,start,end>>."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        form = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]

        def found(some: list[tuple]) -> Iterator[tuple]:
            base = [base_spans(text) for _, text in some]
            for (doc_id, _), own, added in zip(some, base, field_spans_of([text for _, text in some], held.value, base), strict=True):
                yield doc_id, form(own), form(added)

        some, size = [], 0
        for row in rows:
            some.append(row)
            size += len(row[1]) + 1
            if size > BATCH:
                yield from found(some)
                some, size = [], 0
        yield from found(some)

    span = "array<struct<kind:string,start:long,end:long>>"
    return map_rows(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), f"key {docs.schema[key].dataType.simpleString()}, base {span}, added {span}", run).withColumnRenamed("key", key)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("b"))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"].cast("int")), s["a"].cast("string"), s["b"].cast("string"))), ",")
    return scanned.select(key, *map(count, KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
