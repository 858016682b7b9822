"""Python kernels behind the Arrow functions: lexers, shingle hashes, winnowing and sequence comparison."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np

from . import constants as C

JAVASCRIPT = frozenset(C.JAVASCRIPT_KEYWORDS)
KEYWORDS = {
    "search": {"javascript": JAVASCRIPT, "typescript": JAVASCRIPT | set(C.TYPESCRIPT_ONLY) | set(C.TYPESCRIPT_SEARCH_ONLY), "python": frozenset(C.PYTHON_KEYWORDS)},
    "pipeline": {"javascript": JAVASCRIPT, "typescript": JAVASCRIPT | set(C.TYPESCRIPT_ONLY), "python": frozenset(C.PYTHON_KEYWORDS)},
}
# fixed values: what the lexers take as a token
_OPERATORS = r"=>|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/="
_SINGLE = r"[{}()\[\];,.:?=<>+\-*/%&|!^~]"
_STRINGS = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
_NUMBER = r"\b\d+(?:\.\d+)?\b"
# groups: 1 literal, 2 comment, 3 word, 4 punctuation
_LEXERS = {
    ("search", "script"): re.compile(rf"""({_STRINGS}|`(?:[^`\\]|\\.)*`|{_NUMBER})|(//[^\n]*|/\*[\s\S]*?\*/)|(\#?[A-Za-z_$][A-Za-z0-9_$]*)|({_OPERATORS}|\*\*|\.\.\.|{_SINGLE})""", re.ASCII),
    ("search", "python"): re.compile(rf"""(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|{_STRINGS}|{_NUMBER})|(\#[^\n]*)|([A-Za-z_][A-Za-z0-9_]*)|(==|!=|<=|>=|\*\*|//|:=|\.\.\.|{_SINGLE})""", re.ASCII),
    ("pipeline", "any"): re.compile(rf"""({_STRINGS}|`(?:[^`\\]|\\.)*`|{_NUMBER})|(//[^\n]*|/\*[\s\S]*?\*/|\#[^\n]*)|([A-Za-z_$][A-Za-z0-9_$]*)|({_OPERATORS}|\.\.\.|{_SINGLE})""", re.ASCII),
}


def lex(source: str, language: str | None, engine: str = "search", normalised: bool = False, lines: bool = False) -> tuple[list[str], list[int]]:
    """Token kinds of a source and, on demand, the line each begins on.

    Comments and unknown characters vanish. engine `search` has a lexer for scripts and one for Python and keeps
    spellings unless normalised; engine `pipeline` has one lexer, takes #, // and /* as comments in every language
    and always normalises.
    """
    known = KEYWORDS[engine].get(language or "", frozenset())
    flavour = "any" if engine == "pipeline" else "python" if language == "python" else "script"
    plain = normalised or engine == "pipeline"
    kinds: list[str] = []
    at: list[int] = []
    breaks = [m.start() for m in re.finditer("\n", source)] if lines else []
    for m in _LEXERS[engine, flavour].finditer(source):
        group = m.lastindex
        if group == 2:
            continue
        word = m.group()
        if group == 4:
            kinds.append(word)
        elif group == 1:
            kinds.append("LIT" if plain else "lit:" + word)
        elif word in known:
            kinds.append("kw:" + word)
        else:
            kinds.append("ID" if plain else "id:" + word)
        if lines:
            at.append(m.start())
    if lines:
        at = (np.searchsorted(np.array(breaks, dtype=np.int64), np.array(at, dtype=np.int64)) + 1).tolist()
    return kinds, at


def normal_kinds(kinds: list[str]) -> list[str]:
    """The normalised form of spelled kinds: identifiers and literals without their text."""
    return ["ID" if k[:3] == "id:" else "LIT" if k[:4] == "lit:" else k for k in kinds]


def fnv1a(text: str, start: int = 2166136261) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = start
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).tolist():
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


def shingle_hashes(kinds: list[str], k: int) -> list[int]:
    """FNV-1a of every run of k kinds, each kind followed by the separator U+0001.

    FNV has no rolling form, but it is the same affine step for all runs: all runs advance together, one code unit
    at a time, each as long as its own text lasts.
    """
    n = len(kinds) - k + 1
    if n <= 0:
        return []
    units = [np.frombuffer((x + "\x01").encode("utf-16-le", "surrogatepass"), dtype=np.uint16) for x in kinds]
    flat = np.concatenate(units).astype(np.uint64)
    ends = np.cumsum([len(u) for u in units])
    begins = np.concatenate([[0], ends[:-1]])
    first, last = begins[:n], ends[k - 1 :]
    h = np.full(n, 2166136261, dtype=np.uint64)
    lengths = last - first
    order = np.argsort(-lengths, kind="stable")
    h, position, lengths = h[order], first[order], lengths[order]
    step, mask = np.uint64(16777619), np.uint64(0xFFFFFFFF)
    alive = n
    for i in range(int(lengths[0])):
        while alive and lengths[alive - 1] <= i:
            alive -= 1
        h[:alive] = ((h[:alive] ^ flat[position[:alive] + i]) * step) & mask
    out = np.empty(n, dtype=np.uint64)
    out[order] = h
    return out.tolist()


def winnow(hashes: list[int], window: int) -> list[tuple[int, int]]:
    """(hash, position) of the least hash of every window, the rightmost on ties, each place once."""
    if not hashes:
        return []
    h = np.asarray(hashes, dtype=np.int64)
    size = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, size)
    place = np.arange(len(views)) + size - 1 - np.argmin(views[:, ::-1], axis=1)
    chosen = np.unique(place)
    return [(int(h[p]), int(p)) for p in chosen]


def fingerprints(kinds: list[str], profile: C.Profile) -> list[tuple[int, int]]:
    return winnow(shingle_hashes(kinds, profile.k), profile.window)


class _Codes(dict):
    """Numbers of the kinds of the tokens of one language, normalised or as spelled, comments 0; keeps so many tokens at most."""

    ROOM = 1 << 16

    def __init__(self, engine: str, language: str | None, numbers: dict[str, int], spelled: bool = False):
        super().__init__()
        self.spelled, self.script = spelled, engine == "pipeline" or language != "python"
        self.known, self.numbers = KEYWORDS[engine].get(language or "", frozenset()), numbers
        self.hashes = engine == "search" and self.script

    def __missing__(self, word: str) -> int:
        c = word[0]
        if "a" <= c <= "z" or "A" <= c <= "Z" or c in "_$" or c == "#" and self.hashes:
            kind = "kw:" + word if word in self.known else "id:" + word if self.spelled else "ID"
        elif c in "\"'`0123456789":
            kind = "lit:" + word if self.spelled else "LIT"
        else:
            kind = "" if c == "#" or self.script and word[:2] in ("//", "/*") else word
        n = self.numbers.setdefault(kind, len(self.numbers))
        if len(self) < self.ROOM and len(word) < 64:
            self[word] = n
        return n


_FLAT = {key: re.compile(re.sub(r"(?<!\\)\((?!\?)", "(?:", lexer.pattern), re.ASCII) for key, lexer in _LEXERS.items()}


def fnv_rows(kinds: list[str], rows: np.ndarray) -> np.ndarray:
    """FNV-1a of rows of numbers of kinds, each kind followed by U+0001."""
    units = [np.frombuffer((x + "\x01").encode("utf-16-le", "surrogatepass"), dtype=np.uint16) for x in kinds]
    sizes = np.array([len(u) for u in units])
    padded = np.zeros((len(units), int(sizes.max())), dtype=np.uint32)
    for i, u in enumerate(units):
        padded[i, : len(u)] = u
    h = np.full(len(rows), 2166136261, dtype=np.uint32)
    for column in rows.T:
        length = sizes[column]
        for i in range(int(length.max(initial=0))):
            h = np.where(i < length, (h ^ padded[column, i]) * np.uint32(16777619), h)
    return h.astype(np.int64)


def winnowed(h: np.ndarray, last: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Places that winnow() takes in many texts at once; first and last are the ends of the text of each hash."""
    n = len(h)
    at = np.arange(n)
    # the place from the end under the hash: of equal hashes the rightmost is the least
    key = h << np.int64(31) | n - 1 - at
    whole = np.flatnonzero(at + window - 1 <= last)
    least = key[whole]
    for d in range(1, window):
        np.minimum(least, key[whole + d], out=least)
    short = np.flatnonzero((at == first) & (at + window - 1 > last))
    rest = key[short]
    for d in range(1, window):
        inside = short + d <= last[short]
        rest[inside] = np.minimum(rest[inside], key[short[inside] + d])
    taken = np.zeros(n, dtype=bool)
    for found in (least, rest):
        taken[n - 1 - (found & 0x7FFFFFFF)] = True
    return np.flatnonzero(taken)


def _plain_numbers() -> dict[str, int]:
    """One byte for each kind of a normalised token of the search engine, the same in every process."""
    words = sorted({w for known in KEYWORDS["search"].values() for w in known})
    marks = [*"=> === !== == != <= >= && || ++ -- += -= *= /= ** // := ...".split(), *"{}()[];,.:?=<>+-*/%&|!^~"]
    return {kind: n for n, kind in enumerate(dict.fromkeys(["", "ID", "LIT", *("kw:" + w for w in words), *marks]))}


PLAIN = _plain_numbers()


class HashSets:
    """Distinct winnowed hashes of normalised texts, many texts at once: few grams of kinds differ, and each is hashed once."""

    ROOM = 1 << 20

    def __init__(self, profile: C.Profile, engine: str = "pipeline"):
        self.profile, self.engine = profile, engine
        self.numbers: dict[str, int] = {"": 0}
        self.codes: dict[str | None, _Codes] = {}
        self.known = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _hashed(self, grams: np.ndarray) -> np.ndarray:
        """The hashes of packed grams; what has been hashed before is looked up."""
        one, back = np.unique(grams, return_inverse=True)
        names, hashes = self.known
        at = np.searchsorted(names, one)
        new = np.ones(len(one), dtype=bool)
        inside = at < len(names)
        new[inside] = names[at[inside]] != one[inside]
        out = np.empty(len(one), dtype=np.int64)
        out[~new] = hashes[at[~new]]
        if new.any():
            rows = np.stack([one[new] >> np.int64(8 * i) & 255 for i in range(self.profile.k)], axis=1)
            out[new] = fnv_rows(list(self.numbers), rows)
            if len(names) < self.ROOM:
                names, hashes = np.concatenate([names, one[new]]), np.concatenate([hashes, out[new]])
                order = np.argsort(names)
                self.known = names[order], hashes[order]
        return out[back]

    def __call__(self, texts: list[str | None], languages: list[str | None]) -> list[np.ndarray]:
        """A sorted array for each text; an empty one for null."""
        k, out = self.profile.k, [np.zeros(0, dtype=np.int64)] * len(texts)
        files = []
        for i, (text, language) in enumerate(zip(texts, languages)):
            if text is None:
                continue
            codes = self.codes.get(language)
            if codes is None:
                codes = self.codes[language] = _Codes(self.engine, language, self.numbers)
            flavour = "any" if self.engine == "pipeline" else "python" if language == "python" else "script"
            found = np.array([codes[w] for w in _FLAT[self.engine, flavour].findall(text)], dtype=np.int64)
            found = found[found > 0]
            if len(found) >= k:
                files.append((i, found))
        assert len(self.numbers) <= 256 and k <= 7
        if not files:
            return out
        sizes = np.array([len(f) for _, f in files])
        flat, ends = np.concatenate([f for _, f in files]), np.cumsum(sizes)
        grams = np.zeros(len(flat) - k + 1, dtype=np.int64)
        for i in range(k):
            grams |= flat[i : len(grams) + i] << np.int64(8 * i)
        # no gram reaches over the end of a file
        whole = np.ones(len(flat), dtype=bool)
        for i in range(1, k):
            whole[ends - i] = False
        h = self._hashed(grams[whole[: len(grams)]])
        counts = sizes - k + 1
        last = np.cumsum(counts) - 1
        chosen = winnowed(h, np.repeat(last, counts), np.repeat(last - counts + 1, counts), self.profile.window)
        owner = np.repeat(np.arange(len(files)), counts)[chosen]
        pairs = np.unique(owner << np.int64(32) | h[chosen])
        parts = np.split(pairs & 0xFFFFFFFF, np.searchsorted(pairs >> np.int64(32), np.arange(1, len(files))))
        for (i, _), part in zip(files, parts):
            out[i] = part
        return out


def units_of(kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code units of kinds as one text, each kind followed by U+0001, and how many each has."""
    units = np.frombuffer("".join([x + "\x01" for x in kinds]).encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint32)
    sizes = np.array([len(x) + 1 for x in kinds], dtype=np.int64)
    if sizes.sum() < len(units):  # characters of two code units
        sizes = np.array([len(x.encode("utf-16-le", "surrogatepass")) // 2 + 1 for x in kinds], dtype=np.int64)
    return units, sizes


def spelled_hashes(units: np.ndarray, sizes: np.ndarray, codes: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """FNV-1a of the runs of k numbers of kinds that begin at the places given; units and sizes are those of the kinds."""
    lengths, at = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
    ends = np.cumsum(lengths)
    # the chunk as one text: the units of each token after those of the token before
    flat = units[np.repeat(at - (ends - lengths), lengths) + np.arange(ends[-1])]
    first, sizes = (ends - lengths)[begins], (ends[begins + k - 1] - (ends - lengths)[begins])
    order = np.argsort(-sizes, kind="stable")
    h, position = np.full(len(begins), 2166136261, dtype=np.uint32), first[order]
    alive = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    for n in alive.tolist():
        rest = h[:n]
        rest ^= flat.take(position[:n])
        rest *= np.uint32(16777619)
        position[:n] += 1
    out = np.empty(len(begins), dtype=np.int64)
    out[order] = h
    return out


class SearchPrints(HashSets):
    """Winnowed hashes of many sources in both representations, each with its first and last place, by file or by region."""

    KINDS = 1 << 17

    def __init__(self, profile: C.Profile):
        super().__init__(profile, "search")
        self.numbers = dict(PLAIN)
        self._forget()

    def _forget(self) -> None:
        self.spelled: dict[str, int] = {}
        self.kinds: list[str] = []
        self.words: dict[str | None, _Codes] = {}
        self.units, self.sizes, self.plain_of = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        self.spelled[""] = 0

    def _learn(self) -> None:
        """Takes up the kinds that were new in these texts."""
        new = list(itertools.islice(self.spelled, len(self.kinds), None))
        units, sizes = units_of(new)
        self.kinds += new
        self.units, self.sizes = np.concatenate([self.units, units]), np.concatenate([self.sizes, sizes])
        self.plain_of = np.concatenate([self.plain_of, np.array([self.numbers[x] for x in normal_kinds(new)], dtype=np.uint8)])

    def __call__(self, texts: list[str], languages: list[str | None], cuts=lambda n: [(0, n)]) -> list[tuple[str, list[tuple[int, int]], list[list[tuple]]]]:
        """For each text its shape, the cuts of its tokens, and for each cut the (hashes, first, last) of both representations; `plain` then has the normalised tokens of each text, a byte each."""
        k = self.profile.k
        if len(self.spelled) > self.KINDS:
            self._forget()
        found = []
        for text, language in zip(texts, languages):
            if language not in self.words:
                self.words[language] = _Codes("search", language, self.spelled, spelled=True)
                self.words[language].ROOM = self.KINDS
            codes = self.words[language]
            c = np.array([codes[w] for w in _FLAT["search", "python" if language == "python" else "script"].findall(text)], dtype=np.int64)
            found.append(c[c > 0])
        self._learn()
        shapes = [hashlib.sha256("\x01".join(map(self.kinds.__getitem__, c.tolist())).encode("utf-8", "surrogatepass")).hexdigest() for c in found]
        assert k <= 7
        self.plain = [self.plain_of[c].tobytes() for c in found]
        pieces = [cuts(len(c)) if len(c) else [] for c in found]
        flat = np.concatenate(found)
        starts = np.cumsum([len(c) for c in found]) - np.array([len(c) for c in found])
        # one hash for each place where k kinds of one file begin; regions share them
        inside = [(int(at), len(c) - k + 1) for at, c in zip(starts, found) if len(c) >= k]
        empty = (np.zeros(0, dtype=np.int64),) * 3
        cut_of = [(i, n) for i, p in enumerate(pieces) for n, (a, b) in enumerate(p) if b - a >= k]
        out = [(shape, p, [[empty, empty] for _ in p]) for shape, p in zip(shapes, pieces)]
        if not inside:
            return out
        begins = np.concatenate([np.arange(at, at + n) for at, n in inside])
        where = np.full(len(flat), -1)
        where[begins] = np.arange(len(begins))
        plain, grams = self.plain_of[flat].astype(np.int64), np.zeros(len(begins), dtype=np.int64)
        for i in range(k):
            grams |= plain[begins + i] << np.int64(8 * i)
        counts = np.array([pieces[i][n][1] - pieces[i][n][0] - k + 1 for i, n in cut_of])
        origin = np.array([starts[i] + pieces[i][n][0] for i, n in cut_of])
        last = np.cumsum(counts) - 1
        place = np.arange(counts.sum()) - np.repeat(last - counts + 1, counts)
        source, owner = where[np.repeat(origin, counts) + place], np.repeat(np.arange(len(cut_of)), counts)
        ends = np.repeat(last, counts), np.repeat(last - counts + 1, counts)
        for r, hashes in enumerate((spelled_hashes(self.units, self.sizes, flat, begins, k), self._hashed(grams))):
            h = hashes[source]
            chosen = winnowed(h, *ends, self.profile.window)
            key = owner[chosen] << np.int64(32) | h[chosen]
            order = np.argsort(key, kind="stable")
            key, at = key[order], place[chosen][order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            columns = key[new] & 0xFFFFFFFF, at[new], at[np.concatenate([new[1:], [len(key)]]) - 1]
            borders = np.searchsorted(key[new] >> np.int64(32), np.arange(1, len(cut_of)))
            for (i, n), *parts in zip(cut_of, *(np.split(c, borders) for c in columns)):
                out[i][2][n][r] = tuple(parts)
        return out


class Overlaps:
    """Sizes of the intersections of a set of hashes with each of many sorted sets.

    The hashes that most sets hold stand in words of bits, the others in postings that are counted.
    """

    WORDS = 6

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        flat, owner = (np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        names, begins, counts = np.unique(flat[order], return_index=True, return_counts=True)
        owners = np.split(owner[order], begins[1:])
        hot = np.argsort(-counts, kind="stable")[: 64 * self.WORDS]
        self.bits = np.zeros((self.WORDS, len(sets)), dtype=np.uint64)
        self.place: dict[int, int] = {}
        for i, j in enumerate(hot.tolist()):
            self.bits[i // 64, owners[j]] |= np.uint64(1 << i % 64)
            self.place[int(names[j])] = i
        self.postings = {h: at for h, at in zip(names.tolist(), owners) if h not in self.place}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        words, met = [0] * self.WORDS, []
        for h in hashes.tolist():
            i = self.place.get(h)
            if i is not None:
                words[i // 64] |= 1 << i % 64
            elif h in self.postings:
                met.append(self.postings[h])
        n = np.bincount(np.concatenate(met), minlength=len(self.sizes)) if met else np.zeros(len(self.sizes), dtype=np.int64)
        for row, word in zip(self.bits, words):
            if word:
                n += np.bitwise_count(row & np.uint64(word))
        return n


def _codes(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    ids: dict[str, int] = {}
    return [ids.setdefault(x, len(ids)) for x in a], [ids.setdefault(x, len(ids)) for x in b]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel over arbitrary integers)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def longest_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Longest common contiguous run: length, start in a, start in b; the first in a, then in b, on ties.

    The equality matrix is skewed so that its diagonals become rows; runs of ones in it are common runs. Long inputs
    are taken row by row.
    """
    if not a or not b:
        return 0, 0, 0
    x, y = (np.array(c, dtype=np.int64) for c in _codes(a, b))
    m, n = len(x), len(y)
    if m * n > 1 << 24:
        return _longest_run_by_rows(x, y)
    # one row for each diagonal, closed by a zero
    skewed = np.zeros((m + n - 1, m + 1), dtype=np.int8)
    skewed[:, :m] = _diagonals(x[:, None] == y[None, :])
    edges = np.diff(np.concatenate([[0], skewed.ravel(), [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return 0, 0, 0
    lengths = ends - starts
    top = int(lengths.max())
    best = starts[lengths == top]
    diagonal, i = best // (m + 1), best % (m + 1)
    j = diagonal - (m - 1) + i
    first = np.lexsort((j, i))[0]
    return top, int(i[first]), int(j[first])


def _diagonals(equal: np.ndarray) -> np.ndarray:
    """(m + n - 1, m): row d, column i holds equal[i, d - (m - 1) + i], zero outside."""
    m, n = equal.shape
    wide = np.zeros((m, 2 * (m - 1) + n), dtype=np.int8)
    wide[:, m - 1 : m - 1 + n] = equal
    row, cell = wide.strides
    return np.lib.stride_tricks.as_strided(wide, shape=(m + n - 1, m), strides=(cell, row + cell))


def common_many(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For many pairs of plain() texts at once: the length of the longest common run, and of the longest common subsequence."""
    runs, matched = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
    sizes = np.array([len(x) for x in right], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # as many pairs as fit the cache, of nearly one length
        n = int(sizes[order[at]])
        many = max(1, min(1024, (1 << 17) // max(1, n)))
        part = order[at : at + many]
        part = part[sizes[part] <= n + n // 4 + 16]
        at += len(part)
        a, b = [left[i] for i in part.tolist()], [right[i] for i in part.tolist()]
        x, y = _padded(a, 255), _padded(b, 254)
        runs[part] = _runs(x, y)
        matched[part] = _subsequences(x, y) if len(part) >= 24 else [lcs_length(p, q) for p, q in zip(a, b)]
    return runs, matched


def _padded(texts: list[bytes], fill: int) -> np.ndarray:
    widest = max(1, *map(len, texts)) if texts else 1
    return np.frombuffer(b"".join([t.ljust(widest, bytes([fill])) for t in texts]), dtype=np.uint8).reshape(len(texts), widest)


def _runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[1] > y.shape[1]:
        x, y = y, x
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    kind = np.uint8 if len(x) < 256 else np.int32
    now, best, more, equal = np.zeros((len(y) + 1, y.shape[1]), dtype=kind), np.zeros(y.shape, dtype=kind), np.empty(y.shape, dtype=kind), np.empty(y.shape, dtype=bool)
    for row in x:
        # the diagonal before, where the next tokens are equal
        np.add(now[:-1], kind(1), out=more)
        np.equal(y, row, out=equal)
        np.multiply(more, equal.view(np.uint8), out=now[1:])
        np.maximum(best, now[1:], out=best)
    return best.max(axis=0).astype(np.int64)


def _subsequences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bit-parallel as lcs_length(), a column of words of 64 bits for each pair."""
    n, words = len(x), -(-x.shape[1] // 64)
    every, masks = np.arange(n), np.zeros((words, 256, n), dtype=np.uint64)
    for i in range(x.shape[1]):
        masks[i // 64, x[:, i], every] |= np.uint64(1 << i % 64)
    masks, places = masks.reshape(words, -1), y.T.astype(np.int64) * n + every
    row = np.full((words, n), ~np.uint64(0))
    for at in places:
        met = masks.take(at, axis=1)
        hit = row & met
        total = row + hit
        over = total < hit
        for w in range(1, words):
            total[w] += over[w - 1]
            over[w] |= total[w] < over[w - 1]
        row &= ~met
        row |= total
    # of the words all bits past the end of a text stay
    return np.bitwise_count(~row).sum(axis=0).astype(np.int64)


def _longest_run_by_rows(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """The same with two rows of memory, for long inputs."""
    best, at = 0, (0, 0)
    previous = np.zeros(len(y) + 1, dtype=np.int64)
    for i in range(len(x)):
        current = np.zeros(len(y) + 1, dtype=np.int64)
        hit = np.flatnonzero(y == x[i])
        current[hit + 1] = previous[hit] + 1
        if len(hit) and (top := int(current.max())) > best:
            best = top
            at = (i - top + 1, int(np.argmax(current)) - top)
        previous = current
    return best, at[0], at[1]


def merge_ranges(ranges: list[tuple[int, int]], gap: int = 1) -> list[tuple[int, int]]:
    """Sorted inclusive ranges; those at most gap lines apart become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1] + gap + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def region_starts(n: int, size: int, stride: int) -> list[int]:
    """Starts of the token regions of a file: strided, the last pinned to the end."""
    if n <= size:
        return [0]
    return [*range(0, n - size, stride), n - size]
