import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill import constants as C
from tracemill import kernels as K


def test_fnv_of_known_texts():
    assert K.fnv1a("") == 2166136261
    assert K.fnv1a("a") == ((2166136261 ^ 97) * 16777619) & 0xFFFFFFFF


def test_winnow_takes_the_rightmost_least():
    assert K.winnow([9, 2, 7, 1, 8, 3, 6], 3) == [(2, 1), (1, 3), (3, 5)]
    assert K.winnow([5, 5, 5], 3) == [(5, 2)]
    assert K.winnow([4, 2], 8) == [(2, 1)]
    assert K.winnow([], 4) == []


@given(st.lists(st.text("abé😀", max_size=6), max_size=20), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_shingles_equal_the_plain_definition(kinds, k):
    plain = [K.fnv1a("".join(x + "\x01" for x in kinds[i : i + k])) for i in range(len(kinds) - k + 1)]
    assert K.shingle_hashes(kinds, k) == plain


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
@settings(max_examples=150, deadline=None)
def test_sequence_comparison_equals_brute_force(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    assert K.lcs_length(a, b) == table[-1][-1]
    assert K.longest_run(a, b) == best


def test_lexers_drop_comments_and_keep_lines():
    kinds, lines = K.lex("// note\nconst a = 'x';\n/* b\n c */ f(a)", "javascript", lines=True)
    assert kinds == ["kw:const", "id:a", "=", "lit:'x'", ";", "id:f", "(", "id:a", ")"]
    assert lines == [2, 2, 2, 2, 2, 4, 4, 4, 4]
    assert K.lex("x = 1 # c", "python", normalised=True)[0] == ["ID", "=", "LIT"]
    # in the one-lexer engine a floor division eats the rest of its line
    assert K.lex("a = b // c", "python", "pipeline")[0] == ["ID", "=", "ID"]


def test_renaming_changes_only_the_preserving_form():
    a, b = "function f(x) { return x + 1; }", "function g(y) { return y + 1; }"
    assert K.lex(a, "javascript")[0] != K.lex(b, "javascript")[0]
    assert K.lex(a, "javascript", normalised=True)[0] == K.lex(b, "javascript", normalised=True)[0]


def test_long_literals_do_not_break_the_lexer():
    assert len(K.lex("x = '" + "a" * 200_000 + "'", "python")[0]) == 3


def test_regions_pin_the_last_window():
    assert K.region_starts(100, 120, 60) == [0]
    assert K.region_starts(300, 120, 60) == [0, 60, 120, 180]
    assert K.region_starts(310, 120, 60) == [0, 60, 120, 180, 190]


def test_ranges_merge_with_a_gap():
    assert K.merge_ranges([(8, 9), (1, 3), (3, 5), (6, 6)], 1) == [(1, 9)]
    assert K.merge_ranges([(1, 2), (10, 12)], 1) == [(1, 2), (10, 12)]


def test_winnowing_density():
    random.seed(1)
    prints = K.winnow([random.getrandbits(32) for _ in range(4000)], C.SOURCE_SEARCH.window)
    gaps = [b[1] - a[1] for a, b in zip(prints, prints[1:])]
    assert max(gaps) <= C.SOURCE_SEARCH.window


@given(st.lists(st.tuples(st.sampled_from(["let a = 1; ", "f(x) ", "def g(y): ", "# c\n", "// c\n", "'s' ", "`t` ", "return 1 ", "/* c */", "\"open", "1a ", "$b ", "é "]), st.integers(1, 5)), max_size=12), st.sampled_from(["python", "javascript", "typescript", None]))
@settings(max_examples=150, deadline=None)
def test_hash_sets_of_many_texts_equal_those_of_one(parts, language):
    text = "".join(p * n for p, n in parts)
    texts = [text, None, "", text[: len(text) // 2], "a b c d e", text + text]
    plain = [sorted({h for h, _ in K.fingerprints(K.lex(t or "", language, "pipeline")[0], C.PIPELINE)}) for t in texts]
    sets = K.HashSets(C.PIPELINE)
    assert [x.tolist() for x in sets(texts, [language] * len(texts))] == plain == [x.tolist() for x in sets(texts, [language] * len(texts))]


def test_overlaps_equal_intersections():
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(40), 12)) + sorted(rng.sample(range(100, 2000), rng.randrange(30))) for _ in range(200)] + [[]]
    count = K.Overlaps([np.array(x, dtype=np.int64) for x in sets])
    for asked in ([], [5], [*range(20), *range(500, 900)], [10**6], sets[3]):
        assert count(np.array(asked, dtype=np.int64)).tolist() == [len(set(asked) & set(x)) for x in sets]


@given(st.lists(st.tuples(st.sampled_from(["let a = 1; ", "f(x) ", "def g(y): ", "# c\n", "#p = 2 ", "// c\n", "a // b ", "'s😀' ", "`t` ", "'''d\n''' ", "return 1 ", "/* c */", '"open', "1a ", "$b ", "é "]), st.integers(1, 9)), max_size=12), st.sampled_from(["python", "javascript", "typescript", None]))
@settings(max_examples=120, deadline=None)
def test_prints_of_many_sources_equal_those_of_one(parts, language):
    text = "".join(p * n for p, n in parts)
    texts = [text, "", text[: len(text) // 2], text + text]
    for cuts in (lambda n: [(0, n)], lambda n: [(a, min(n, a + 20)) for a in K.region_starts(n, 20, 7)]):
        for source, (shape, pieces, found) in zip(texts, K.SearchPrints(C.SOURCE_SEARCH)(texts, [language] * len(texts), cuts)):
            kept, _ = K.lex(source, language)
            assert shape == hashlib.sha256("\x01".join(kept).encode()).hexdigest() and list(pieces) == (cuts(len(kept)) if kept else [])
            for (a, b), both in zip(pieces, found):
                for kinds, columns in zip((kept, K.normal_kinds(kept)), both):
                    want = {}
                    for h, p in K.fingerprints(kinds[a:b], C.SOURCE_SEARCH):
                        want.setdefault(h, [p, p])[1] = p
                    assert {h: [f, e] for h, f, e in zip(*(c.tolist() for c in columns))} == want


def test_many_pairs_are_compared_at_once():
    rng = random.Random(8)
    some = lambda n: bytes(rng.randrange(rng.choice((2, 9, 40))) for _ in range(n))
    left = [some(rng.choice((0, 1, 63, 64, 65, 120))) for _ in range(300)]
    right = [some(rng.choice((0, 7, 127, 127, 400))) for _ in range(300)]
    right = [y[:50] + x[10:100] + y[50:] if i % 4 == 0 else y for i, (x, y) in enumerate(zip(left, right))]
    runs, matched = K.common_many(left, right)
    assert runs.tolist() == [K.longest_run(list(x), list(y))[0] for x, y in zip(left, right)]
    assert matched.tolist() == [K.lcs_length(list(x), list(y)) for x, y in zip(left, right)]


def test_every_normalised_kind_has_its_byte():
    text = "async function $a(b, c = 1) { return `x` === '\\u1234' && b?.#d !== c ** 2 ... || c++ - --b; } /* z */ // y\n# q\nx := y // 2\n\"s\" @ é <= ~z >= [1.5] += 1 -= 2 *= 3 /= 4 => ^!%|&:"
    for language in ("javascript", "typescript", "python", None):
        prints = K.SearchPrints(C.SOURCE_SEARCH)
        prints([text, ""], [language, language])
        kinds = list(K.PLAIN)
        assert [kinds[b] for b in prints.plain[0]] == K.lex(text, language, normalised=True)[0] and prints.plain[1] == b""
