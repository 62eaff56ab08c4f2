import random
import re
import zlib
from collections import Counter

import odd
import pytest
from slicewise.llm.spelling import near_pairs, spelling_variants, word_occurrences

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, drop_every=None, least=5, dominance=5):
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= least}
    others = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= dominance * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def noisy(seed: int, n: int) -> list[tuple]:
    """Texts of few words, a share of them with an edit or two at any place, and some with equal counts."""
    rng = random.Random(seed)
    base = ["straße" + "wagen", "colour", "colouring", "abcdef", "bacdef", "élèves", "ÉLÈVES", "aaaaaa", "aaaaaaa", "zzzzzzz", "abcabcabc"]
    texts = []
    for i in range(n):
        out = []
        for _ in range(60):
            word = base[min(int(rng.expovariate(0.4)), len(base) - 1)]
            while rng.random() < 0.35:
                at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
                word = word[:at] + (rng.choice("aeé") if kind else "") + word[at + (kind != 1) :]
            out.append(rng.choice([word, word, word.upper(), word.capitalize()]))
        texts.append((i if i % 7 else None, rng.choice([" ", "-", "1", "_"]).join(out)))
    return texts


@pytest.mark.parametrize(("drop_every", "dominance"), [(None, 5), (7, 2), (199, 3)])
def test_against_brute_force(spark, drop_every, dominance):
    """Insertions, deletions and replacements at both ends and in the middle, chains of forms, ties."""
    texts = noisy(drop_every or 1, 60)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = brute(texts, drop_every, dominance=dominance)
    assert rows(spelling_variants(word_occurrences(df, drop_every=drop_every), dominance=dominance)) == want
    assert any(r[1] for r in want)


def test_every_edit_of_a_word(spark):
    """All one-edit neighbours of words of even and odd length, also where letters repeat: none is missed, none found twice."""
    words = set()
    for base in ("abcdef", "aabbaab", "ÿèaaaaaa"):
        words |= {base} | {base[:i] + base[i + 1 :] for i in range(len(base))}
        for c in LETTERS[::9] + base[0]:
            words |= {base[:i] + c + base[i:] for i in range(len(base) + 1)} | {base[:i] + c + base[i + 1 :] for i in range(len(base))}
    words = sorted(w for w in words if len(w) >= 6)
    got = [frozenset(r) for r in near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    want = {frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns; a null id is written as nothing."""
    assert rows(spelling_variants(word_occurrences(odd.docs(spark), drop_every=3))) == brute([(r[0], r[1]) for r in odd.rows()], 3)


def test_empty(spark):
    out = spelling_variants(word_occurrences(odd.empty(spark)))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    assert spelling_variants(spark.createDataFrame([(None,)] * 9, "word string")).count() == 0
