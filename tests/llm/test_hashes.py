"""Hashes of words and spans: Thue-Morse texts, which collide for every base modulo a power of two, are told apart."""

import random

import numpy as np
import pytest

from taskloom.llm import common, jaccard, lines, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def other(letters):
    return ["b" if x == "a" else "a" for x in letters]


def test_products_modulo_the_prime():
    rng = random.Random(1)
    a = [rng.randrange(int(common.PRIME)) for _ in range(2000)] + [0, 1, int(common.PRIME) - 1]
    b = a[::-1]
    got = common.times(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % int(common.PRIME) for x, y in zip(a, b, strict=True)]


def test_equal_spans_and_no_others():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\0") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = np.r_[0, end[:-1]]
    for base in (0, 1):
        found = common.word_hashes(data, start, end, base).tolist()
        assert len(set(found)) == len(set(texts)) and len({(t, h) for t, h in zip(texts, found, strict=True)}) == len(set(texts))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_modulo_powers_of_two(spark, n):
    one, two = "".join(thue_morse(n)), "".join(other(thue_morse(n)))
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {rest}", "en", "s", 1), (2, f"{two} {rest}", "en", "s", 1)], DOCS)
    assert [r.n_removed for r in substring.deduplicated(df).collect()] == [0, 0]
    assert [r.component_id for r in jaccard.similar(spark.createDataFrame([(1, one, "en", "s", 1), (2, two, "en", "s", 1)], DOCS)).orderBy("doc_id").collect()] == [1, 2]
    same = spark.createDataFrame([(1, f"{one} x y", "en", "s", 1), (2, f"{two} x y", "en", "s", 1)], DOCS)
    assert {r.text for r in lines.without_repeats(same).collect()} == {f"{one} x y", f"{two} x y"}


def test_sequences_of_words_that_collide_modulo_powers_of_two(spark):
    one, two = " ".join(thue_morse(2048)), " ".join(other(thue_morse(2048)))
    df = spark.createDataFrame([(1, one, "en", "s", 1), (2, two, "en", "s", 1)], DOCS)
    assert {r.text for r in lines.without_repeats(df).collect()} == {one, two}
    assert [r.component_id for r in jaccard.similar(df, size=4000).orderBy("doc_id").collect()] == [1, 2]
