"""Learned merges against a plain version that counts every pair anew in each round."""

import random
from collections import Counter

from qlift.operators import subwords as SW


def brute(texts, k):
    words = {}
    for w, n in Counter(w for t in texts for w in (t or "").lower().split()).items():
        words[w] = (list(w) + ["</w>"], n)
    out = []
    for rank in range(1, k + 1):
        count = Counter()
        for s, n in words.values():
            for p in zip(s, s[1:]):
                count[p] += n
        if not count:
            break
        (a, b), n = min(count.items(), key=lambda x: (-x[1], x[0][0].encode(), x[0][1].encode()))
        out.append((rank, a, b, n))
        for w, (s, m) in words.items():
            new, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                    new.append(a + b)
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            words[w] = (new, m)
    return out


def check(spark, texts, k):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tuple(r) for r in SW.learn_merges(df, "text", k).orderBy("rank").collect()] == brute(texts, k)


def test_equals_plain_version(spark):
    rng = random.Random(2)
    syllables = ["la", "na", "aaa", "aa", "é", "日", "x.y", "$1", "\\d", "(", "😀😀"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(20)) for _ in range(15)]
    check(spark, [*texts, None, "", "aaaa aaaaa", "  "], 14)


def test_stops_when_every_word_is_one_symbol(spark):
    check(spark, ["ab ab b"], 10)
    check(spark, [None, " "], 3)


def test_pair_counts_stay_those_of_the_words(spark):
    """After some rounds the kept counts are what counting anew gives (the last merge's n shows it)."""
    check(spark, ["low low low lower lowest newer newer wider " * 7], 9)
