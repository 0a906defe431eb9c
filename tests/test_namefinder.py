"""Names inside texts, against a search of every name in every text."""

import random
import time

from marginalia.operators.namefinder import names_in


def pairs(spark, texts, names, **options):
    df = names_in(
        spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "n string"), "t", "n", **options
    )
    return sorted(map(tuple, df.collect()))


def test_same_as_every_name_in_every_text(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(rng.randrange(n)))
    texts = [word(14) for _ in range(300)] + [None, "", "abc", "abc"]
    names = [word(4) for _ in range(60)] + [None, "", "abc", "bc", "bc"]
    want = sorted({(t, n) for t in texts for n in names if t and n and n in t})
    assert pairs(spark, texts, names) == want
    assert pairs(spark, texts, names, shard_bytes=20, block_rows=40) == want
    assert pairs(spark, texts, [None, ""]) == [] == pairs(spark, [], names)


def test_a_very_long_word_is_read_once(spark):
    long = "abcdefghij" * 100_000
    start = time.time()
    assert pairs(spark, [long], ["cde", "ija", "zz", "abcdefghij"]) == [(long, n) for n in ("abcdefghij", "cde", "ija")]
    assert time.time() - start < 20
