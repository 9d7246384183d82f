"""Small tables with everything that may be odd: nulls, empty and very long texts, ties, repeated rows,
copies, near copies, shared passages, and extra columns whose names clash with internal ones."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slice string, row string, key long, ids string, rep long, text_margin string"
WORDS = "the of and river old mill town über große straße que para años été là mais und nicht zu ein house 12 7 % # talk".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", str(r.randrange(1000))]) for _ in range(n))


def rows(seed=1, n=40):
    r = random.Random(seed)
    passage = prose(r, 70)
    out = []
    for i in range(n):
        kind = r.randrange(7)
        text = prose(r, r.choice([1, 2, 3, 12, 13, 40, 150]))
        if kind == 1 and out:
            text = r.choice(out)[1]
        elif kind == 2 and out:
            words = (r.choice(out)[1] or "").split(" ")
            words[r.randrange(len(words))] = "CHANGED"
            text = " ".join(words)
        elif kind == 3:
            text = text + "\n" + passage + "\t" + prose(r, 5)
        elif kind == 4:
            text = (text + "\n") * 3
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t \x0b"), (1003, "A."), (1004, " x y z"), (1005, prose(r, 4000)), (1006, "and " * 3000), (1007, "x" * 30000), (out[3][0], out[3][1]), (out[4][0], "another text of the same id " + prose(r, 30)), (None, out[5][1]), (None, None), (2**40, "😀 " * 40 + passage)]
    r.shuffle(out)
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s", None]), None if t is None else len(t), 1, "x", "y", 2, "z", 3, "w") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
