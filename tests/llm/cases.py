"""Small documents with every awkward case, and helpers shared by the tests."""

from __future__ import annotations

import random

LONG_WORDS = 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, part long, tag long, id long"


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = [a + b for a in "ka lo mi su te ra".split() for b in "ndo rel vit pas mun".split()]

    def some(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))

    base = some(120)
    passage = some(30)
    near = base.split()
    near[60] = "changed"
    out = [base, base, base.upper(), " ".join(near), None, "", "   \n\t ", "one", "One two", passage, some(40) + " " + passage + "\n" + some(40),
           passage + "  " + some(20), "na " * 400, some(LONG_WORDS), "é ü ñ  x y 日本語 テキスト", "All rights reserved. Licensed under CC BY 4.0, all RIGHTS reserved",
           "GNU general public-license version 3", "a\x00b c\x1fd", base + " tail", "x" * 5000]
    return out + [some(rng.randint(1, 60)) for _ in range(30)]


def rows(texts_=None) -> list[tuple]:
    out = []
    for i, t in enumerate(texts_ if texts_ is not None else texts()):
        out.append((i * 3 % 101 if i != 7 else None, t, [None, "en", "de"][i % 3], [None, "a", "b", "hot", "hot"][i % 5], None if t is None else len(t), 0.5, True, 1, 2, 3))
    out.append(out[0])  # a row repeated in full
    out.append((out[3][0], "another text under a known id", None, "a", 3, None, None, None, None, None))
    return out


def documents(spark, texts_=None):
    return spark.createDataFrame(rows(texts_), SCHEMA).repartition(5)


def labels(spark, n: int = 200):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode("utf-8")
    return (data.lower() if lower else data).split()
