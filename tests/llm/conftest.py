import random

import pytest

#: Columns whose names clash with those that the operators make or use inside.
CLASH = "n_words long, row_key long, unit long, length long, kept boolean, n_removed long, cls long"


def words(rnd, n, vocabulary="the of and to in is was for on with as at by an be this that from or had".split()):
    return [rnd.choice(vocabulary) + rnd.choice(["", "", "", "ing", "ly", str(rnd.randint(0, 40))]) for _ in range(n)]


def corpus():
    rnd = random.Random(7)
    passage = " ".join(words(rnd, 45))
    bench = " ".join(words(rnd, 30))
    rows = []
    for i in range(60):
        w = words(rnd, rnd.choice([0, 1, 4, 12, 19, 20, 25, 60, 150, 300]))
        text = " ".join(w)
        if i % 4 == 0:
            text = text + "\n" + passage + "\t" + " ".join(words(rnd, 8))
        if i % 9 == 0:
            text = text.upper() + " " + bench.title().replace(" ", ", ")
        rows.append((i, text))
    base = words(rnd, 200)
    for i in range(60, 75):  # near copies
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(200)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(75, None), (76, ""), (77, " \n\t "), (78, rows[10][1]), (79, rows[10][1]), (79, rows[10][1]), (None, passage), (80, "a " * 400), (81, "Ünïcode ßtraße 漢字 🙂 " * 9), (82, "x\n" * 30)]
    rows.append((83, " ".join(words(rnd, 60_000))))  # a very long text
    rows.append((84, "All rights reserved. Licensed under CC BY-NC 4.0. cc by cc by\nGNU General Public License version 3"))
    return rows, passage, bench


@pytest.fixture(scope="session")
def rows():
    return corpus()[0]


@pytest.fixture(scope="session")
def bench_rows():
    _, passage, bench = corpus()
    return [(1, bench), (2, "short item here"), (3, None), (None, passage), (5, ""), (10, bench + " with more words behind it"), (2, "short item here")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), -1, -2, -3, -4, None, -5, -6) for d, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)
