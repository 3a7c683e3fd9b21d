import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "words string, __row long, a binary, score string, `set` int, key string"
)


def vocabulary(n=400):
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnopéñü") for _ in range(r.randint(2, 9))) for _ in range(n)]


def texts():
    """Prose, copies, near copies, shared passages, junk, empty and long texts."""
    r, v = random.Random(11), vocabulary()
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    out = [prose(r.randint(60, 160)) for _ in range(30)]
    out += [out[3], out[3], out[4] + " " + prose(2)]
    near = out[5].split()
    near[40] = "changed"
    out.append(" ".join(near))
    passage = prose(70)
    out += [f"{prose(20)}\n{passage}\t{prose(30)}" for _ in range(4)]
    out += [f"{prose(9)} {' '.join(passage.split()[9:62])} {prose(8)}"]
    out += [None, "", "   \n\t ", "one", "one two three", "one two three", "x" * 30000, prose(6000)]
    out += ["same line here\nsame line here\n\nother", "word " * 400, "\n".join([prose(12)] * 9), "# $ % & | < > *" * 20]
    return out


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None, "c"][i % 4], None, "x", i, b"z", "s", 1, "k") for i, t in enumerate(texts())]
    rows.append((None, "a text without an id " * 5, "en", "a", 3, None, None, None, None, None, None))
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def plain(docs):
    """(doc_id, text or '') of every row."""
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
