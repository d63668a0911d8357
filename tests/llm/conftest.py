import random

import pytest

SYLLABLES = {
    "en": "the and ing er on re ha th or es at".split(),
    "fr": "eau ç è ê qui que tion é elle aux des".split(),
    "de": "ung sch ß ü ä ö keit und der ein ver".split(),
}


def word(r: random.Random, lang: str) -> str:
    return "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3)))


def prose(r: random.Random, lang: str, n: int) -> str:
    words = [word(r, lang) for _ in range(n)]
    return "".join(w + ("\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


ODD = [None, "", "   \n ", "one", "a b c d", "#%& 12 34", "x " * 40, "Zu lang " * 6000, "tab\there\x0bthere\x0cend", "😀 é ́     ok"]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source) with copies, near copies, junk, odd texts, a repeated row and nulls."""
    r = random.Random(1)
    out = []
    for i in range(120):
        lang = r.choice(list(SYLLABLES))
        out.append((i, prose(r, lang, r.randint(60, 300)), lang, f"s{i % 7}" if i % 3 else "s0"))
    for i in range(20):
        out.append((200 + i, out[i][1], out[i][2], "s1"))
    for i in range(20, 40):
        words = out[i][1].split(" ")
        words[len(words) // 2] = "edited"
        out.append((300 + i, " ".join(words), out[i][2], "s2"))
    for i in range(15):
        out.append((400 + i, " ".join(w + r.choice(["%%%", "&&&", "***", "$$$"]) for w in prose(r, "en", 120).split()), "en", "s3"))
    out += [(500 + i, t, None if i % 2 else "en", None) for i, t in enumerate(ODD)]
    out += [out[0], (None, "null ids " * 30, "en", "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with what operators add."""
    made = [(*x, len(x[1] or ""), "mine", 7, False) for x in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark, rows):
    made = [(x[0], 0 if x[0] is not None and 400 <= x[0] < 500 else 1, 0) for x in rows if x[0] is None or x[0] % 2 == 0]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")
