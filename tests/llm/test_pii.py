import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from semtag.llm.pii import FEATURES, GENERATORS, KINDS, STEP, Tree, best_split, boost, find_personal_data, luhn, proposals, running_sums, thresholds

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_sum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return 13 <= len(digits) <= 19 and total % 10 == 0


def ok(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    return {"email": True, "card": check_sum(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(k, m[0])] for k, p in PLAIN.items()}


def card(r, n=16):
    digits = "4" + "".join(r.choice("0123456789") for _ in range(n - 2))
    return digits + next(c for c in "0123456789" if check_sum(digits + c))


def corpus(n=400, seed=4):
    r = random.Random(seed)
    words = lambda k: " ".join(r.choice(["über", "the", "net", "😀", "maß", "a-b", "v2", "10", "x.y"]) for _ in range(k))
    rows = []
    for i in range(n):
        parts = [words(12)]
        for _ in range(r.randint(0, 3)):
            number = card(r)
            parts += [
                r.choice(
                    [
                        f"user{i}@mail{i % 9}.example.com",
                        f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
                        number,
                        " ".join(number[j : j + 4] for j in range(0, 16, 4)),
                        f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}",
                        "4000 1234 5678 9999",
                        "version 1.22.333.4444",
                        "1234567890123456",
                        "300.1.2.3",
                    ]
                ),
                words(6),
            ]
        rows.append((i, " ".join(parts)))
    return rows


ODD = [None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x@y", "1.2.3.4.5.6.7.8", "1.2.3", "0000300.1.1.1 000.00001.2.3", "+1-2", "+12 345 678 9", "+49 (30) 1234-5678.", "@" * 50, "1" * 30, "1 " * 40, "4" * 16 + "-4", "a" * 300 + "@b." + "c." * 4000 + "d", "1" * 4_000, "1." * 3_000 + "1", "x" * 4_000, "+" + "(" * 2_000, "tel:+4930123456789;a=b@c.de"]


@pytest.fixture(scope="module")
def got(spark):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(ODD)] + [(0, corpus(1)[0][1]), (None, "me@x.yz")]
    df = spark.createDataFrame([(*x, "mine", 1) for x in rows], "doc_id long, text string, spans string, kind int").repartition(3)
    return rows, find_personal_data(df).collect()


def test_base_equals_plain_patterns(got):
    rows, found = got
    want = sorted((str(d), *map(len, (b := base(t)).values()), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in b[k]).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(x["doc_id"]), *(x[f"n_{k}"] for k in KINDS), x["base_sha256"]) for x in found) == want
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, set()).update(f"{k}:{s}:{e}" for k, v in base(t).items() for s, e in v)
    for x in found:
        spans = x["spans"].split(",") if x["spans"] else []
        assert by_id[x["doc_id"]] <= set(spans) and len(spans) == sum(x[f"n_{k}"] for k in KINDS) + x["n_added"]
        place = [(KINDS.index(k), int(s), int(e)) for k, s, e in (p.split(":") for p in spans)]
        assert place == sorted(place)


def test_what_fails_a_check_is_not_added(got):
    """Numbers that fail the check sum, octets above 255, version numbers: examples against, so the threshold leaves them alone."""
    rows, found = got
    texts = {d: t for d, t in rows if d is not None and d < 1000}
    for x in found:
        if x["doc_id"] in texts:
            for k, s, e in (p.split(":") for p in x["spans"].split(",") if p):
                if (int(s), int(e)) in base(texts[x["doc_id"]])[k]:
                    continue
                cut = texts[x["doc_id"]][int(s) : int(e)]
                assert not re.search("333.4444|^300|1234567890123456|9999$", cut), cut


def test_the_model_adds_what_looks_like_the_base(spark):
    """Cards whose groups are written with dots, after other digits: the base misses them; their check sum, shape and context are the same."""
    r = random.Random(9)
    rows = corpus(1500, seed=8)
    cards = [card(r) for _ in range(3)]
    rows += [(5000 + i, f"the 12 {c} net") for i, c in enumerate(cards)] + [(6000, "the 12 1234567890123456 net"), (6001, f"und {cards[0]} so"), (6002, "nothing 10 x.y here")]
    found = {x["doc_id"]: x for x in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), precision=0.75).collect()}
    assert all(found[5000 + i]["n_card"] == 0 and found[5000 + i]["spans"] == "card:7:23" and found[5000 + i]["n_added"] == 1 for i in range(3))
    assert found[6000]["spans"] == found[6002]["spans"] == "" and found[6001]["spans"] == "card:4:20"


def test_very_long_texts_take_no_recursion_and_no_square(spark):
    n = 60_000
    texts = ["1" * n, "1 " * n, "1." * n, "x" * n, "a@b." + "c." * n + "d", "+" + "(" * n, "+1" * n, " dot " * n + "a at b", "@" * n, "4111 1111 1111 1111 " * (n // 50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert find_personal_data(rows).count() == len(texts)


def test_empty_table_and_no_examples(spark):
    df = spark.createDataFrame([(1, "quiet"), (2, None)], "doc_id long, text string")
    assert find_personal_data(df.where("false")).count() == 0
    assert [(x["spans"], x["n_added"]) for x in find_personal_data(df).collect()] == [("", 0)] * 2


def test_running_sums_and_check_sums(spark):
    n = 3 * STEP + 7
    df = spark.createDataFrame([([*range(k)],) for k in (0, 1, STEP, STEP + 1, n)], "a array<long>").select(running_sums(F.col("a")).alias("s"))
    assert [x["s"] for x in df.collect()] == [[sum(range(i + 1)) for i in range(k)] for k in (0, 1, STEP, STEP + 1, n)]
    r = random.Random(2)
    numbers = ["".join(r.choice("0123456789") for _ in range(r.randint(1, 22))) for _ in range(300)] + [card(r, k) for k in range(13, 20)]
    told = spark.createDataFrame([(x,) for x in numbers], "d string").select("d", luhn(F.col("d")).alias("ok")).collect()
    assert all(x["ok"] == check_sum(x["d"]) for x in told) and sum(x["ok"] for x in told) >= 7


def test_generators_find_written_out_forms(spark):
    texts = ["jane (at) site (dot) org", "jane at site dot org", "look at site.org", "10[.]0[.]0[.]1", "4111.1111.1111.1111", "(344) 555-8704", "030 / 1234 5678"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.explode(proposals(F.col("text"))).alias("p")).select("text", "p.*").collect()
    whole = {(x["text"], KINDS[x["kind"]]) for x in rows if (x["start"], x["end"]) == (0, len(x["text"]))}
    assert whole >= {(texts[0], "email"), (texts[1], "email"), (texts[3], "ip"), (texts[4], "card"), (texts[5], "phone"), (texts[6], "phone")}
    assert not any(x["text"] == texts[2] for x in rows) and {len(x) for x in rows} == {len(FEATURES) + 3} and len(GENERATORS) == 7


def plain_score(tree, row):
    node = 0
    while node in tree.splits:
        name, most = tree.splits[node]
        node = 2 * node + (1 if row[name] <= most else 2)
    return tree.values.get(node, 0.0)


def test_boosting_equals_a_plain_one(spark):
    """The same trees grown row by row in Python."""
    import math

    r = random.Random(3)
    rows = []
    for _ in range(400):
        x = {f: r.randint(0, min(3, most)) for f, most in FEATURES.items()}
        rows.append((x, int(r.random() < (0.9 if x["valid"] and x["marks"] != 2 else 0.1)), r.randint(1, 5)))
    df = spark.createDataFrame([(*x.values(), y, n) for x, y, n in rows], ", ".join(f"{f} int" for f in FEATURES) + ", label int, n long")
    got = [x["s"] for x in df.selectExpr(f"{boost(df, trees=4, depth=2)} as s").collect()]
    pos, neg = (sum(n for _, y, n in rows if y == v) for v in (1, 0))
    score = [math.log(pos / neg)] * len(rows)
    for _ in range(4):
        tree, unit = Tree(), 1 << 20
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [n * round((q - y) * unit) / unit for q, (_, y, n) in zip(p, rows, strict=True)]
        h = [n * round(q * (1 - q) * unit) / unit for q, (_, _, n) in zip(p, rows, strict=True)]
        members = {0: range(len(rows))}
        for _ in range(2):
            below = {}
            for node, own in members.items():
                histogram = {f: {} for f in FEATURES}
                for i in own:
                    for f in FEATURES:
                        a, b = histogram[f].get(rows[i][0][f], (0.0, 0.0))
                        histogram[f][rows[i][0][f]] = (a + g[i], b + h[i])
                if (split := best_split(histogram, 1.0, 1.0)) is not None:
                    tree.splits[node] = split[1:3]
                    for child, (a, b), left in ((2 * node + 1, split[3], True), (2 * node + 2, split[4], False)):
                        tree.values[child] = -0.4 * a / (b + 1.0)
                        below[child] = [i for i in own if (rows[i][0][split[1]] <= split[2]) == left]
            members = below
        score = [s + plain_score(tree, x) for s, (x, _, _) in zip(score, rows, strict=True)]
    assert max(abs(a - b) for a, b in zip(got, score, strict=True)) < 1e-9
    assert sum((s > 0) == y for s, (_, y, _) in zip(got, rows, strict=True)) > 0.8 * len(rows)
    limits = thresholds(df, boost(df, trees=4, depth=2), 0.8, 20)
    for kind, least in limits.items():
        above = [(y, n) for s, (x, y, n) in zip(got, rows, strict=True) if x["kind"] == kind and s >= least]
        assert sum(y * n for y, n in above) >= 0.8 * sum(n for _, n in above)
    assert limits and boost(df.where("label = 1")) is None
