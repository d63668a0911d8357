"""Personal data: proposed spans, judged by boosted trees, all in DataFrame expressions.

Fixed patterns give the base spans, which always count. Generators of high recall propose more, overlapping
spans: loose and tight digit groups, dotted quads, addresses with written-out signs. Each proposal becomes a few
small whole numbers about its format and its context. Proposals that overlap a base span of their kind are the
positive examples, all others the negative ones; equal examples are counted, over all documents, so that what is
learnt from is a small table of distinct feature rows. Gradient-boosted trees grow level by level, each from one
histogram of gradients, summed in whole numbers so that reruns agree. On documents held out by hash, a
threshold for each kind is set where the proposals above it are right often enough; a kind with too few examples
gets none. Proposals above it that touch no base span are added, one of each run that overlaps.

Patterns use possessive loops and look-behind, so that no text makes them recurse or go back over it; each gives
the same spans as the plain pattern, as its loops can't give back what they took and a failing run fails from all its places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import prepare, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?i:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?)", r"(?i:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)"
_WORD_AT, _WORD_DOT = r"\x20(?:at|AT|At)\x20", r"\x20(?:dot|DOT|Dot)\x20"
#: (kind, pattern) of the generators; those of one kind may overlap one another.
GENERATORS = [
    (0, rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++"),
    (0, rf"(?<!{_LOCAL}){_LOCAL}++{_WORD_AT}{_LABEL}++(?:{_WORD_DOT}{_LABEL}++)++"),
    (1, r"(?<![0-9.])[0-9]{1,5}(?:(?:\.|\x20?[(\[{]\x20?(?:\.|dot)\x20?[)\]}]\x20?)[0-9]{1,5}){3}(?![0-9])"),
    (2, r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])"),
    (2, r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])"),
    (3, r"(?<![0-9+])\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){8,14}(?![0-9])"),
    (3, r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
#: Words before a span that speak for its kind, and against any.
CUES = {
    0: r"(?i)(?:mail|e-mail|contact|write|schreib|correo|courriel)[^A-Za-z0-9]*$",
    1: r"(?i)(?:ip|host|server|address|adresse|client|from)[^A-Za-z0-9]*$",
    2: r"(?i)(?:card|visa|credit|pay|karte|carte|tarjeta)[^A-Za-z0-9]*$",
    3: r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|appelez|llame)[^A-Za-z0-9]*$",
}
AGAINST = r"(?i)(?:version|ver|v|isbn|issn|id|no|nr|order|ref|serial|hash|token|key|password)[^A-Za-z0-9]*$"
#: Features of a proposal, with what a value is held to.
FEATURES = {"kind": 3, "digits": 20, "groups": 9, "longest": 10, "opening": 3, "marks": 31, "valid": 1, "left": 4, "right": 4, "cue": 2}
CONTEXT = 24  # code points before a span in which a cue counts
STEP = 128  # spans whose places are added up in one run
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each number, run by run, so that a long array takes no square of its length."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    starts = F.sequence(F.lit(1), F.size(numbers), F.lit(STEP))
    of_runs = F.transform(starts, lambda at: add(F.slice(numbers, at, F.lit(STEP))))
    ahead = let(of_runs, lambda b: F.transform(b, lambda _, i: add(F.slice(b, F.lit(1), i))))
    place = lambda i: i - F.pmod(i, F.lit(STEP)) + 1
    sums = let(ahead, lambda o: F.transform(numbers, lambda _, i: F.get(o, F.floor(i / STEP).cast("int")) + add(F.slice(numbers, place(i), F.pmod(i, F.lit(STEP)) + 1))))
    return F.when(F.size(numbers) > 0, sums).otherwise(numbers)


def located(text: Column, pattern: str, may: Column, tell: Callable[[Column, Column, Column, Column, Column], Column], kind: str) -> Column:
    """tell(match, start, end, text since the match before, text until the next) of each match of a pattern, left to right; code points, end exclusive.

    ``may``: a cheaper test that is true wherever there is a match.
    """
    length = lambda x: F.length(x).cast("long")

    def placed(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        return let(pieces, lambda p: let(F.transform(found, lambda x, i: length(F.get(p, i)) + length(x)), lambda w: let(running_sums(w), lambda e: F.transform(found, lambda x, i: tell(x, F.get(e, i) - length(x), F.get(e, i), F.get(p, i), F.get(p, i + 1))))))

    none = F.array().cast(f"array<{kind}>")
    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))).otherwise(none)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the check sum of card numbers; false for other lengths."""
    digit = lambda i: F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
    doubled = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def passes(kind: int, x: Column) -> Column:
    """What a match of a base pattern must meet besides."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return let(digits_of(x), luhn if kind == 2 else lambda d: F.length(d).between(9, 15))


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end>> of the fixed patterns, by kind, then start."""
    row = "struct<kind:int,start:long,end:long,ok:boolean>"

    def every(digits: Column) -> Column:
        found = []
        for k, may in enumerate([text.contains("@"), digits, digits, text.contains("+") & digits]):
            tell = lambda x, start, end, *_, k=k: F.struct(F.lit(k).alias("kind"), start.alias("start"), end.alias("end"), passes(k, x).alias("ok"))
            found.append(F.filter(located(text, BASE[KINDS[k]], may, tell, row), lambda s: s["ok"]))
        return F.transform(F.concat(*found), lambda s: s.dropFields("ok"))

    return let(text.rlike("[0-9]"), every)


def features(kind: int, x: Column, before: Column, after: Column) -> dict[str, Column]:
    """The proposal's features but for its kind."""
    groups = F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    has = lambda p, bit: F.when(x.rlike(p), bit).otherwise(0)
    side = lambda c: F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"[\p{L}\p{N}_]"), 1).when(c.rlike(r"[()\[\]{}<>\"']"), 2).when(c.rlike(r"[=:]"), 3).otherwise(4)
    opening = F.when(x.startswith("+"), 2).when(x.startswith("("), 1).when(x.startswith("00"), 3).otherwise(0)
    valid = {0: x.rlike(r"[A-Za-z]{2,24}$"), 1: let(F.regexp_replace(x, r"[^0-9]+", "."), lambda d: passes(1, d))}.get(kind)
    at = F.when(x.contains("@"), 0).when(x.rlike(r"[(\[{]"), 1).otherwise(2)
    near = F.right(before, F.lit(CONTEXT))
    return {
        "digits": F.regexp_count(x, F.lit("[0-9]")),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "opening": at if kind == 0 else opening,
        "marks": has(" ", 1) + has("-", 2) + has(r"\.", 4) + has(r"[()\[\]{}]", 8) + has("/", 16),
        "valid": F.when(passes(kind, x) if valid is None else valid, 1).otherwise(0),
        "left": side(F.right(before, F.lit(1))),
        "right": side(F.left(after, F.lit(1))),
        "cue": F.when(near.rlike(CUES[kind]), 1).when(near.rlike(AGAINST), 2).otherwise(0),
    }


def proposals(text: Column) -> Column:
    """array<struct<start,end,features>> of all generators."""
    row = "struct<" + ",".join(f"{n}:{t}" for n, t in [("start", "long"), ("end", "long"), *((f, "int") for f in FEATURES)]) + ">"

    def tell(kind: int) -> Callable[[Column, Column, Column, Column, Column], Column]:
        def of(x: Column, start: Column, end: Column, before: Column, after: Column) -> Column:
            told = {"kind": F.lit(kind)} | features(kind, x, before, after)
            return F.struct(start.alias("start"), end.alias("end"), *[F.least(told[f].cast("int"), F.lit(most)).alias(f) for f, most in FEATURES.items()])

        return of

    written = [text.contains("@") | text.rlike(r"[aA][tT]\x20?[)\]}]"), text.contains(" dot ") | text.contains(" DOT ") | text.contains(" Dot ")]
    every = lambda digits: F.concat(*[located(text, p, written[i] if k == 0 else digits, tell(k), row) for i, (k, p) in enumerate(GENERATORS)])
    return let(text.rlike("[0-9]"), every)


class Tree:
    """A tree under growth: a split (feature, most that goes left) or a value at each node; a node's children are 2n + 1 and 2n + 2."""

    def __init__(self):
        self.splits: dict[int, tuple[str, int]] = {}
        self.values: dict[int, float] = {}

    def expression(self, leaf: Callable[[int], str], node: int = 0) -> str:
        if node not in self.splits:
            return leaf(node)
        name, most = self.splits[node]
        return f"CASE WHEN {name} <= {most} THEN {self.expression(leaf, 2 * node + 1)} ELSE {self.expression(leaf, 2 * node + 2)} END"

    def score(self) -> str:
        return self.expression(lambda n: f"{self.values.get(n, 0.0)!r}D")


def best_split(histogram: dict[str, dict[int, tuple[float, float]]], weight: float, least: float) -> tuple | None:
    """(gain, feature, most that goes left, gradients and Hessians of both sides) of a node's best split; None if none gains."""
    best = None
    for name in FEATURES:
        values = sorted(histogram.get(name, {}).items())
        all_g, all_h = (sum(v[i] for _, v in values) for i in (0, 1))
        g = h = 0.0
        for value, (dg, dh) in values[:-1]:
            g, h = g + dg, h + dh
            if h >= least and all_h - h >= least:
                gain = g * g / (h + weight) + (all_g - g) ** 2 / (all_h - h + weight) - all_g**2 / (all_h + weight)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, name, value, (g, h), (all_g - g, all_h - h))
    return best


def boost(examples: DataFrame, trees: int = 8, depth: int = 3, rate: float = 0.4, weight: float = 1.0, least: float = 1.0) -> str | None:
    """SQL of the log odds that a row of features is positive, from examples (features, label 0 or 1, n); None without both labels.

    Each level of a tree is one aggregation, of at most 2^depth nodes times the values that features are held to.
    """
    totals = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    score = f"{math.log(totals[1] / totals[0])!r}D"
    unit = 1 << 20  # gradients are summed as whole numbers of this part
    for _ in range(trees):
        tree, open_nodes = Tree(), [0]
        p = F.expr(f"1 / (1 + exp(-({score})))")
        graded = examples.withColumn("__p", p).select(*FEATURES, (F.col("n") * F.round((F.col("__p") - F.col("label")) * unit).cast("long")).alias("g"), (F.col("n") * F.round(F.col("__p") * (1 - F.col("__p")) * unit).cast("long")).alias("h"))
        for _ in range(depth):
            at = graded.withColumn("node", F.expr(tree.expression(str))).where(F.col("node").isin(open_nodes))
            each = at.select("node", "g", "h", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("f"))
            histograms: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
            for r in each.groupBy("node", "f.feature", "f.value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                histograms.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["value"]] = (r["g"] / unit, r["h"] / unit)
            grown = []
            for node in open_nodes:
                if (split := best_split(histograms.get(node, {}), weight, least)) is not None:
                    tree.splits[node] = split[1:3]
                    for child, (g, h) in zip((2 * node + 1, 2 * node + 2), split[3:], strict=True):
                        tree.values[child] = -rate * g / (h + weight)
                        grown.append(child)
            if not (open_nodes := grown):
                break
        if not tree.splits:
            break
        score += f" + {tree.score()}"
    return score


def thresholds(examples: DataFrame, score: str, precision: float, least: int, buckets: int = 1000) -> dict[int, float]:
    """By kind, the least log odds from which upwards proposals are positive with the precision (one more wrong one assumed), if ``least`` positives are.

    One aggregation to probability buckets.
    """
    bucket = F.floor(F.expr(f"{buckets} / (1 + exp(-({score})))")).cast("int")
    rows = examples.groupBy("kind", bucket.alias("bucket")).agg(F.sum(F.col("n") * F.col("label")).alias("right"), F.sum("n").alias("n")).collect()
    out = {}
    for kind in range(len(KINDS)):
        right = total = 0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["bucket"]):
            right, total = right + r["right"], total + r["n"]
            if right < precision * (total + 1):
                continue
            if right >= least:
                p = min(max(r["bucket"], 1), buckets - 1) / buckets
                out[kind] = math.log(p / (1 - p))
    return out


def find_personal_data(docs: DataFrame, precision: float = 0.98, least: int = 20, trees: int = 8, depth: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row's whole text (null: empty).

    ``spans``: kind:start:end of base spans and added ones, by kind, then start, in code points; ``n_added`` of them are
    the model's. It learns from all documents whose text's hash isn't 0 modulo 5, and is calibrated on the others to the
    ``precision``, given ``least`` positive examples. Repeated rows are kept; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("rid"))
    held_out = (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held_out")
    found = slim.select("rid", "doc_id", held_out, base_spans(F.col("text")).alias("base"), proposals(F.col("text")).alias("proposed")).checkpoint()

    names = [*FEATURES]
    nothing = [F.lit(0).alias(f) for f in names if f != "kind"]
    of_base = found.select("rid", "held_out", F.explode("base").alias("s")).select("rid", "held_out", "s.start", "s.end", "s.kind", *nothing, F.lit(True).alias("is_base"))
    proposed = found.select("rid", "held_out", F.explode("proposed").alias("s")).select("rid", "held_out", "s.*", F.lit(False).alias("is_base"))
    spans = of_base.unionByName(proposed)

    def touches(*keys: str) -> Column:
        """Whether a base span of the same keys overlaps this one."""
        until, since = (Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0) for order in (F.asc("start"), F.desc("start")))
        reach = F.max(F.when(F.col("is_base"), F.col("end"))).over(until)
        ahead = F.min(F.when(F.col("is_base"), F.col("start"))).over(since)
        return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))

    judged = spans.withColumn("label", touches("rid", "kind").cast("int")).withColumn("touches", touches("rid")).where("not is_base").checkpoint()
    examples = judged.groupBy("held_out", *names, "label").agg(F.count("*").alias("n")).checkpoint()
    score = boost(examples.where("not held_out"), trees, depth)
    least_odds = thresholds(examples.where("held_out"), score, precision, least) if score else {}
    if not least_odds:
        return _told(found.withColumn("added", F.array().cast("array<struct<kind:int,start:long,end:long>>")))
    odds = F.expr(score).alias("odds")
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in least_odds.items() for x in kv]), F.col("kind"))
    chosen = judged.where("not touches").select("rid", "kind", "start", "end", odds).where(F.col("odds") >= limit)
    ordered = Window.partitionBy("rid").orderBy("start", "end", "kind")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = chosen.withColumn("new", F.when(F.coalesce(reach > F.col("start"), F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(ordered))
    best = F.max(F.struct("odds", (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("early"), (-F.col("kind")).alias("first"), F.struct("kind", "start", "end").alias("span")))
    added = runs.groupBy("rid", "run").agg(best.alias("b")).groupBy("rid").agg(F.collect_list("b.span").alias("added"))
    return _told(found.join(added, "rid", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:int,start:long,end:long>>"))))


def _told(found: DataFrame) -> DataFrame:
    name = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.when(F.size("added") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
