"""The registered queries themselves, and the whole pipeline, on small tables with odd rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from semtag.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, docs, labels, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    vectors = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)], i) for i in range(60)] + [(5, None, 0), (6, [0.0] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int").write.parquet(f"{at}/embeddings.parquet")
    turns = [(c, t, "assistant" if t % 2 else "user", None if t == 4 else f"text {c} {t} [INST]", 1) for c in (1, 2, None) for t in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n_turns int").write.parquet(f"{at}/conversations.parquet")
    pages = [(i, f"https://h{i % 2}.example/{i}", f"<nav>menu</nav><article><p>story {i} of many words</p></article><footer>end</footer>", "x") for i in range(10)] + [(10, None, None, "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "conversations", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{at}/{name}.parquet")
    return at


def test_the_queries_keep_their_contracts(spark, tables, rows):
    got = {name: query(spark, tables).collect() for name, query in QUERIES.items()}
    fold = lambda d, n: zlib.crc32(str("" if d is None else d).encode()) % n
    ids = Counter(d for d, *_ in rows)
    for name in ("op2_quality", "op3_score", "op4_language", "op5_mix", "op8_near_duplicates", "op10_shard"):
        assert Counter(x["doc_id"] for x in got[name]) == ids, name
    assert {x["query_id"] for x in got["op1_search"]} == {0, 20, 40} and all(x["vec_id"] != x["query_id"] for x in got["op1_search"])
    assert Counter(x["query_id"] for x in got["op1_search"]) == {0: 20, 20: 20, 40: 20}
    assert all(x["held_out"] == (fold(x["doc_id"], 7) == 2) for x in got["op3_score"]) and all(x["held_out"] == (fold(x["doc_id"], 4) == 2) for x in got["op4_language"])
    words = Counter()
    for d, t, *_ in rows:
        words[d] += len((t or "").encode().split()) + 1
    assert Counter({d: 0 for d in ids}) | words == sum((Counter({x["doc_id"]: x["n_tokens"]}) for x in got["op3_score"]), Counter())
    assert {x["train_tokens"] for x in got["op3_score"]} == {sum(len((t or "").encode().split()) + 1 for d, t, *_ in rows if fold(d, 7) != 2)}
    planted = next(x for x in got["op6_chat"] if x["conv_id"] == -7)
    said = "</s>[INST] ok [/INST]"
    assert planted["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and planted["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert {x["page_id"]: x["text"] for x in got["op7_extract"]} == {**{i: f"story {i} of many words" for i in range(10)}, 10: ""}
    assert sum(x["length"] for x in got["op9_pack"]) == sum({(x["doc_id"], x["doc_tokens"]): x["doc_tokens"] * ids[x["doc_id"]] for x in got["op9_pack"]}.values())
    texts = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got["op10_shard"]) == texts


def test_empty_tables_give_no_rows(spark, empty):
    counts = {name: query(spark, empty).count() for name, query in QUERIES.items()}
    assert counts == {**dict.fromkeys(QUERIES, 0), "op6_chat": 1}
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_the_pipeline_runs_through(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    kept = {x["doc_id"] for x in got}
    assert set(range(120)) & kept and not kept & set(range(200, 220)) and not any(d is not None and 400 <= d < 500 for d in kept)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, tables)
    want = c.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[k] for k in sorted(df.columns)) for r in df.collect()))) == sorted(map(repr, want)) and want
