import numpy as np

from semtag.llm.langid import WINDOW, ByteCNN, fit_languages, predict_languages, windows


def test_held_out_accuracy_and_und(docs, rows):
    got = predict_languages(docs, fit_languages(docs)).collect()
    assert len(got) == len(rows) and "lang" in got[0].asDict()
    clear = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 200]
    assert sum(x["lang_pred"] == x["lang"] for x in clear) >= 0.97 * len(clear)
    for x in got:
        letters = x["text"] and any(map(str.isalpha, x["text"]))
        assert (x["lang_pred"] == "und") == (not letters) and 0 <= x["score"] <= 1


def test_nothing_to_learn_from(docs, nothing):
    assert {x["lang_pred"] for x in predict_languages(docs, fit_languages(nothing)).collect()} == {"und"}
    assert predict_languages(nothing, None).count() == 0


def test_the_sample_is_bounded_where_rows_and_ids_repeat(spark, docs):
    text = "case id % 3 when 0 then 'ein und das selbe' when 1 then concat('the number ', id, ' of them') else concat('die Nummer ', id, ' von jenen') end"
    hot = spark.range(3000).selectExpr("cast(null as long) as doc_id", f"{text} as text", "if(id % 3 = 1, 'en', 'de') as lang")
    net = fit_languages(hot, most_documents=1000, most_windows=600)
    assert net.classes == ["de", "en"]
    found = predict_languages(hot, net)
    assert found.where("text not like 'ein%' and lang_pred != lang").count() < 20
    alone = fit_languages(hot.where("text like 'ein%'").limit(50).unionAll(hot.where("lang = 'en'")), most_documents=100, most_windows=60)
    assert alone.classes == ["de", "en"]
    again = fit_languages(hot.repartition(7), most_documents=1000, most_windows=600)
    assert all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters(), strict=True))


def test_windows_cover_every_run():
    for n in (0, 1, 255, 256, 257, 600, 1013):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        found = [w.tobytes() for w in windows(text)]
        assert all(len(w) == WINDOW for w in found)
        assert all(any(text[i : i + 4] in w for w in found) for i in range(max(0, n - 3)))


def test_gradients_against_differences():
    r = np.random.default_rng(3)
    net = ByteCNN.fresh(["a", "b", "c"], 1)
    x, y = r.integers(0, 256, (4, WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -net.log_probabilities(x, net.tables())[np.arange(4), y].mean()
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[i], 1e-2
        p[i] = old + h
        up = loss()
        p[i] = old - h
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * h) - g[i]) < 0.1 * abs(g[i]) + 2e-3


def test_scores_equal_a_plain_network(docs):
    """Every text's windows, byte by byte through embedding, filters, pooling and softmax, in plain loops over windows."""
    net = fit_languages(docs)

    def plain(text):
        data = text.lower().encode()
        step, logs = WINDOW - 3, []
        for at in range(0, max(1, len(data) - 3), step):
            seen = np.zeros(WINDOW, int)
            part = list(data[at : at + WINDOW])
            seen[: len(part)] = part
            pooled = []
            for f, b in zip(net.filters, net.bias, strict=True):
                w = len(f) // net.embed.shape[1]
                z = np.array([net.embed[seen[i : i + w]].ravel() @ f + b for i in range(WINDOW - w + 1)])
                pooled += np.maximum(z.max(axis=0), 0).tolist()
            z = np.array(pooled) @ net.out + net.out_bias
            p = np.exp(z - z.max())
            logs.append(np.log(np.maximum(p / p.sum(), 1e-9)))
        mean = np.mean(logs, axis=0)
        p = np.exp(mean - mean.max())
        return p / p.sum()

    for x in predict_languages(docs.where("doc_id < 12 or doc_id between 503 and 509").where("length(text) < 3000"), net).collect():
        if x["lang_pred"] != "und":
            p = plain(x["text"])
            assert x["lang_pred"] == net.classes[int(p.argmax())] and abs(x["score"] - p.max()) < 1e-3, x["doc_id"]


def test_every_window_of_the_chosen_rows_is_learnt_from(docs, monkeypatch):
    seen = []
    monkeypatch.setattr("semtag.llm.langid.train", lambda x, y, classes: seen.append((len(x), classes)) or ByteCNN.fresh(classes, 1))
    fit_languages(docs, most_documents=10**6)
    import zlib

    want = set()
    for x in docs.collect():
        if x["text"] is not None and x["lang"] is not None and zlib.crc32(("" if x["doc_id"] is None else str(x["doc_id"])).encode()) % 4 != 2:
            want |= {(bytes(w), x["lang"]) for w in windows(x["text"].lower().encode())}
    assert seen == [(len(want), ["de", "en", "fr"])]
