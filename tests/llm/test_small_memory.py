"""What workers keep: words without the signs behind them, and few texts of a batch at once."""

from millrace.llm import langid, packing


def test_words_are_kept_without_their_signs():
    ids = packing.WordIds(packing.tokenizer_path())
    got = packing.text_ids(ids, "Alpha, alpha. Beta; Ünder (gamma) abc123 é,")
    assert got == b"".join(int(i).to_bytes(4, "little") for i in ids.whole.encode("Alpha, alpha. Beta; Ünder (gamma) abc123 é,", add_special_tokens=False).ids)
    assert b"Alpha" in ids and b"Alpha," not in ids and b"Beta;" not in ids


def test_texts_of_a_batch_are_scored_in_parts(spark, tmp_path, monkeypatch):
    assert langid.CHUNK <= 1 << 18 and langid.TEXTS <= 256
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(i, ("the word and the other " if i % 2 else "el otro y la palabra ") * (1 + i % 5) if i % 7 else None, "en" if i % 2 else "es") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    told = {r["doc_id"]: r for r in langid.identify(docs.repartition(1), model).collect()}
    for i, text, lang in rows:
        assert told[i]["lang_pred"] == (lang if text else langid.UNKNOWN)
        if text:
            assert abs(told[i]["score"] - langid.text_scores(model, [langid.prepared(text)]).max()) < 1e-9
