import public_tokenizers as P

from ledgerline.llm import encoding as E, hashing as H, stages, worker_tables


def test_a_worker_holds_one_kind_of_tables():
    """Hashes of words go when ids of chunks are asked for, and the other way; results are as before."""
    words = [b"some", b"words", b"of", b"a", b"text"]
    first = H.hash_words(words).tolist()
    assert len(H._WORDS) == 5
    ids = E.library_ids(P.path("byte_bpe_50k.json"), P.PATTERN, [b"some words of a text"])
    assert not H._WORDS and len(E._LOADED) == 1
    table = E.library_table(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert table is E.library_table(P.path("byte_bpe_50k.json"), P.PATTERN) and table.young
    assert H.hash_words(words).tolist() == first and not E._LOADED
    assert E.library_ids(P.path("byte_bpe_50k.json"), P.PATTERN, [b"some words of a text"]) == ids
    worker_tables.only(None)
    assert not H._WORDS and not E._LOADED


def test_first_stage_empties_what_the_last_one_left(spark, monkeypatch):
    """A worker that has encoded and then labels languages keeps no ids of chunks."""
    monkeypatch.setattr(stages, "keep_rows", lambda docs, keep: keep)
    docs = spark.createDataFrame([(1, "one text of letters", "en")], "doc_id long, text string, lang string")
    keep = stages.language_id(spark, docs, "")
    E.library_ids(P.path("byte_bpe_50k.json"), P.PATTERN, [b"a text"])
    assert E._LOADED
    assert keep([b"one text of letters", None]) == [True, False]
    assert not E._LOADED
