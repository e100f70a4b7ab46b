import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skein.llm import automata, suffixes
from tests.llm import brute
from tests.llm.cases import documents


def words(spark, docs):
    out = automata.remove_repeated_words(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r[0]: tuple(r)[1:] for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()}


def bytes_(spark, docs):
    out = suffixes.remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r[0]: tuple(r)[1:] for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}


def small(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["é", "ñandú"]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(10, 60))] for _ in range(5)]
    docs = []
    for d in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(w))
            w[k:k] = rnd.choice(passages)
        docs.append((d * 3, rnd.choice([" ", "\n", " \t"]).join(w)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (1, docs[5][1]), (502, ""), (503, None), (504, "ab " * 200), (505, "x" * 350), (506, "x" * 99)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_words_and_bytes_equal_brute_force(spark, seed):
    docs = small(seed)
    assert words(spark, docs) == brute.repeated_words(docs)
    assert bytes_(spark, docs) == brute.repeated_bytes(docs)


def test_stored_documents(spark):
    docs = documents("sf0.001")
    assert words(spark, docs) == brute.repeated_words(docs)
    assert bytes_(spark, docs) == brute.repeated_bytes(docs)


def guarded(engine, most):
    def run(contents, docs, places):
        if len(contents) > most:
            raise ValueError(f"{len(contents)} contents at once")
        return engine(contents, docs, places)
    return run


def test_hot_key_is_not_given_to_one_engine(spark, monkeypatch):
    rnd = random.Random(7)
    common = " ".join(f"word{i}" for i in range(60))
    noise = lambda: " ".join(str(rnd.randint(0, 10**6)) for _ in range(20))
    docs = [(d, f"{noise()} {common} {noise()}" if d % 3 == 0 else noise()) for d in range(600)]
    for module, run, want in ((automata, words, brute.repeated_words), (suffixes, bytes_, brute.repeated_bytes)):
        cfg = module.CONFIG
        monkeypatch.setattr(module, "CONFIG", replace(cfg, block=80 * cfg.window, engine=guarded(cfg.engine, 150)))
        assert run(spark, docs) == want(docs)


@pytest.mark.parametrize("seed", [1, 3])
def test_all_keys_hot(spark, monkeypatch, seed):
    docs = small(seed)
    for module, run, want in ((automata, words, brute.repeated_words), (suffixes, bytes_, brute.repeated_bytes)):
        monkeypatch.setattr(module, "CONFIG", replace(module.CONFIG, block=0, engine=guarded(module.CONFIG.engine, 0)))
        assert run(spark, docs) == want(docs)


def test_short_phrases_bring_no_contents(spark, monkeypatch):
    """Before: every place of a phrase of 16 bytes was cut out, more of them the more text there is."""
    rnd = random.Random(5)
    noise = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150))
    docs = [(d, f"{noise()} in the same phrase {noise()}") for d in range(200)]
    monkeypatch.setattr(suffixes, "CONFIG", replace(suffixes.CONFIG, engine=guarded(suffixes.CONFIG.engine, 0)))
    assert all(r[1] == 0 for r in bytes_(spark, docs).values())


def test_engine_runs():
    import numpy as np
    a, b = b"x" * 20 + bytes(range(120)), bytes(range(120)) + b"y" * 30
    found = suffixes._engine([a, b], np.array([4, 2]), np.array([0, 7]))
    assert [list(map(int, r)) for r in zip(*found)] == [[0, 0, 19, 4, 0], [0, 20, 40, 2, 7], [1, 0, 50, 2, 7]]


def test_odd_tables(spark):
    docs = [(None, "a " * 40), (None, None), (7, "b " * 40), (7, "b " * 40), (8, "b " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rid", "key", "copy", "ranges")})
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in automata.remove_repeated_words(df).collect()), key=str)
    assert out == sorted([(7, 40, 0), (7, 40, 0), (8, 40, 40), (None, 0, 0), (None, 40, 0)], key=str)
    assert suffixes.remove_repeated_bytes(df.limit(0)).count() == 0
    assert automata.remove_repeated_words(df.limit(0)).count() == 0


def test_multikey_classes():
    import numpy as np
    rnd = np.random.RandomState(0)
    data = rnd.randint(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | pad[j:j + len(eight)]
    at = np.arange(len(data) - 35)
    cls = suffixes.multikey_classes(eight, at, 36)
    raw = data.tobytes()
    by = {}
    for i, c in zip(at.tolist(), cls.tolist()):
        assert by.setdefault(c, raw[i:i + 36]) == raw[i:i + 36]
    assert len(set(cls.tolist())) == len({raw[i:i + 36] for i in at.tolist()})
