"""Decontamination, token counts, toxicity and packing on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import packing, templates, tokencount, toxicity
from skein.llm.common import tokenizer_path
from tests.llm.cases import documents

ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n "), (4, "the " * 30000), (5, "twice is here"), (5, "twice is here")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"rid": F.lit("x"), "source": F.lit(None).cast("string"), "n_tokens": F.lit(1.5)})


def test_decontamination(spark, odd):
    item = "On Monday Anna Smith bought 12 apples for 3 dollars and Anna Smith gave 12 apples to her brother Tom near the river."
    same = item.replace("Anna Smith", "Maria Lopez").replace("12", "40").replace("3 dollars", "9 euros").replace("Tom", "Peter")
    mixed = item.replace("12 apples to", "7 apples to").replace("Anna Smith gave", "Carl Jones gave")
    docs = [(10, "Some words before. " + item + " And some after."), (11, "It was so: " + same), (12, mixed), (13, "Nothing of the kind was ever written by anyone here at all, it seems."), (14, item.lower())]
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (None, "x y z a b c d e f")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.best_item) for r in templates.flag(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {10: (True, 1), 11: (True, 1), 12: (False, None), 13: (False, None), 14: (True, 1)}
    assert templates.flag(odd, bench).count() == len(ODD)
    assert templates.flag(odd, bench.limit(0)).where("contaminated").count() == 0
    assert templates.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench).count() == 2
    assert templates.flag(odd.limit(0), bench).count() == 0


def test_decontamination_of_numbers_and_inserted_words(spark):
    sums = "Compute 31 + 47 * 12 - 9"
    words = [f"w{chr(97 + i)}x" for i in range(26)] + ["alpha", "beta", "gamma", "delta"]
    near = [*words[:10], "really", *words[10:20], "quite", *words[20:]]
    apart = [*words[:10], *["filler"] * 40, *words[10:20], *["filler"] * 40, *words[20:]]
    docs = [(1, f"First. {sums} then stop."), (2, "First. Compute 31 + 48 * 12 - 9 then stop."), (3, "so " + " ".join(near) + " so"), (4, " ".join(apart)), (5, " ".join([*words[20:], "so", *words[10:20], "so", *words[:10]]))]
    bench = spark.createDataFrame([(1, sums), (2, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.best_item, r.coverage) for r in templates.flag(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (1, 1.0), 2: (None, 0.0), 3: (2, 1.0), 4: (None, 0.0), 5: (None, 0.0)}


def test_decontamination_of_stored_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [r.text for r in b.collect()]
    exact = {r.doc_id for r in d.collect() if any(x in r.text for x in items)}
    assert {r.doc_id for r in templates.flag(d, b).where("contaminated").collect()} == exact


def test_token_counts(spark, odd):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    machine = tokencount.machine(tokenizer_path("piece_bpe_32k.model"))
    rnd = random.Random(7)
    parts = [" ", "  ", "a", "th", "ing", "\n", "é", "日", "😀", "▁", "12", "<s>", "%%%", "́", "\x00", " " * 17, "abc" * 9]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        assert machine.text(s) == len(library.encode(s)), repr(s)
        whole = tokencount.MARK + s.replace(" ", tokencount.MARK)
        k = rnd.randint(1, 7)
        maps = [tokencount.summary(machine, whole[i:i + k]) for i in range(0, len(whole), k)]
        while len(maps) > 1:
            maps = [tokencount.compose(machine, *maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        assert not s or tokencount.close(machine, maps[0]) == len(library.encode(s)), repr(s)
    docs = documents("sf0.01")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: (len(t.encode()), len(library.encode(t))) for d, t in docs}
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(odd).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in ODD), key=str)
    assert tokencount.count_tokens(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(d, labels)
    held = toxicity.scores(d, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).collect()
    hit = sum(r.score >= 0.5 and r.toxic == 1 for r in held)
    assert hit >= 0.9 * sum(r.toxic == 1 for r in held)
    assert sum(r.score >= 0.5 and r.toxic == 0 for r in held) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in toxicity.scores(odd, model).collect()) and toxicity.scores(odd, model).count() == len(ODD)
    assert toxicity.learn(odd.limit(0), labels.limit(0)) is None
    assert toxicity.scores(odd, None).where("score = 0").count() == len(ODD)
    assert toxicity.keep_clean(d, model).columns == d.columns


def test_toxicity_of_altered_words(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(d, labels)
    rows = d.join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic", (toxicity.fold(F.col("doc_id")) == 0).alias("held")).collect()
    seen = {k: Counter(w for r in rows if r.toxic == k for w in set(re.findall(r"\w+", r.text.lower()))) for k in (0, 1)}
    own = [w for w, n in seen[1].items() if n >= 5 and not seen[0][w] and len(w) > 3]
    pattern = re.compile(r"\b(%s)\b" % "|".join(own), re.I)
    held = [r for r in rows if r.held and r.toxic and pattern.search(r.text)]
    signs = str.maketrans("oieas", "01345")
    changes = [lambda w: w, str.upper, lambda w: w.translate(signs), ".".join, lambda w: w[:2] + 3 * w[2] + w[3:], lambda w: w + "zig", lambda w: w[:-1] + "k"]
    docs = [(k, pattern.sub(lambda m: f(m[0]), r.text)) for k, f in enumerate(changes) for r in held]
    clean = [(100, r.text) for r in rows if r.held and not r.toxic]
    out = toxicity.scores(spark.createDataFrame(docs + clean, "doc_id long, text string"), model).collect()
    caught = [sum(r.score >= 0.5 for r in out if r.doc_id == k) for k in range(len(changes))]
    assert all(c >= 0.9 * len(held) for c in caught[:6]) and caught[6] >= 0.85 * len(held), (len(held), caught)  # the last: every toxic word has a letter that no fitted word has
    assert sum(r.score < 0.5 for r in out if r.doc_id == 100) >= 0.97 * len(clean)


def test_toxicity_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 1 << 10)
    column = pa.array(["lOooser w0rd " * 3000, None, "", "x" * 500, "i d i o t und \u00cdd\u00ef\u00f3t"])
    n, row, ids = toxicity._present(column)
    monkeypatch.setattr(toxicity, "PART", 1 << 18)
    whole = toxicity._present(column)
    assert n == 5 and set(row.tolist()) == {0, 3, 4} and (row == whole[1]).all() and (ids == whole[2]).all()
    plain, of = toxicity._plain_words(*toxicity.T.buffers(column))
    assert bytes(plain[of == 4]).split()[:3] == [b"idiot", b"und", b"idiot"]


def check_pack(docs, pieces):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {d: np.array([*e.ids, 1], "<u4") for (d, _, _), e in zip(docs, t.encode_batch([x or "" for _, x, _ in docs], add_special_tokens=False))}
    own, seq = {d: [] for d in ids}, {}
    for p in pieces:
        a = ids[p.doc_id]
        assert p.doc_tokens == len(a) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(a[p.start:p.start + p.length].tobytes())
        own[p.doc_id].append((p.start, p.length))
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length, p.doc_id))
    for d, a in ids.items():
        at = 0
        for s, n in sorted(own[d]):
            assert s == at
            at += n
        assert at == len(a)
    for k, x in seq.items():
        at = 0
        for o, n, _ in sorted(x):
            assert o == at
            at += n
        assert at == packing.LENGTH if k < max(seq) else at <= packing.LENGTH
    return ids, seq


def test_packing(spark, odd):
    rnd = random.Random(3)
    docs = [(d, t, rnd.choice(["a", "a", "a", "b", None])) for d, t in documents("sf0.01")] + [(9000, None, "c"), (9001, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    ids, seq = check_pack(docs, packing.pack(df).collect())
    name = {d: s or "" for d, _, s in docs}
    share = {s: sum(len(ids[d]) for d in ids if name[d] == s) / sum(map(len, ids.values())) for s in ("a", "b", "")}
    for w in range(max(seq) // packing.WINDOW_SEQUENCES):
        inside = [x for k in range(w * packing.WINDOW_SEQUENCES, (w + 1) * packing.WINDOW_SEQUENCES) for x in seq[k]]
        for s in share:
            assert abs(sum(n for _, n, d in inside if name[d] == s) / (packing.LENGTH * packing.WINDOW_SEQUENCES) - share[s]) < 0.02
    check_pack(docs, packing.pack(df, targets={"a": 0.5, "b": 0.4}).collect())
    assert packing.pack(odd.limit(0)).count() == 0
    assert packing.pack(odd).groupBy("doc_id").agg(F.sum("length")).count() == 6
