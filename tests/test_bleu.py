"""BLEU numbers of the toolkit's own examples (sentence and corpus level)."""

import pytest

from skein.operators import bleu

# public example sentences of the BLEU toolkit documentation (fixed test values)
HYP1 = "It is a guide to action which ensures that the military always obeys the commands of the party".split()
REF1A = "It is a guide to action that ensures that the military will forever heed Party commands".split()
REF1B = ("It is the guiding principle which guarantees the military forces always being under the command of "
         "the Party").split()
REF1C = "It is the practical guide for the army always to heed the directions of the party".split()
HYP2 = "he read the book because he was interested in world history".split()
REF2A = "he was interested in world history because he read the book".split()


def _frames(spark, pairs):
    hyp = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pairs)], "pair_id long, toks array<string>")
    refs = spark.createDataFrame([(i, j, r) for i, (_, rs) in enumerate(pairs) for j, r in enumerate(rs)],
                                 "pair_id long, ref_id int, toks array<string>")
    return hyp, refs


@pytest.mark.parametrize("method,expected", [(0, 0.4118), (1, 0.4118), (2, 0.4489), (3, 0.4118), (4, 0.4118)])
def test_sentence_smoothing(spark, method, expected):
    hyp, refs = _frames(spark, [(HYP1, [REF1A])])
    got = bleu.sentence_bleu(hyp, refs, methods=(method,)).first()[f"bleu_m{method}"]
    # documented values are truncated to four digits ("0.4489...")
    assert expected <= got < expected + 1e-4


def test_corpus_and_mean_of_sentences(spark):
    hyp, refs = _frames(spark, [(HYP1, [REF1A, REF1B, REF1C]), (HYP2, [REF2A])])
    corpus = bleu.corpus_bleu(hyp, refs).first()["bleu_m0"]
    assert 0.5920 <= corpus < 0.5921
    sent = [r["bleu_m0"] for r in bleu.sentence_bleu(hyp, refs, methods=(0,)).collect()]
    assert 0.6223 <= sum(sent) / 2 < 0.6224
