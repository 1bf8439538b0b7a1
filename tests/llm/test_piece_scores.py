import math
import random

import numpy as np
import public_tokenizers
import pytest

from leadwright.llm import sentencepiece_codec
from leadwright.llm.sentencepiece_codec import MARK, SCALE, Codec, encode_texts, fit_scores

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def expected_brute(codec, word):
    """Expected counts of pieces by listing every way to cut a word."""
    table = {codec.pieces[i]: i for i in codec.vocabulary}
    ways = []

    def go(at, ids, score):
        if at == len(word):
            ways.append((ids, score))
        for b in range(at + 1, len(word) + 1):
            if word[at:b] in table:
                go(b, [*ids, table[word[at:b]]], score + codec.scores[table[word[at:b]]])
            elif b == at + 1:
                go(b, ids, score + codec.unknown)

    go(0, [], 0.0)
    total = sum(math.exp(s) for _, s in ways)
    out = np.zeros(len(codec.pieces))
    for ids, s in ways:
        for i in ids:
            out[i] += math.exp(s) / total
    return out


def test_expected_counts_are_those_of_all_segmentations(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "LATTICE", 100)
    codec, r = Codec(PIECES), random.Random(3)
    words = [MARK + "".join(r.choice("thereandinogs☃") for _ in range(r.randrange(1, 10))) for _ in range(60)] + ["▁▁▁", "\n", "☃"]
    times = np.array([1 + i % 4 for i in range(len(words))])
    want = sum(expected_brute(codec, w) * n for w, n in zip(words, times))
    assert codec.expected(words, times) / SCALE == pytest.approx(want, abs=1e-3)


def test_fitted_scores_are_log_probabilities_and_reach_long_pieces(spark):
    import sentencepiece

    text = "The government of the country says that every language has its own history, and the people of the world speak many of them."
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    scores = fit_scores(df, PIECES)
    codec = Codec(PIECES)
    assert np.exp(scores[codec.vocabulary]).sum() == pytest.approx(1.0)
    assert (scores == fit_scores(df.repartition(5), PIECES)).all()
    codec.use(scores)
    assert [codec.pieces[i] for i in codec.best("▁language")] == ["▁language"] and [codec.pieces[i] for i in codec.best("▁government")] == ["▁government"]
    library = len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))
    assert {r.n_tokens for r in encode_texts(df, PIECES).collect()} == {len(codec.encode([text])[0])} and len(codec.encode([text])[0]) <= library
