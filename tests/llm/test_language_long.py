"""Long words and long pieces count in training."""

import numpy as np
import public_tokenizers

from quire.llm import language

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_long_words_and_pieces_are_trained(spark):
    vocabulary = language.Vocabulary(PIECES)
    assert "▁government" in vocabulary.pieces
    model = np.random.default_rng(3).random((len(vocabulary.pieces) + 1, 2)) / 1000
    for word in ("▁translation", "▁naïve日", "▁the" * 3):
        want = language.expected(vocabulary, model, [word], np.array([[2.0, 3.0]]))
        got = np.zeros_like(want)
        np.add.at(got, *language._expected_word(vocabulary, model, word, np.array([2.0, 3.0])))
        assert np.allclose(got, want)
    rows = [("のはにを" * 200, "ja"), ("the house and the garden", "en")] * 5
    fitted = language.train(spark.createDataFrame(rows, "text string, lang string"), PIECES)
    column = fitted.pieces[:-1, fitted.languages.index("ja")]
    assert column.max() > 100 * np.median(column)
