"""Rows of an unwanted domain go, whatever their rate; a fit that ends early says so."""

import numpy as np
import pytest

from quire.llm import mixing

WEIGHTS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    topics = {"good": "garden house friend table", "poor": "click buy cheap offer"}
    rows, labels = [], []
    for i in range(600):
        domain = ["good", "good", "good", "good", "poor", "toxic"][i % 6]
        # Unwanted rows so short that together they are within the fit's tolerance.
        text = "scum" if domain == "toxic" else " ".join(rng.choice((topics[domain] + " and the of").split(), rng.integers(300, 600)))
        rows.append((i, text))
        labels.append((i, domain))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_no_unwanted_row_stays(corpus, monkeypatch):
    docs, labelled = corpus
    domain = {r.doc_id: r.domain for r in mixing.rates(docs, labelled, WEIGHTS).collect()}
    # A fit that is within its tolerance at once leaves every rate where it started.
    monkeypatch.setattr(mixing, "fit_rates", lambda docs, model, weights: (mixing.Mix(model, 1.0, [], [0.0] * 3, []), None))
    kept = {r.doc_id for r in mixing.repeat_rows(docs, labelled, WEIGHTS).collect()}
    assert sum(d == "toxic" for d in domain.values()) > 50
    assert kept == {i for i, d in domain.items() if d != "toxic"}


def test_early_end_is_reported(corpus):
    docs, labelled = corpus
    model = mixing.fit_domains(docs, labelled, sorted(WEIGHTS))
    with pytest.warns(RuntimeWarning, match="1 steps"):
        mixing.fit_rates(docs, model, WEIGHTS, most_steps=1)
