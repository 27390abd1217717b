"""Keys beside fixed spans, keys of letters alone and keys at the end of a path."""

import itertools

import numpy as np

from quire.llm import secrets


def test_parts_of_runs_are_judged(spark):
    rng = np.random.default_rng(1)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    key = lambda n, of: "".join(rng.choice(of, n))
    words = ["session", "index", "customer", "value", "handler", "internationalization", "misunderstandings"]
    samples = [(key(32, letters + list("0123456789")), True) for _ in range(300)]
    samples += [(f"{a}{s}{b}", False) for a, b in itertools.product(words, repeat=2) for s in "/_-="]
    forms = [f(w) for w in words for f in (str, str.title, str.upper)] + [f"{w}{n}" for w in words for n in range(2000, 2020)]
    samples += [(w, False) for w in forms] * 20
    model = secrets.fit(spark.createDataFrame(samples, "value string, random boolean"))
    keys = [key(40, letters + list("0123456789")) for _ in range(50)]
    alone = [key(40, letters) for _ in range(50)]
    path = "/".join(["customer/session_handler/value-index"] * 12)
    texts = [(i, f"AKIA{'ABCD' * 4}/{k} end") for i, k in enumerate(keys)]
    texts += [(100 + i, f"see {k} here") for i, k in enumerate(alone)] + [(200 + i, f"in {path}/{k}") for i, k in enumerate(keys)]
    texts += [(999, f"{path} internationalization misunderstandings")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = secrets.find_secrets(docs, model).collect()
    text = dict(texts)
    assert not next(r for r in found if r.doc_id == 999).secret_spans
    for r in found:
        assert all(s.value == text[r.doc_id][s.start : s.end] for s in r.secret_spans)
    left = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs, model)).collect()}
    gone = [sum(k not in left[at + i] for i, k in enumerate(ks)) for at, ks in ((0, keys), (100, alone), (200, keys))]
    assert min(gone) >= 45, gone
    assert all(left[200 + i].startswith(f"in {path}") for i in range(50))


def test_few_samples_find_keys_and_spare_words(spark):
    """Eleven labelled keys and some words: 90 % of planted keys found, no identifier of words reported."""
    import numpy as np

    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    key = lambda n: "".join(rng.choice(letters, n))
    names = ["customer", "session", "handler", "index", "value", "request", "current", "table", "remote", "filter"]
    samples = [(key(24), True) for _ in range(11)] + [(f"{a}_{b}", False) for a in names for b in names]
    model = secrets.fit(spark.createDataFrame(samples, "value string, random boolean"))
    for n in (16, 20, 32, 40):
        docs = spark.createDataFrame([(i, f"see {key(n)} here") for i in range(100)], "doc_id long, text string")
        assert secrets.find_secrets(docs, model).where("size(markov) > 0").count() >= 90
    calm = spark.createDataFrame([(i, f"{a}_{b}_{c} and {c}{a}{b}") for i, (a, b, c) in enumerate(zip(names, names[3:] + names[:3], names[5:] + names[:5]))], "doc_id long, text string")
    assert secrets.find_secrets(calm, model).where("size(markov) > 0").count() == 0
