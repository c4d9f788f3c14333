"""Cases in which an operator once did less than its whole job."""

from factlattice.llm import pii, toxicity


def test_toxicity_scores_every_occurrence():
    """A dense passage is found though each of its words stood before it, and a second copy of it too."""
    bad = [b"vile", b"trash", b"scum", b"filth"]
    model = toxicity.Model({w: 3.0 for w in bad}, 1.0, 0.01, (-4.0, 1.0), 0.0)
    filler = [b"word"] * 60
    scattered = [w for b in bad for w in (b, *filler)]
    found = [(a, b) for _, a, b in model.passages(scattered + bad + filler + bad)]
    n = len(scattered)
    assert found == [(n, n + 3), (n + 64, n + 67)]
    assert [(a, b) for _, a, b in model.passages(filler + [b"trash"] * 4)] == [(60, 63)]


def _docs(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")


def test_pii_counts_terms_in_all_texts(spark):
    """A common word that stands beside one address only tells little; a name far from the address tells much."""
    far = " and so on it went" * 8
    texts = [f"note {k} please ask bob.x@corp.org today {k}{far} Zebulon signed item {k}" for k in range(4)]
    texts += [f"please come today number {k}{far} signed item" for k in range(200)]
    texts += ["the other day ZEBULON was seen, Zebulonia too", "nobody"]
    got = {r.doc_id: r for r in pii.pii(_docs(spark, texts)).collect()}
    for k, text in enumerate(texts):
        spans = [x.split(":") for x in got[k].spans.split(",") if x.startswith("term")]
        words = [text[int(s):int(e)].lower() for _, s, e in spans]
        assert "please" not in words and "today" not in words
        assert ("zebulon" in words) == (k < 4 or k == 204) and got[k].n_term == len(spans)
    clean = {r.doc_id: r.text for r in pii.sanitised(_docs(spark, texts)).collect()}
    assert not any("zebulon " in t.lower() for t in clean.values()) and "Zebulonia" in clean[204] and clean[205] == "nobody"


def test_pii_copies_of_a_passage(spark):
    """Rare words of texts that share one passage with an address have one witness only."""
    texts = [f"rare{chr(97 + k)} words {k} xylem quoin " + "same passage " * 8 + "a@b.cc" + " ends here" * 8 for k in range(9)] + [f"other text {k}" for k in range(9)]
    assert all(r.n_term == 0 for r in pii.pii(_docs(spark, texts)).collect())
